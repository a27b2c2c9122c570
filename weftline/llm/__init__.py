"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the thin registered
queries and ``sql`` their DuckDB counterparts where SQL can express them.
"""
