"""Batches of calls: run side by side, answered in the order they were made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.catalog import READ_ONLY


def in_order(answers: DataFrame, requests: DataFrame, by: str, pos: str, key: str = "id") -> DataFrame:
    """Answers that came in any order, in that of their requests; a request without one has nulls."""
    return requests.select(by, pos, key).join(answers, key, "left").orderBy(by, pos)


def run_batch(requests: DataFrame, functions: dict[str, Callable[[str], str]], by: str = "round", pos: str = "pos", most: int = 10, allowed: tuple[str, ...] = READ_ONLY) -> DataFrame:
    """(by, pos, name, outcome, answer) in order: each call applies the function of its name to args.

    Only the first `most` calls of a round run, and only those that change
    nothing; others say why not (over, refused, unknown), and an error is an
    answer. Calls are dealt to tasks one by one, not round by round.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(pos))
    state = F.when(rank > most, "over").when(~F.col("name").isin(*allowed), "refused").when(~F.col("name").isin(*functions), "unknown")
    rows = requests.select(by, pos, "name", "args", F.coalesce(state, F.lit("run")).alias("outcome"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outcomes, answers = [], []
            for name, args, outcome in zip(batch["name"], batch["args"], batch["outcome"], strict=True):
                answer = None
                if outcome == "run":
                    try:
                        outcome, answer = "ok", functions[name](args)
                    except Exception as e:
                        outcome, answer = "error", f"{type(e).__name__}: {e}"
                outcomes.append(outcome)
                answers.append(answer)
            yield batch.drop(columns=["args", "outcome"]).assign(outcome=outcomes, answer=answers)

    kind = requests.schema
    schema = f"{by} {kind[by].dataType.simpleString()}, {pos} {kind[pos].dataType.simpleString()}, name string, outcome string, answer string"
    return rows.repartition(by, pos).mapInPandas(run, schema).orderBy(by, pos)
