"""Queries over pages against their SQL, on references, spaces and tags that the given tables don't have."""

from __future__ import annotations

import html
import itertools

import pytest
from conftest import same_rows
from pyspark.sql import functions as F
from weftline.functions import text as T
from weftline.plans.registry import oracle_sql, queries

REFERENCES = ["&quot", "&quot;", "&quo", "&amp;", "&amp", "&am", "&amp;amp;", "&amp;lt;", "&copy", "&middot", "&nbsp;", "&nbsp", "&#39;", "&#39", "&#x27;", "&eacute;", "&lt", "&GT;"]
AROUND = ["", " ", "\xa0", "\u0085", "\r", "  ", "</p><ſcript>in</ſcript><p>"]
SAID = [f"<p>{a}{r}{b}</p>" for r, a, b in itertools.product(REFERENCES, AROUND, AROUND)] + [None, "", "<script>a</script>"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """The folder of a table in which every text stands alone and at the end of long lines."""
    folder = str(tmp_path_factory.mktemp("pages"))
    long = [f"<nav>n</nav>{s}<p>{'many words ' * 9}{s[3:]}{'x' * n}{s[3:]}" for n, s in zip(itertools.cycle((30, 41, 90, 2900, 3001, 3900, 4001)), SAID) if s]
    rows = [(i, f"https://a.example/{i % 50}", s) for i, s in enumerate(SAID + long)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def same(spark, duck, folder, name):
    table = f"pages AS (SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet'))"
    sql = oracle_sql()[name]
    same_rows(queries()[name](spark, folder), duck.sql(f"WITH {table}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {table} {sql}"))


def test_html_to_text_decodes_and_strips_what_its_sql_does(spark, duck, pages):
    same(spark, duck, pages, "html_to_text")


def test_page_text_is_cut_as_by_its_sql(spark, duck, pages):
    same(spark, duck, pages, "page_text")


def test_results_hold_pages_as_their_sql_has_them(spark, duck, pages, tmp_path):
    same(spark, duck, pages, "web_results")
    # Ids with gaps: several searches have one page as their first result.
    spark.read.parquet(f"{pages}/pages.parquet").where("page_id > 700").withColumn("page_id", F.expr("3 * (page_id - 701) - page_id % 2")).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries()["web_results"](spark, str(tmp_path)).where("pos = 0 AND page IS NOT NULL")
    assert found.count() > found.select("page").distinct().count() > 0
    same(spark, duck, str(tmp_path), "web_results")


def test_all_references_are_decoded_without_a_list(spark):
    said = "<p>a &quot b &copy; &amp;lt; &amp &eacute; c </p>"
    row = spark.createDataFrame([(said,)], "s string").select(T.html_to_text(F.col("s")).alias("all"), T.html_to_text(F.col("s"), only=[("&amp;", "&")]).alias("one")).first()
    assert row["all"] == html.unescape(said.removeprefix("<p>").removesuffix(" </p>")) and row["one"] == "a &quot b &copy; &lt; &amp &eacute; c"
