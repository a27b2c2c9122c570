import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def normal(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) else str(v).replace("+00:00", "")


def same_rows(df, relation):
    """Spark's rows and DuckDB's, sorted, by column name."""
    names = sorted(df.columns)
    columns = list(relation.columns)
    assert sorted(columns) == names
    a = sorted(([normal(r[n]) for n in names] for r in df.collect()), key=str)
    b = sorted(([normal(dict(zip(columns, r, strict=True))[n]) for n in names] for r in relation.fetchall()), key=str)
    assert a == b
