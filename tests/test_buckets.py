"""Streams of many keys: state and calls of Python grow with buckets, not with keys, and each key's results stay its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.streaming import buckets, limits, live


def ran(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/k").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_users_share_the_state_of_buckets(spark, tmp_path):
    """Ids near 2^62, and none, of which every second comes again in a later run."""
    user = F.when(F.col("id") % 2000 != 7, F.col("id") % 2000 + F.lit(2**62))
    rows = spark.range(8000).select(user.alias("user_id"), F.col("id").alias("event_id"), (F.col("id") / 2000 + 1000).cast("double").alias("at"))
    for lot in (rows.where("event_id < 4000"), rows.where("event_id >= 4000 AND event_id % 2 = 1")):
        lot.write.mode("append").parquet(f"{tmp_path}/in")
        kept = ran(limits.admit(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), seconds=54, limit=2, pause=60, lateness="0 seconds"), tmp_path)
        assert 0 < kept <= buckets.BUCKETS
    got: dict = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("event_id").collect():
        got.setdefault(r.user_id, []).append((r.at, r.admitted))
    assert len(got) == 2000 and None in got and min(k for k in got if k) == 2**62
    assert all([t for _, t in x] == limits.admitted([at for at, _ in x], [], 54, 2, 60)[0] for x in got.values())
    assert sum(map(len, got.values())) == 6000


def test_streams_share_the_state_of_buckets(spark, tmp_path):
    """Streams of which every third ends, every third goes on in time and the others pause for too long."""
    rows = spark.range(9000).select((F.col("id") % 3000).alias("stream_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.when((F.col("id") % 3 == 2) & (F.col("id") >= 3000), 1100).otherwise(1000) + F.floor(F.col("id") / 3000)).alias("at"))
    line = F.when((F.col("seq") % 3 == 0) & (F.col("seq") >= 6000), "data: [DONE]").otherwise('data: {"choices":[{"delta":{"content":"x"}}]}')
    rows = rows.withColumn("line", line)
    last = rows.limit(1).select(F.lit(-1).cast("long").alias("stream_id"), F.lit(-1).cast("long").alias("seq"), F.lit("2030-01-01").cast("timestamp").alias("at"), F.lit(": ping").alias("line"))
    kept = []
    for lot in (rows.where("seq < 3000"), rows.where("seq >= 3000"), last):
        lot.write.mode("append").parquet(f"{tmp_path}/in")
        kept.append(ran(live.fold_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), seconds=10), tmp_path))
    assert 0 < kept[0] <= buckets.BUCKETS and kept[2] == 0
    out = {(r.stream_id, r.first): (r.last, r.content, r.interrupted) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(i, i): (i, "x", True) if i % 3 == 2 else (i + 6000, "xx" if i % 3 == 0 else "xxx", i % 3 == 1) for i in range(3000)}
    assert out == want | {(i, i + 3000): (i + 6000, "xx", True) for i in range(2, 3000, 3)}
