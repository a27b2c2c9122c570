"""Order-dependent analyses of call trails: repeats, patterns, limits, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_args(args: Column) -> Column:
    """JSON with the keys of every object sorted and blanks gone, its types kept; anything else as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(args)), args)


def repeat_alerts(calls: DataFrame, round_col: str = "round", seq: str = "seq", name: str = "name", args: str = "args", most: int = 10, run: int = 3) -> DataFrame:
    """Rounds whose first `most` calls end with `run` identical ones."""
    w = Window.partitionBy(round_col).orderBy(seq)
    kept = calls.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    last = kept.withColumn("_back", F.row_number().over(Window.partitionBy(round_col).orderBy(F.desc(seq)))).where(F.col("_back") <= run)
    same = F.countDistinct(F.struct(F.col(name), canonical_args(F.col(args))))
    return last.groupBy(round_col).agg(F.count("*").alias("_n"), same.alias("_k"), F.max(name).alias("name")).where((F.col("_n") == run) & (F.col("_k") == 1)).select(round_col, "name")


def period_pattern(calls: DataFrame, by: str, seq: str = "seq", name: str = "name", least: int = 6) -> DataFrame:
    """Rows at which the last six names repeat with period 2 or 3; `least` names must have been seen."""
    w = Window.partitionBy(by).orderBy(seq)
    back = [F.lag(name, k).over(w) for k in range(6)]
    two = (back[0] == back[2]) & (back[2] == back[4]) & (back[1] == back[3]) & (back[3] == back[5]) & (back[0] != back[1])
    three = (back[0] == back[3]) & (back[1] == back[4]) & (back[2] == back[5]) & ~two
    rows = calls.withColumn("period", F.when(F.row_number().over(w) < least, None).when(two, 2).when(three, 3))
    return rows.where(F.col("period").isNotNull())


def window_load(events: DataFrame, by: str, ts: str = "ts", seconds: int = 54, limit: int = 3, pause: int = 60) -> DataFrame:
    """Adds n (events of the last `seconds`, before this one) and wait: seconds to hold if there are `limit` of them.

    An analysis of arrivals as they were; see streaming.limits for admission.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-(seconds * 1_000_000) + 1, -1)
    wait = F.when(F.count("*").over(w) >= limit, pause - (at - F.min(at).over(w)) / 1_000_000)
    return events.withColumn("n", F.count("*").over(w)).withColumn("wait", wait)


def min_gap(events: DataFrame, by: str, ts: str = "ts", tie: str = "event_id", seconds: int = 15, most: int = 3) -> DataFrame:
    """Adds blocked (less than `seconds` after the one before) and barred (`most` blocked in a row)."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1_000_000
    rows = events.withColumn("blocked", F.coalesce(gap < seconds, F.lit(False)))
    return run_lengths(rows, by, [ts, tie], "blocked", "_run").withColumn("barred", F.col("_run") >= most).drop("_run")


def run_lengths(rows: DataFrame, by: str, order: list[str], flag: str, out: str) -> DataFrame:
    """Adds how many rows in a row, up to this one, have the flag."""
    w = Window.partitionBy(by).orderBy(*order)
    island = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w)
    rows = rows.withColumn("_island", island)
    inside = Window.partitionBy(by, "_island").orderBy(*order)
    return rows.withColumn(out, F.sum(F.when(F.col(flag), 1).otherwise(0)).over(inside)).drop("_island")


def noops(lists: DataFrame, by: str, order: str, fingerprint: Column, least: int = 2) -> DataFrame:
    """Adds same: how often in a row the fingerprint has been the one before's; noop from `least` on."""
    w = Window.partitionBy(by).orderBy(order)
    rows = lists.withColumn("_f", fingerprint).withColumn("_same", F.coalesce(F.col("_f") == F.lag("_f").over(w), F.lit(False)))
    return run_lengths(rows, by, [order], "_same", "same").withColumn("noop", F.col("same") >= least).drop("_f", "_same")


def seen_before(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds again: whether an earlier row has the same keys."""
    return rows.withColumn("again", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def recently_said(rows: DataFrame, by: str, order: str, text: str, needle: str, last: int = 5) -> DataFrame:
    """Adds recent: whether one of the last rows before this one contains needle."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-last, -1)
    return rows.withColumn("recent", F.coalesce(F.max(F.col(text).contains(needle)).over(w), F.lit(False)))


def cap_rounds(calls: DataFrame, by: str, order: list[str], most: int = 10) -> DataFrame:
    """The first `most` calls of each round, with how many the round loses."""
    w = Window.partitionBy(by)
    rows = calls.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("dropped", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return rows.where(F.col("_i") <= most).drop("_i")
