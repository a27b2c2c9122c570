"""Admission under a sliding window: a stateful stream, since what waits shifts what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.streaming import buckets


def admitted(times: list[float], recent: list[float], seconds: float = 54, limit: int = 3, pause: float = 60) -> tuple[list[float], list[float]]:
    """When each request, in order, gets through, and the admissions that still count."""
    out = []
    for t in times:
        t = max(t, recent[-1]) if recent else t
        recent = [x for x in recent if t - x < seconds]
        if len(recent) >= limit:
            t = max(t, recent[0] + pause)
            recent = [x for x in recent if t - x < seconds]
        recent.append(t)
        out.append(t)
    return out, recent[-limit:]


def admit(requests: DataFrame, by: str = "user_id", seconds: float = 54, limit: int = 3, pause: float = 60, lateness: str | None = None) -> DataFrame:
    """(by, event_id, at, admitted) for a stream of (by, event_id, at seconds).

    With lateness, a stream of any length keeps state only of users whose
    admissions still count: `at` is then seconds since 1970, requests that come
    later than that behind the newest are left out, and what is known of a user
    goes once the watermark has passed all that it could hold up.
    """

    def update(user: object, rows: list, recent: list[float] | None, out: list) -> tuple[list[float], int | None]:
        got, recent = admitted([r.at for r in rows], recent or [], seconds, limit, pause)
        out.extend((user, r.event_id, r.at, t) for r, t in zip(rows, got, strict=True))
        return recent, None if lateness is None else int((recent[-1] + max(seconds, pause)) * 1000) + 1

    rows = requests.select(by, "event_id", "at")
    if lateness is not None:
        rows = rows.withColumn("_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("_time", lateness)
    return buckets.fold(rows, by, ["at", "event_id"], "event_id long, at double, admitted double", update, lambda *_: None, None if lateness is None else "event")
