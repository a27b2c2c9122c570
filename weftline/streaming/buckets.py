"""State of many keys by bucket: a bucket's keys share one call of Python and one row of state, so that a key costs a loop's turn."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A call holds a bucket's rows of one batch and its open keys: this part of all.
BUCKETS = 1024
CLOCKS = {"event": GroupStateTimeout.EventTimeTimeout, "processing": GroupStateTimeout.ProcessingTimeTimeout, None: GroupStateTimeout.NoTimeout}

#: (key, its rows in order, what is kept of it, out) to what to keep and until when (in ms; from now on by the processing clock); None to forget it.
Update = Callable[[object, list, object, list], tuple[object, int | None] | None]
#: (key, what is kept of it, out), of a key that nothing has come for until then.
Expire = Callable[[object, object, list], None]


def fold(rows: DataFrame, by: str, order: list[str], out: str, update: Update, expire: Expire, clock: str | None = "event") -> DataFrame:
    """What update and expire append to out, (by, out...) each, for a stream of rows.

    Kept values are what JSON can hold. A key's time is over once the clock has passed it and
    nothing has come for the key in that batch, as with a timer of its own.
    """
    kind = rows.schema[by].dataType.simpleString()
    names = [c for c in rows.columns if c != by]
    # As a string, since a column of numbers with a null would become one of floats.
    keyed = rows.select(F.pmod(F.xxhash64(by), F.lit(BUCKETS)).alias("_bucket"), F.col(by).cast("string").alias("_key"), *names)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {k: (value, until) for k, value, until in json.loads(state.get[0])} if state.exists else {}
        now = 0 if clock is None else state.getCurrentWatermarkMs() if clock == "event" else state.getCurrentProcessingTimeMs()
        got, touched = [], set()
        if not state.hasTimedOut:
            lines = pd.concat(list(batches)).sort_values(order)
            own: dict = {}
            for row in lines.itertuples(index=False, name="Row"):
                own.setdefault(row.key, []).append(row)
            for key, mine in own.items():
                new = update(key, mine, kept.get(key, (None, None))[0], got)
                touched.add(key)
                if new is None:
                    kept.pop(key, None)
                else:
                    kept[key] = (new[0], None if new[1] is None else new[1] + (now if clock == "processing" else 0))
        if clock is not None:
            for key in [k for k, (_, until) in kept.items() if until < now and k not in touched]:
                expire(key, kept.pop(key)[0], got)
        if kept:
            state.update((json.dumps([(k, value, until) for k, (value, until) in kept.items()]),))
            if clock is not None:
                first = min(until for _, until in kept.values())
                if clock == "event":
                    state.setTimeoutTimestamp(max(first, now + 1))
                else:
                    state.setTimeoutDuration(max(1, first - now))
        elif state.exists:
            state.remove()
        if got:
            yield pd.DataFrame(got, columns=columns)

    columns = [by, *(c.split()[0] for c in out.split(", "))]
    keyed = keyed.withColumnRenamed("_key", "key")
    found = keyed.groupBy("_bucket").applyInPandasWithState(step, f"`{by}` string, {out}", "open string", "append", CLOCKS[clock])
    return found.withColumn(by, F.col(by).cast(kind))
