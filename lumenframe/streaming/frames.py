"""Structured Streaming forms of frame counts and of rest epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_counts(events: DataFrame, ts: str, value: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Count and sum by tumbling frame; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("frame")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def epochs(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with gaps under `gap`."""
    return events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap).alias("epoch")).agg(F.count("*").alias("n"))


def unwrapped(events: DataFrame, key: str, counter: str, modulus: int, order: str) -> DataFrame:
    """events with `ticks`, the counter made to go on over its wraps: each key's last value and number of wraps are the state.

    Within a micro-batch a key's rows are put in order of `order`; rows that come in a later batch count as later.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def step(_, parts, state):
        last, wraps = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for v in rows[counter]:
            wraps += last is not None and v < last
            last = int(v)
            out.append(last + modulus * wraps)
        state.update((last, wraps))
        yield rows.assign(ticks=out)

    some = events.where(F.col(counter).isNotNull())
    return some.groupBy(key).applyInPandasWithState(step, f"{ddl}, ticks long", "last long, wraps long", "append", GroupStateTimeout.NoTimeout)


def flagged(events: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """events with `issues`, a bit for each check, in their order, that a row fails: rows are kept, and what reads them decides."""
    bits = F.lit(0)
    for i, ok in enumerate(checks.values()):
        bits = bits + F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1 << i)
    return events.withColumn("issues", bits)
