"""The batch operators that make sense on a live feed, as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "10 seconds", late: str = "1 minute", key: str = "session_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Stretches of a key without a gap: start, end, count and mean; rows later than the watermark are left out."""
    w = F.session_window(F.col(ts), gap)
    g = events.withWatermark(ts, late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")


def tumbling(events: DataFrame, width: str = "10 seconds", late: str = "1 minute", key: str = "session_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Fixed segments of each key with count and largest value."""
    g = events.withWatermark(ts, late).groupBy(key, F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("largest"))
    return g.select(key, F.col("window.start").alias("start"), "n", "largest")


def keep_spaced(events: DataFrame, least_s: float = 1.0, key: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Rows at least least_s after the last kept row of their key; that time is all the state there is.

    Rows are taken in order within a micro-batch; one older than the last kept
    row is dropped.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(t, kind="stable")
        keep = []
        for x in rows[t]:
            keep.append(x - last >= least_s - 1e-9)
            last = x if keep[-1] else last
        state.update((last,))
        yield rows[keep]

    return events.groupBy(key).applyInPandasWithState(run, events.schema, "last double", "append", GroupStateTimeout.NoTimeout)
