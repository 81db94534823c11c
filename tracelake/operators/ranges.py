"""Band and interval joins over time buckets: equality on session and bucket, then the exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, width: float, t: str = "utc_s", by: str = "session_id", strict: bool = True) -> DataFrame:
    """All pairs of one session whose times differ by less than width (or by it too).

    Buckets are as wide as the band, so only the right side is tripled. Columns
    of the right side get the suffix _r. Neither side is ever broadcast: by its compressed bytes a long
    one can look small, and the driver would have to hold it.
    """
    r = right.select([F.col(c).alias(f"{c}_r") for c in right.columns])
    r = r.withColumn("__bucket", F.explode(F.array(*[F.floor(F.col(f"{t}_r") / width) + k for k in (-1, 0, 1)])))
    lhs = left.withColumn("__bucket", F.floor(F.col(t) / width))
    gap = F.abs(F.col(t) - F.col(f"{t}_r"))
    pairs = lhs.join(r.hint("merge"), (F.col(by) == F.col(f"{by}_r")) & (lhs["__bucket"] == r["__bucket"]))
    return pairs.where(gap < width if strict else gap <= width).select(*left.columns, *[f"{c}_r" for c in right.columns])


def interval_join(points: DataFrame, intervals: DataFrame, bucket_s: float = 60.0, t: str = "utc_s", by: str = "session_id", start: str = "start_s", end: str = "end_s", how: str = "inner") -> DataFrame:
    """Points within [start, end] of an interval of their session; intervals are dealt to every bucket that they touch."""
    cols = [c for c in intervals.columns if c != by]
    wide = intervals.select(F.col(by).alias("__by"), *cols, F.explode(F.sequence(F.floor(F.col(start) / bucket_s), F.floor(F.col(end) / bucket_s))).alias("__bucket"))
    lhs = points.withColumn("__at", F.floor(F.col(t) / bucket_s))
    inside = (F.col(by) == F.col("__by")) & (F.col("__at") == F.col("__bucket")) & F.col(t).between(F.col(start), F.col(end))
    return lhs.join(wide, inside, how).drop("__by", "__bucket", "__at")


def common_times(long: DataFrame, key: str, t: str = "utc_s", by: str = "session_id") -> DataFrame:
    """Rows at times that every key of the session has."""
    keys = long.groupBy(by).agg(F.count_distinct(key).alias("__keys"))
    times = long.groupBy(by, t).agg(F.count_distinct(key).alias("__here"))
    full = times.join(keys, by).where("__here = __keys").select(by, t)
    return long.join(full, [by, t], "left_semi")
