"""As-of joins with public window functions: bracketing, nearest and step.

Queries and samples are put on one timeline and sorted once per session; the
neighbours are the last sample strictly before a query and, looking from the
session's end, the last at or after it. One shuffle and two sorts, no pairs:
both windows carry one row on, so the work is in proportion to the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(queries: DataFrame, samples: DataFrame, cols: list[str], by: str = "session_id", t: str = "utc_s", key: str = "query_id") -> DataFrame:
    """queries with structs lo (t, cols: strictly before) and hi (at or after), null where there is none.

    A query on the first sample has only hi. Samples without a time are left
    out; of equal-time samples, hi is one of them.
    """
    keep = [c for c in queries.columns if c not in (by, t, key)]
    q = queries.select(by, t, F.lit(0).alias("__side"), F.struct(key, *keep).alias("__q"), F.lit(None).cast(samples.select(F.struct(t, *cols)).schema[0].dataType).alias("__s"))
    s = samples.where(F.col(t).isNotNull()).select(by, t, F.lit(1).alias("__side"), F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), F.struct(F.col(t).alias(t), *cols).alias("__s"))
    # At equal times a query comes before samples, so that they are its hi and never its lo.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    lo = F.last("__s", ignorenulls=True).over(Window.partitionBy(by).orderBy(t, "__side").rowsBetween(*so_far))
    hi = F.last("__s", ignorenulls=True).over(Window.partitionBy(by).orderBy(F.desc(t), F.desc("__side")).rowsBetween(*so_far))
    both = q.unionByName(s).withColumn("lo", lo).withColumn("hi", hi)
    return both.where("__side = 0").select(by, t, "__q.*", "lo", "hi")


def within_gap(t: str = "utc_s", max_gap: float = 2.0) -> Column:
    """Whether a bracketed query may be interpolated: both neighbours known, the bracket no longer than the gap.

    A query exactly on the first sample is fine; on an inner one the gap before it counts.
    """
    lo, hi = F.col(f"lo.{t}"), F.col(f"hi.{t}")
    return F.when(lo.isNotNull() & hi.isNotNull(), hi - lo <= max_gap).otherwise(F.coalesce(hi == F.col(t), F.lit(False)))


def interpolated(bracketed: DataFrame, cols: list[str], t: str = "utc_s", max_gap: float = 2.0) -> DataFrame:
    """Linear interpolation of cols between lo and hi; null where within_gap() says no."""
    lo, hi = F.col(f"lo.{t}"), F.col(f"hi.{t}")
    f = F.when(lo.isNull() | (hi == lo), F.lit(1.0)).otherwise((F.col(t) - lo) / (hi - lo))
    value = {c: F.when(within_gap(t, max_gap), F.when(lo.isNull(), F.col(f"hi.{c}")).otherwise(F.col(f"lo.{c}") + (F.col(f"hi.{c}") - F.col(f"lo.{c}")) * f)) for c in cols}
    return bracketed.withColumns(value)


def nearest(bracketed: DataFrame, cols: list[str], t: str = "utc_s", tolerance: float | None = None, tie: str = "earlier") -> DataFrame:
    """cols of the nearer neighbour and its distance dt_s (signed, sample minus query)."""
    before, after = F.col(t) - F.col(f"lo.{t}"), F.col(f"hi.{t}") - F.col(t)
    first = before <= after if tie == "earlier" else before < after
    left = F.when(F.col("hi").isNull(), F.col("lo").isNotNull()).when(F.col("lo").isNull(), False).otherwise(first)
    gap = F.when(left, before).otherwise(after)
    ok = gap.isNotNull() if tolerance is None else gap <= tolerance
    out = {c: F.when(ok, F.when(left, F.col(f"lo.{c}")).otherwise(F.col(f"hi.{c}"))) for c in cols}
    return bracketed.withColumns(out | {"dt_s": F.when(ok, F.when(left, -before).otherwise(after))})


def step(queries: DataFrame, samples: DataFrame, cols: list[str], by: str = "session_id", t: str = "utc_s", key: str = "query_id") -> DataFrame:
    """cols of the latest sample at or before the query."""
    found = bracket(queries, samples, cols, by, t, key)
    same = F.col(f"hi.{t}") == F.col(t)
    return found.withColumns({c: F.when(same, F.col(f"hi.{c}")).otherwise(F.col(f"lo.{c}")) for c in cols})
