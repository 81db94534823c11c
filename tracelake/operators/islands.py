"""Gaps and islands: runs of equal state in a session's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(by: str = "session_id", t: str = "utc_s") -> Window:
    return Window.partitionBy(by).orderBy(t)


def with_runs(df: DataFrame, state: Column, by: str = "session_id", t: str = "utc_s", name: str = "run_id") -> DataFrame:
    """df with the number (from 1) of the run of equal state that the row is in; nulls equal nulls."""
    w = ordered(by, t)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~state.eqNullSafe(F.lag(state).over(w))).cast("int"))
    return df.withColumn("__new", changed).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def split_at_gaps(df: DataFrame, gap_s: float | Column, by: str = "session_id", t: str = "utc_s", name: str = "segment_id") -> DataFrame:
    """df with the number of the segment between time gaps longer than gap_s."""
    w = ordered(by, t)
    new = (F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0)) > gap_s).cast("int")
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1).drop("__new")


def static_periods(track: DataFrame, max_speed: float = 0.4, min_s: float = 1.5, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Runs of horizontal speed below max_speed of at least min_s; the end is the first moving epoch (or the last row)."""
    slow = F.sqrt(F.col("vn") ** 2 + F.col("ve") ** 2) < max_speed
    w = ordered(by, t)
    rows = with_runs(track.withColumn("__slow", F.coalesce(slow, F.lit(False))), F.col("__slow"), by, t).withColumn("__next", F.coalesce(F.lead(t).over(w), F.col(t)))
    runs = rows.where("__slow").groupBy(by, "run_id").agg(F.min(t).alias("start_s"), F.max("__next").alias("end_s"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("end_s") - F.col("start_s") >= min_s).select(by, "start_s", "end_s", "n")


def coverage(track: DataFrame, max_gap: float = 10.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """The longest stretch of each session without a gap above max_gap; the first of equals."""
    segments = split_at_gaps(track, max_gap, by, t).groupBy(by, "segment_id").agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(by).orderBy(F.desc(F.col("end_s") - F.col("start_s")), "start_s")
    return segments.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "segment_id")


def colored_segments(track: DataFrame, state: str = "quality", by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Rows by run of equal state, each run led by the last row of the run before (the bridge)."""
    runs = with_runs(track, F.col(state), by, t)
    w = ordered(by, t)
    last = runs.withColumn("__next", F.lead("run_id").over(w)).withColumn("__color", F.lead(state).over(w)).where("__next > run_id")
    bridge = last.withColumn("run_id", F.col("__next")).withColumn(state, F.col("__color")).drop("__next", "__color").withColumn("bridge", F.lit(True))
    return runs.withColumn("bridge", F.lit(False)).unionByName(bridge)


def bridge_bad_runs(flagged: DataFrame, bad: str, cols: list[str], max_rows: int = 10, max_s: float = 12.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Repairs short runs of bad rows, marks long ones to drop.

    outcome: kept; repaired (at most max_rows rows and max_s from good neighbour
    to good neighbour, cols linear in time); dropped. gap marks the first good
    row after a dropped run.
    """
    w = ordered(by, t)
    rows = with_runs(flagged, F.col(bad), by, t)
    good = F.when(~F.col(bad), F.struct(t, *cols))
    # Both windows carry the last good row on; the second one runs from the session's end.
    rows = rows.withColumn("__lo", F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__hi", F.last(good, ignorenulls=True).over(Window.partitionBy(by).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, -1)))
    n = F.count(F.lit(1)).over(Window.partitionBy(by, "run_id"))
    rows = rows.withColumn("__n", n)
    short = (F.col("__n") <= max_rows) & (F.col(f"__hi.{t}") - F.col(f"__lo.{t}") <= max_s)
    outcome = F.when(~F.col(bad), "kept").when(F.coalesce(short, F.lit(False)), "repaired").otherwise("dropped")
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - F.col(f"__lo.{t}")) / (F.col(f"__hi.{t}") - F.col(f"__lo.{t}"))))
    rows = rows.withColumn("outcome", outcome)
    rows = rows.withColumns({c: F.when(F.col("outcome") == "repaired", F.col(f"__lo.{c}") + (F.col(f"__hi.{c}") - F.col(f"__lo.{c}")) * f).otherwise(F.col(c)) for c in cols})
    gap = (F.col("outcome") == "kept") & (F.lag("outcome").over(w) == "dropped")
    return rows.withColumn("gap", F.coalesce(gap, F.lit(False))).drop("__lo", "__hi", "__n", "run_id")


def dropped_sections(verdicts: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """One row for each run of dropped epochs."""
    runs = with_runs(verdicts, F.col("outcome") == "dropped", by, t).where("outcome = 'dropped'")
    return runs.groupBy(by, "run_id").agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count(F.lit(1)).alias("n")).drop("run_id")
