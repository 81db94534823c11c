"""Clock anchors: robust lines from one clock to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import timefn


def fit_anchors(anchors: DataFrame, rounds: int = 3, times: float = 5.0, by: str = "session_id") -> DataFrame:
    """slope, xmean, ymean, n, n_rejected, rmse_s, max_abs_s, sxx of each session's anchors (x_ns, y_s).

    Each round leaves out anchors whose residual exceeds times the median
    absolute residual (about zero), unless that is 0 or fewer than two would be
    left. Anchors without x or y don't count; sessions below two anchors give
    no row.
    """
    w = Window.partitionBy(by)
    rows = anchors.where("x_ns IS NOT NULL AND y_s IS NOT NULL").select(by, "x_ns", F.col("y_s").cast("double").alias("y_s"))
    rows = rows.withColumns({"__x0": F.min("x_ns").over(w), "__n0": F.count(F.lit(1)).over(w)}).where("__n0 >= 2")
    rows = rows.withColumn("__dx", (F.col("x_ns") - F.col("__x0")).cast("double"))
    # The line about the means of x relative to the session's first x, which keeps nanoseconds exact; one window serves all rounds.
    line = {"__b": F.regr_slope("y_s", "__dx").over(w), "__xm": F.avg("__dx").over(w), "__ym": F.avg("y_s").over(w)}
    residual = F.col("y_s") - F.col("__ym") - F.col("__b") * (F.col("__dx") - F.col("__xm"))
    for _ in range(rounds):
        judged = rows.withColumns(line).withColumn("__r", F.abs(residual)).withColumn("__mad", F.median("__r").over(w))
        inside = F.col("__r") <= times * F.col("__mad")
        judged = judged.withColumn("__left", F.count_if(inside).over(w))
        rows = judged.where((F.col("__mad") <= 0) | (F.col("__left") < 2) | inside).select(by, "x_ns", "y_s", "__x0", "__n0", "__dx")
    last = rows.withColumns(line).withColumn("__r", residual)
    return last.groupBy(by).agg(
        F.first("__b").alias("slope"),
        (F.first("__xm") + F.first("__x0")).alias("xmean"),
        F.first("__ym").alias("ymean"),
        F.count(F.lit(1)).alias("n"),
        (F.first("__n0") - F.count(F.lit(1))).alias("n_rejected"),
        F.sqrt(F.avg(F.col("__r") ** 2)).alias("rmse_s"),
        F.max(F.abs("__r")).alias("max_abs_s"),
        F.sum((F.col("__dx") - F.col("__xm")) ** 2).alias("sxx"),
    )


def fit_with_fallback(sources: dict[str, DataFrame], rounds: int = 3, times: float = 5.0, by: str = "session_id") -> DataFrame:
    """by, source and fit_anchors()'s columns: each session by the first of the sources (name to anchors, best first) that has a line for it.

    All sources are fitted in one pass over their union, keyed by session and
    source. A session has no row if none of them has two anchors at different x; a source
    whose x are all equal has no slope and doesn't count.
    """
    united = None
    for place, (name, anchors) in enumerate(sources.items()):
        one = anchors.select(F.struct(F.col(by).alias("who"), F.lit(place).alias("place"), F.lit(name).alias("source")).alias("__key"), "x_ns", "y_s")
        united = one if united is None else united.unionByName(one)
    if united is None:
        raise ValueError("no sources")
    fits = fit_anchors(united, rounds, times, "__key").where("slope IS NOT NULL")
    cols = [c for c in fits.columns if c != "__key"]
    best = fits.groupBy(F.col("__key.who").alias(by)).agg(F.min_by(F.struct(F.col("__key.source").alias("source"), *cols), "__key.place").alias("__f"))
    return best.select(by, "__f.*")


def residuals(anchors: DataFrame, fits: DataFrame, by: str = "session_id") -> DataFrame:
    """Every anchor with residual_s and the fit's sigma_s there."""
    rows = anchors.join(fits, by)
    line = timefn.anchor_utc(F.col("x_ns"), F.col("slope"), F.col("xmean"), F.col("ymean"))
    sigma = timefn.anchor_sigma(F.col("x_ns"), F.col("rmse_s"), F.col("n"), F.col("xmean"), F.col("sxx"))
    return rows.select(*anchors.columns, (F.col("y_s") - line).alias("residual_s"), sigma.alias("sigma_s"))


def corrected_times(times: DataFrame, fits: DataFrame, starts: DataFrame, offset_s: float = 0.0, by: str = "session_id") -> DataFrame:
    """times (by, rel_s and any keys) with video_s, naive and anchored times in UTC and GPST, leap_s, correction_s and sigma_s.

    Naive is the video's start (starts: by, start_utc_s) plus the time in it; anchored is the session's fit
    (fit_anchors()) there. A session without a start or a fit keeps its rows with nulls.
    """
    rows = times.join(starts.select(by, F.col("start_utc_s").alias("__start")), by, "left").join(fits.select(by, "slope", "xmean", "ymean", "rmse_s", "n", "sxx"), by, "left")
    rows = rows.withColumn("video_s", F.col("rel_s") + offset_s).withColumn("__ns", F.col("video_s") * 1e9)
    line = timefn.anchor_utc(F.col("__ns"), F.col("slope"), F.col("xmean"), F.col("ymean"))
    rows = rows.withColumns({"naive_utc_s": F.col("__start") + F.col("video_s"), "anchored_utc_s": line})
    leaps = timefn.leap_seconds(F.col("anchored_utc_s"))
    out = {
        "naive_gpst_s": F.col("naive_utc_s") + timefn.leap_seconds(F.col("naive_utc_s")),
        "anchored_gpst_s": F.col("anchored_utc_s") + leaps,
        "leap_s": leaps,
        "correction_s": F.col("anchored_utc_s") - F.col("naive_utc_s"),
        "sigma_s": timefn.anchor_sigma(F.col("__ns"), F.col("rmse_s"), F.col("n"), F.col("xmean"), F.col("sxx")),
    }
    return rows.withColumns(out).select(*times.columns, "video_s", "naive_utc_s", "anchored_utc_s", *out)


def cubic_gain(anchors: DataFrame, by: str = "session_id") -> DataFrame:
    """by, n, linear_rmse_s, cubic_rmse_s: how much better a cubic fits a session's anchors (x_ns, y_s); below five anchors the cubic is null.

    Polynomials orthogonal on the session's own x are built one from another by
    window sums, so nothing is solved and nothing leaves the executors.
    """
    w = Window.partitionBy(by)
    rows = anchors.where("x_ns IS NOT NULL AND y_s IS NOT NULL").select(by, "x_ns", F.col("y_s").cast("double").alias("__y"))
    rows = rows.withColumn("__x", (F.col("x_ns") - F.min("x_ns").over(w)).cast("double"))
    rows = rows.withColumn("__x", F.try_divide(F.col("__x") - F.avg("__x").over(w), F.max("__x").over(w)))
    rows = rows.withColumns({"__p0": F.lit(1.0), "__r": F.col("__y") - F.avg("__y").over(w)})
    for k in range(1, 4):
        p, older = F.col(f"__p{k - 1}"), F.col(f"__p{max(k - 2, 0)}")
        shift = F.try_divide(F.sum(F.col("__x") * p * p).over(w), F.sum(p * p).over(w))
        back = F.try_divide(F.sum(p * p).over(w), F.sum(older * older).over(w)) if k > 1 else F.lit(0.0)
        rows = rows.withColumns({"__s": shift, "__k": back}).withColumn(f"__p{k}", (F.col("__x") - F.col("__s")) * p - F.col("__k") * older)
        part = F.try_divide(F.sum(F.col("__r") * F.col(f"__p{k}")).over(w), F.sum(F.col(f"__p{k}") ** 2).over(w))
        rows = rows.withColumn("__c", F.coalesce(part, F.lit(0.0))).withColumn("__r", F.col("__r") - F.col("__c") * F.col(f"__p{k}"))
        if k == 1:
            rows = rows.withColumn("__linear", F.col("__r"))
    n = F.count(F.lit(1))
    return rows.groupBy(by).agg(n.alias("n"), F.sqrt(F.avg(F.col("__linear") ** 2)).alias("linear_rmse_s"), F.when(n >= 5, F.sqrt(F.avg(F.col("__r") ** 2))).alias("cubic_rmse_s"))


def video_zero(sessions: DataFrame, clip_anchors: DataFrame, manifests: DataFrame, anchors: DataFrame, by: str = "session_id") -> DataFrame:
    """by, t0_ns: when sample 0 of a session's video was, by the least boot_ns of its cut clip, else its manifest (video_t0_boottime_ns), else the least boot_ns of its frames; null for none."""
    least = lambda df, name: df.groupBy(by).agg(F.min("boot_ns").alias(name))
    named = manifests.groupBy(by).agg(F.max("video_t0_boottime_ns").alias("__manifest"))
    rows = sessions.select(by).distinct().join(least(clip_anchors, "__clip"), by, "left").join(named, by, "left").join(least(anchors, "__frames"), by, "left")
    return rows.select(by, F.coalesce("__clip", "__manifest", "__frames").alias("t0_ns"))
