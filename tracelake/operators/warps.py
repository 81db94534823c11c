"""Clocks against truth: offsets by search over all lags at once, and monotone warps from control points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import asof

CURVE = ("e", "n")


def hermite(track: DataFrame, cols: tuple[str, ...], by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """One row for each step of a track: t0, t1 and the cubic of each column in (t - t0), with the slopes of the parabola through three neighbours (one-sided at ends).

    Rows without a time or a value are left out; of repeated times one counts.
    """
    clean = track.dropna(subset=[t, *cols]).groupBy(by, t).agg(*[F.first(c).alias(c) for c in cols])
    w = Window.partitionBy(by).orderBy(t)
    h0, h1 = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    rows = clean
    for c in cols:
        d0, d1 = (F.col(c) - F.lag(c).over(w)) / h0, (F.lead(c).over(w) - F.col(c)) / h1
        rows = rows.withColumn(f"__m_{c}", F.coalesce((d0 * h1 + d1 * h0) / (h0 + h1), d1, d0))
    h = F.col("t1") - F.col("t0")
    rows = rows.withColumns({"t0": F.col(t), "t1": F.lead(t).over(w)} | {f"__n_{c}": F.lead(c).over(w) for c in cols} | {f"__k_{c}": F.lead(f"__m_{c}").over(w) for c in cols}).where("t1 IS NOT NULL")
    out = []
    for c in cols:
        slope = (F.col(f"__n_{c}") - F.col(c)) / h
        out += [F.col(c).alias(f"{c}_0"), F.col(f"__m_{c}").alias(f"{c}_1"), ((3 * slope - 2 * F.col(f"__m_{c}") - F.col(f"__k_{c}")) / h).alias(f"{c}_2"), ((F.col(f"__m_{c}") + F.col(f"__k_{c}") - 2 * slope) / (h * h)).alias(f"{c}_3")]
    return rows.select(by, "t0", "t1", *out)


def lag_costs(track: DataFrame, truth: DataFrame, lags: DataFrame, max_step: float = 2.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, lag_s, n, cost_m: root of the mean squared distance of track (e_m, n_m) from truth (gt_e, gt_n) at t + lag, for every lag (by, lag_s) of each session.

    Truth is a cubic through its rows, unknown over steps longer than max_step. All lags are asked for in one as-of
    join; a row and a lag make one query, so the work is rows times lags of the session.
    """
    curve = hermite(truth.select(by, t, F.col("gt_e").alias("e"), F.col("gt_n").alias("n")), CURVE, by, t)
    cols = [f"{c}_{k}" for c in CURVE for k in range(4)]
    asked = track.dropna(subset=[t, "e_m", "n_m"]).join(lags, by).select(by, (F.col(t) + F.col("lag_s")).alias(t), F.monotonically_increasing_id().alias("query_id"), "lag_s", "e_m", "n_m")
    at = asof.step(asked, curve.withColumn(t, F.col("t0")), ["t0", "t1", *cols], by, t)
    s = F.col(t) - F.col("t0")
    value = {c: F.col(f"{c}_0") + s * (F.col(f"{c}_1") + s * (F.col(f"{c}_2") + s * F.col(f"{c}_3"))) for c in CURVE}
    off = (F.col("e_m") - value["e"]) ** 2 + (F.col("n_m") - value["n"]) ** 2
    inside = (F.col(t) <= F.col("t1")) & (F.col("t1") - F.col("t0") <= max_step)
    return at.where(inside).groupBy(by, "lag_s").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(off)).alias("cost_m"))


def time_offset(track: DataFrame, truth: DataFrame, reach: float = 2.0, steps: tuple[float, ...] = (0.25, 0.025, 0.0025), least_share: float = 0.5, max_step: float = 2.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, lag_s, cost_m, n: what must be added to the track's times to bring it nearest to truth, within reach, from a coarse to a fine grid.

    Each grid covers the step of the one before around its best. A lag counts where truth is known for
    least_share of the most rows that any lag of the session has; ties go to the smaller size of lag, then to the
    earlier. Sessions without truth have no row.
    """
    best = None
    for i, step in enumerate(steps):
        n = round((reach if i == 0 else steps[i - 1]) / step)
        grid = F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("__g")
        if best is None:
            lags = track.select(by).distinct().select(by, grid).select(by, (F.col("__g") * step).alias("lag_s"))
        else:
            lags = best.select(by, F.col("lag_s").alias("__mid"), grid).select(by, F.round(F.col("__mid") + F.col("__g") * step, 9).alias("lag_s"))
        costs = lag_costs(track, truth, lags, max_step, by, t)
        costs = costs.withColumn("__most", F.max("n").over(Window.partitionBy(by))).where(F.col("n") >= least_share * F.col("__most"))
        first = F.min(F.struct(F.round("cost_m", 9).alias("cost_m"), F.abs("lag_s").alias("__size"), "lag_s", "n")).alias("b")
        best = costs.groupBy(by).agg(first).select(by, "b.lag_s", "b.cost_m", "b.n")
    return best


def stretch(queries: DataFrame, points: DataFrame, source: str = "from_s", target: str = "to_s", out: str = "warped_s", by: str = "session_id", t: str = "utc_s", key: str = "query_id") -> DataFrame:
    """queries with their time mapped by the session's control points (source to target): lines between neighbours, carried on at the ends.

    The warp must not run backwards: a point whose target isn't beyond all
    earlier ones' (in order of source) is left out, as are points with a missing
    part; of repeated sources the least target counts. With one point the map is a shift, with none the time is unknown.
    """
    clean = points.dropna(subset=[source, target]).groupBy(by, source).agg(F.min(target).alias(target))
    w = Window.partitionBy(by).orderBy(source)
    ahead = F.max(target).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = clean.withColumn("__ahead", ahead).where(F.col("__ahead").isNull() | (F.col(target) > F.col("__ahead"))).drop("__ahead")
    # Each point carries the slope after it; before the first, that of the first step.
    rise = (F.lead(target).over(w) - F.col(target)) / (F.lead(source).over(w) - F.col(source))
    before = (F.col(target) - F.lag(target).over(w)) / (F.col(source) - F.lag(source).over(w))
    sloped = kept.withColumns({"__rise": F.coalesce(rise, before, F.lit(1.0)), "__from": F.col(source), "__to": F.col(target)}).withColumn(t, F.col(source))
    found = asof.bracket(queries, sloped.select(by, t, "__from", "__to", "__rise"), ["__from", "__to", "__rise"], by, t, key)
    own = F.when((F.col(f"hi.{t}") == F.col(t)) | F.col("lo").isNull(), F.col("hi")).otherwise(F.col("lo"))
    return found.withColumn("__p", own).withColumn(out, F.col("__p.__to") + (F.col(t) - F.col("__p.__from")) * F.col("__p.__rise")).drop("lo", "hi", "__p")
