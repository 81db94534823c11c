"""Vehicle constraints: standing still, no sideways motion, and the choice of a filter by session."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import geo
from tracelake.functions.angles import wrap_deg
from tracelake.operators import smoothing
from tracelake.operators.islands import with_runs
from tracelake.operators.motion import ordered


def classify_still(enu: DataFrame, below: float = 0.3, max_dt: float = 4.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """enu with still: Doppler speed below the bar, or without Doppler the centred difference (steps up to max_dt)."""
    w = ordered(by, t)
    de, dn, dt = (F.lead(c).over(w) - F.lag(c).over(w) for c in ("e_m", "n_m", t))
    doppler = F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2)
    moved = F.when((dt > 0) & (dt <= 2 * max_dt), F.sqrt(de * de + dn * dn) / dt)
    return enu.withColumn("still", F.coalesce(F.coalesce(doppler, moved) < below, F.lit(False)))


def hold_still(enu: DataFrame, min_s: float = 2.0, max_spread_m: float = 2.0, min_best: int = 2, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Standing runs (still, quality) snap to the upper median of their best-quality rows and have no velocity.

    A run counts if it lasts min_s, has two rows and spreads at most
    max_spread_m. Adds held; the end of a run is its last standing row.
    """
    rows = with_runs(enu, F.col("still"), by, t)
    best = F.min("quality").over(Window.partitionBy(by, "run_id"))
    rows = rows.withColumn("__best", best).withColumn("__use", F.count_if(F.col("quality") == F.col("__best")).over(Window.partitionBy(by, "run_id")) >= min_best)
    use = ~F.col("__use") | (F.col("quality") == F.col("__best"))
    mid = lambda c: F.try_element_at(F.array_sort(F.collect_list(F.when(use, F.col(c)))), (F.floor(F.count(F.when(use, F.col(c))) / 2) + 1).cast("int"))
    runs = rows.where("still").groupBy(by, "run_id").agg(
        mid("e_m").alias("__e"), mid("n_m").alias("__n"), mid("u_m").alias("__u"), (F.max(t) - F.min(t)).alias("__s"), F.count(F.lit(1)).alias("__c"),
        F.sqrt((F.max("e_m") - F.min("e_m")) ** 2 + (F.max("n_m") - F.min("n_m")) ** 2).alias("__spread"),
    )
    runs = runs.where((F.col("__s") >= min_s) & (F.col("__c") >= 2) & (F.col("__spread") <= max_spread_m)).select(by, "run_id", "__e", "__n", "__u")
    out = rows.join(runs, [by, "run_id"], "left").withColumn("held", F.col("still") & F.col("__e").isNotNull())
    new = {c: F.when(F.col("held"), F.col(m)).otherwise(F.col(c)) for c, m in (("e_m", "__e"), ("n_m", "__n"), ("u_m", "__u"))}
    new |= {c: F.when(F.col("held"), F.lit(0.0)).otherwise(F.col(c)) for c in ("ve", "vn", "vu")}
    return out.withColumns(new).drop("__best", "__use", "__e", "__n", "__u", "run_id")


def no_sideways(enu: DataFrame, min_speed: float = 2.0, max_turn_dps: float = 30.0, smooth_rows: float = 3.0, shrink: float = 0.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """While driving straight enough, sideways velocity goes and the sideways offset from the smoothed path shrinks.

    Heading is the velocity's; rows too slow, turning too fast or without
    heading stay (constrained = false). Up is left alone.
    """
    w = ordered(by, t)
    rows = smoothing.gaussian_rows(enu, ["e_m", "n_m"], smooth_rows, by, t, suffix="_path")
    speed = F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2)
    rows = rows.withColumn("__h", F.when(speed >= min_speed, geo.heading_from_enu(F.col("e_m_path") - F.lag("e_m_path").over(w), F.col("n_m_path") - F.lag("n_m_path").over(w))))
    turn = F.abs(wrap_deg(F.col("__h") - F.lag("__h").over(w))) / (F.col(t) - F.lag(t).over(w))
    rows = rows.withColumn("constrained", F.col("__h").isNotNull() & F.coalesce(turn <= max_turn_dps, F.lit(True)))
    s, c = F.sin(F.radians("__h")), F.cos(F.radians("__h"))
    side_v = F.col("ve") * c - F.col("vn") * s
    side_p = (F.col("e_m") - F.col("e_m_path")) * c - (F.col("n_m") - F.col("n_m_path")) * s
    off = F.col("constrained")
    out = rows.withColumns({"__sv": side_v, "__sp": side_p})
    return out.withColumns(
        {
            "ve": F.when(off, F.col("ve") - (1 - shrink) * F.col("__sv") * c).otherwise(F.col("ve")),
            "vn": F.when(off, F.col("vn") + (1 - shrink) * F.col("__sv") * s).otherwise(F.col("vn")),
            "e_m": F.when(off, F.col("e_m") - (1 - shrink) * F.col("__sp") * c).otherwise(F.col("e_m")),
            "n_m": F.when(off, F.col("n_m") + (1 - shrink) * F.col("__sp") * s).otherwise(F.col("n_m")),
            "side_m": F.when(off, F.col("__sp")),
        }
    ).drop("__h", "__sv", "__sp", "e_m_path", "n_m_path")


def regime(track: DataFrame, poor_pct: float = 30.0, clean_pct: float = 15.0, by: str = "session_id") -> DataFrame:
    """poor (many single solutions), clean (enough fixes) or mixed, for each session."""
    share = lambda q: 100.0 * F.avg((F.col("quality") == q).cast("double"))
    g = track.groupBy(by).agg(share(5).alias("single_pct"), share(1).alias("fix_pct"))
    return g.withColumn("regime", F.when(F.col("single_pct") >= poor_pct, "poor").when(F.col("fix_pct") >= clean_pct, "clean").otherwise("mixed"))


def adaptive(enu: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Each session by its regime: clean ones hold still only, mixed ones are smoothed, poor ones gated to better solutions and smoothed more."""
    rows = enu.join(regime(enu, by=by).select(by, "regime"), by)
    rows = classify_still(rows, by=by, t=t)
    held = hold_still(rows.where("regime = 'clean'"), by=by, t=t).select(by, t, "regime", "e_m", "n_m", "u_m")
    mixed = smoothing.gaussian_rows(rows.where("regime = 'mixed'"), ["e_m", "n_m", "u_m"], 2.0, by, t)
    poor = smoothing.gaussian_rows(rows.where("regime = 'poor' AND quality < 5"), ["e_m", "n_m", "u_m"], 5.0, by, t)
    smooth = [df.select(by, t, "regime", *[F.col(f"{c}_s").alias(c) for c in ("e_m", "n_m", "u_m")]) for df in (mixed, poor)]
    return held.unionByName(smooth[0]).unionByName(smooth[1])


def adaptive_rows(t: np.ndarray, x: np.ndarray, v: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """The places that adaptive() gives one session in order of time (x: east, north, up; v: east, north); rows that it leaves out keep theirs."""
    known, out = ~np.isnan(quality), x.copy()
    share = lambda q: 100.0 * (quality[known] == q).mean() if known.any() else 0.0
    smooth = lambda rows, sigma: smoothing.gaussian_all(np.array([0, len(rows)]), rows, sigma)
    if share(5) >= 30.0:
        better = quality < 5
        if better.any():
            out[better] = smooth(x[better], 5.0)
    elif share(1) < 15.0:
        out = smooth(x, 2.0)
    else:
        out = held_rows(t, x, still_rows(t, x, v), quality)
    return np.where(np.isnan(out), x, out)


def still_rows(t: np.ndarray, x: np.ndarray, v: np.ndarray, below: float = 0.3, max_dt: float = 4.0) -> np.ndarray:
    """classify_still() of one session."""
    moved = np.full(len(t), np.nan)
    dt, way = t[2:] - t[:-2], np.hypot(*(x[2:, :2] - x[:-2, :2]).T)
    moved[1:-1] = np.where((dt > 0) & (dt <= 2 * max_dt), way / np.where(dt > 0, dt, 1.0), np.nan)
    doppler = np.hypot(v[:, 0], v[:, 1])
    return np.where(np.isnan(doppler), moved, doppler) < below


def held_rows(t: np.ndarray, x: np.ndarray, still: np.ndarray, quality: np.ndarray, min_s: float = 2.0, max_spread_m: float = 2.0, min_best: int = 2) -> np.ndarray:
    """hold_still()'s places of one session."""
    out = x.copy()
    begins = np.flatnonzero(still & ~np.append(False, still[:-1]))
    ends = np.flatnonzero(still & ~np.append(still[1:], False)) + 1
    for a, b in zip(begins, ends, strict=True):
        some, q = x[a:b], quality[a:b]
        reach = [np.ptp(c[~np.isnan(c)]) if (~np.isnan(c)).any() else np.nan for c in (some[:, 0], some[:, 1])]
        if b - a < 2 or t[b - 1] - t[a] < min_s or not np.hypot(*reach) <= max_spread_m:
            continue
        best = q == (np.nanmin(q) if (~np.isnan(q)).any() else np.nan)
        used = some[best] if best.sum() >= min_best else some
        middle = [np.sort(c[~np.isnan(c)]) for c in used.T]
        if len(middle[0]):
            out[a:b] = [m[len(m) // 2] if len(m) else np.nan for m in middle]
    return out
