"""Local coordinates, steps, speeds and headings along a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import geo
from tracelake.functions.angles import wrap_deg


def ordered(by: str = "session_id", t: str = "utc_s") -> Window:
    return Window.partitionBy(by).orderBy(t)


def over_range(aggregate: str, before: float, after: float | None = None, by: str = "session_id", t: str = "utc_s") -> Column:
    """A SQL aggregate over the rows within a span of a DOUBLE time (the DataFrame API takes whole numbers only)."""
    span = f"{before!r}D PRECEDING AND {before if after is None else after!r}D FOLLOWING"
    return F.expr(f"{aggregate} OVER (PARTITION BY {by} ORDER BY {t} RANGE BETWEEN {span})")


def with_enu(track: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track with e_m, n_m, u_m about the first row of its session."""
    w = ordered(by, t)
    ref = tuple(F.first(c).over(w) for c in ("lat_deg", "lon_deg", "h_m"))
    rows = track.withColumns(dict(zip(("__la", "__lo", "__h"), ref, strict=True)))
    e, n, u = geo.llh_to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"), (F.col("__la"), F.col("__lo"), F.col("__h")))
    return rows.withColumns({"e_m": e, "n_m": n, "u_m": u}).drop("__la", "__lo", "__h")


def steps(enu: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """enu with dt_s, step_m, speed_mps (horizontal) and climb_mps from the row before; null on the first row and for dt <= 0."""
    w = ordered(by, t)
    d = {c: F.col(c) - F.lag(c).over(w) for c in (t, "e_m", "n_m", "u_m", "h_m")}
    rows = enu.withColumns({"dt_s": d[t], "step_m": F.sqrt(d["e_m"] ** 2 + d["n_m"] ** 2), "__dh": d["h_m"]})
    ok = F.col("dt_s") > 0
    return rows.withColumns({"speed_mps": F.when(ok, F.col("step_m") / F.col("dt_s")), "climb_mps": F.when(ok, F.abs("__dh") / F.col("dt_s"))}).drop("__dh")


def derived_velocity(enu: DataFrame, max_dt: float = 10.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """enu with cve, cvn, cvu: central differences, one-sided at ends, null across holes."""
    w = ordered(by, t)
    out: dict[str, Column] = {}
    before, after = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    has_b, has_a = F.coalesce(before.between(1e-9, max_dt), F.lit(False)), F.coalesce(after.between(1e-9, max_dt), F.lit(False))
    for c, name in (("e_m", "cve"), ("n_m", "cvn"), ("u_m", "cvu")):
        lag, lead = F.lag(c).over(w), F.lead(c).over(w)
        out[name] = F.when(has_b & has_a, (lead - lag) / (before + after)).when(has_a, (lead - F.col(c)) / after).when(has_b, (F.col(c) - lag) / before)
    return enu.withColumns(out)


def doppler_heading(track: DataFrame, min_speed: float = 0.5) -> DataFrame:
    speed = F.sqrt(F.col("vn") ** 2 + F.col("ve") ** 2)
    return track.withColumn("heading_deg", F.when(speed >= min_speed, geo.heading_from_enu(F.col("ve"), F.col("vn"))))


def coordinate_heading(enu: DataFrame, min_speed: float = 0.5, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Heading of the centred difference where it is fast enough."""
    w = ordered(by, t)
    de, dn, dt = (F.lead(c).over(w) - F.lag(c).over(w) for c in ("e_m", "n_m", t))
    return enu.withColumns({"__de": de, "__dn": dn, "__dt": dt}).withColumn("heading_deg", F.when(F.sqrt(F.col("__de") ** 2 + F.col("__dn") ** 2) >= min_speed * F.col("__dt"), geo.heading_from_enu(F.col("__de"), F.col("__dn")))).drop("__de", "__dn", "__dt")


def unwrap_deg(df: DataFrame, col: str, name: str, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Continuous angle: the first value plus the running sum of wrapped steps (rows with a value)."""
    w = ordered(by, t)
    known = df.where(F.col(col).isNotNull()).withColumn("__d", F.coalesce(wrap_deg(F.col(col) - F.lag(col).over(w)), F.lit(0.0))).withColumn("__first", F.first(col).over(w))
    return known.withColumn(name, F.col("__first") + F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__d", "__first")


def rates(df: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """(n - 1) / span, and 1 / median step, for each session."""
    w = ordered(by, t)
    rows = df.withColumn("__dt", F.col(t) - F.lag(t).over(w))
    span = F.max(t) - F.min(t)
    return rows.groupBy(by).agg(F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("mean_rate_hz"), (1.0 / F.median(F.when(F.col("__dt") > 0, F.col("__dt")))).alias("median_rate_hz"))


def windowed_slope_velocity(enu: DataFrame, half_s: float = 2.0, sigma: float = 3.0, cols: tuple[str, ...] = ("e_m", "n_m", "u_m"), by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Least-squares slope of each col in time over +-half_s (at least 3 rows), and its sigma for rows of the given sigma."""
    rows = enu.withColumn("__t", F.col(t) - F.first(t).over(ordered(by, t)))
    near = lambda agg: over_range(agg, half_s, by=by, t=t)
    rows = rows.withColumns({"__n": near("count(__t)"), "__tc": near("avg(__t)"), "__sxx": near("regr_sxx(__t, __t)")})
    ok = (F.col("__n") >= 3) & (F.col("__sxx") > 1e-12)
    out = {f"v_{c[0]}": F.when(ok, near(f"regr_sxy({c}, __t)") / F.col("__sxx")) for c in cols}
    rows = rows.withColumns(out | {"v_sigma": F.when(ok, sigma / F.sqrt("__sxx"))})
    return rows.drop("__t", "__n", "__tc", "__sxx")


def trajectory_yaw(enu: DataFrame, half_s: float = 2.0, least_m: float = 1.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """yaw_deg from the first to the last place within half_s either way; null if both lie on one side or too close together."""
    ends = {c: (over_range(f"first({c})", half_s, by=by, t=t), over_range(f"last({c})", half_s, by=by, t=t)) for c in ("e_m", "n_m", t)}
    rows = enu.withColumns({"__e0": ends["e_m"][0], "__e1": ends["e_m"][1], "__n0": ends["n_m"][0], "__n1": ends["n_m"][1], "__t0": ends[t][0], "__t1": ends[t][1]})
    de, dn = F.col("__e1") - F.col("__e0"), F.col("__n1") - F.col("__n0")
    ok = (F.col("__t0") < F.col(t)) & (F.col("__t1") > F.col(t)) & (F.sqrt(de * de + dn * dn) >= least_m)
    return rows.withColumn("yaw_deg", F.when(ok, geo.heading_from_enu(de, dn))).drop("__e0", "__e1", "__n0", "__n1", "__t0", "__t1")


def step_stops(stepped: DataFrame, below: float = 0.5, min_s: float = 1.5, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Runs of slow steps of at least min_s: from the row before the first slow step to the last slow row."""
    from tracelake.operators.islands import with_runs

    rows = stepped.withColumn("__before", F.lag(t).over(ordered(by, t))).withColumn("__slow", F.coalesce(F.col("speed_mps") < below, F.lit(False)))
    runs = with_runs(rows, F.col("__slow"), by, t).where("__slow").groupBy(by, "run_id").agg(F.min("__before").alias("start_s"), F.max(t).alias("end_s"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("end_s") - F.col("start_s") >= min_s).drop("run_id")


def sideways_weight(enu: DataFrame, sigma_m: float, smooth_rows: float, min_speed: float, chord_rows: int = 1, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """enu with side_m and side_weight: exp(-side**2 / 2 sigma**2) of how far an epoch lies beside its smoothed path.

    smooth_rows and chord_rows are the smoothing time and about a second in rows
    of the sessions' usual step; the path's direction is the chord of chord_rows
    either way, cut at the ends. Slow epochs (Doppler speed, else the chord's)
    have weight 1 and no side_m.
    """
    from tracelake.operators.smoothing import gaussian_rows

    w = ordered(by, t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = gaussian_rows(enu, ["e_m", "n_m"], smooth_rows, by, t, suffix="_path")
    chord = {c: F.coalesce(F.lead(c, chord_rows).over(w), F.last(c).over(whole)) - F.coalesce(F.lag(c, chord_rows).over(w), F.first(c).over(whole)) for c in ("e_m_path", "n_m_path", t)}
    rows = rows.withColumns({"__de": chord["e_m_path"], "__dn": chord["n_m_path"], "__dt": chord[t]})
    span = F.when(F.col("__dt") > 1e-9, F.col("__dt")).otherwise(1.0)
    fe, fn = F.col("__de") / span, F.col("__dn") / span
    speed = F.sqrt(fe * fe + fn * fn)
    size = F.when(speed > 1e-6, speed).otherwise(1.0)
    side = ((F.col("e_m") - F.col("e_m_path")) * fn - (F.col("n_m") - F.col("n_m_path")) * fe) / size
    active = F.coalesce(F.sqrt(F.col("vn") ** 2 + F.col("ve") ** 2), speed) >= min_speed
    rows = rows.withColumn("side_m", F.when(active, side))
    weight = F.when(F.col("side_m").isNotNull(), F.exp(-((F.col("side_m") / sigma_m) ** 2) / 2)).otherwise(1.0)
    return rows.withColumn("side_weight", weight).select(*enu.columns, "side_m", "side_weight")


def places_on_track(frames: DataFrame, enu: DataFrame, max_m: float = 25.0, cell_m: float = 100.0, by: str = "session_id", t: str = "utc_s", key: str = "frame") -> DataFrame:
    """by, key, utc_s, off_m: when a track was nearest to each frame's place (fe_m, fn_m), between its epochs too.

    The nearest epoch's two segments are looked at; frames farther than max_m
    from them have no row. Epochs meet frames through square cells: those within
    cell_m of a frame are always seen, so cell_m must exceed max_m plus half of
    the longest step that counts. Frames and epochs shuffle once and meet within
    their session's task, so that neither copies of frames nor pairs are shuffled or sorted.
    """
    from tracelake.operators.kernels import nearest_in_cells, per_sessions_with

    chosen = [f"__{c}{k}" for k in ("", "0", "1") for c in "ent"]

    def meet(rows: pd.DataFrame, cuts: np.ndarray, epochs: pd.DataFrame, epoch_cuts: np.ndarray) -> dict[str, np.ndarray]:
        session = np.repeat(np.arange(len(cuts) - 1), np.diff(epoch_cuts))
        # Epochs without a time come first, as in a window; those of one time by their place.
        track = epochs[["e_m", "n_m", t]].to_numpy(float)
        track = track[np.lexsort((track[:, 1], track[:, 0], np.nan_to_num(track[:, 2], nan=-np.inf), session))]
        places = rows[["fe_m", "fn_m"]].to_numpy(float)
        best, d2 = nearest_in_cells(places, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), track[:, :2], session, cell_m)
        # Of frames with one key the nearest counts, as one frame.
        twice = rows.duplicated([by, key], keep=False).to_numpy() & (best >= 0)
        if twice.any():
            at = np.flatnonzero(twice)
            at = at[np.lexsort((*places[at].T[::-1], np.nan_to_num(track[best[at], 2], nan=-np.inf), d2[at]))]
            best[at[rows.iloc[at].duplicated([by, key]).to_numpy()]] = -1
        ends = np.r_[True, session[1:] != session[:-1]] if len(session) else np.zeros(0, bool)
        none = np.full((1, 3), np.nan)
        before = np.where(ends[:, None], np.nan, np.r_[none, track[:-1]][: len(track)])
        after = np.where(np.r_[ends[1:], True][: len(track), None], np.nan, np.r_[track[1:], none][: len(track)])
        found = np.r_[np.c_[track, before, after], np.full((1, 9), np.nan)][best]
        return {"__d2": np.where(best >= 0, d2, np.nan)} | dict(zip(chosen, found.T, strict=True))

    asked = frames.where(F.col(by).isNotNull()).select(by, F.lit(None).cast("double").alias(t), key, "fe_m", "fn_m")
    track = enu.where(F.col(by).isNotNull()).select(by, t, "e_m", "n_m")
    best = per_sessions_with(asked, track, meet, dict.fromkeys(("__d2", *chosen), T.DoubleType()), by, t).where("__d2 IS NOT NULL")

    def on(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column]:
        """Distance and time of the nearest place on a segment of (east, north, time) ends; null for none."""
        de, dn = b[0] - a[0], b[1] - a[1]
        sq = de * de + dn * dn
        u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("fe_m") - a[0]) * de + (F.col("fn_m") - a[1]) * dn) / F.when(sq >= 1e-12, sq)))
        return F.sqrt((F.col("fe_m") - a[0] - u * de) ** 2 + (F.col("fn_m") - a[1] - u * dn) ** 2), a[2] + u * (b[2] - a[2])

    here = (F.col("__e"), F.col("__n"), F.col("__t"))
    d0, t0 = on((F.col("__e0"), F.col("__n0"), F.col("__t0")), here)
    d1, t1 = on(here, (F.col("__e1"), F.col("__n1"), F.col("__t1")))
    rows = best.withColumns({"__d": F.sqrt("__d2"), "__da": F.coalesce(d0, F.lit(float("inf"))), "__ta": t0, "__db": F.coalesce(d1, F.lit(float("inf"))), "__tb": t1})
    off = F.least("__d", "__da", "__db")
    when = F.when((F.col("__da") < F.col("__d")) & (F.col("__da") <= F.col("__db")), F.col("__ta")).when(F.col("__db") < F.col("__d"), F.col("__tb")).otherwise(F.col("__t"))
    return rows.select(by, key, when.alias(t), off.alias("off_m")).where(F.col("off_m") <= max_m)
