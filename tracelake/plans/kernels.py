"""Grouped-map kernels over sessions, and the smoother bake-off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import geo
from tracelake.operators import gates, kernels, masks, smoothers
from tracelake.operators.motion import with_enu
from tracelake.operators.ranges import common_times
from tracelake.plans import recursions
from tracelake.plans.gating import _PLAUSIBLE, _STATIC
from tracelake.plans.tracks import ENU, TRACK, rounded, sql_ecef, track
from tracelake.plans.tracks import masks as mask_rows
from tracelake.registry import query

D = T.DoubleType()


def _enu(spark: SparkSession, sf: str) -> DataFrame:
    return with_enu(track(spark, sf))


#: The scalar two-state filter (no smoother) as a recursive query: the state and its covariance carried row by row.
_KF = f"""WITH RECURSIVE {ENU}, z AS (SELECT session_id, epoch_ix, e_m AS z FROM enu),
kf AS (
  SELECT session_id, epoch_ix, z AS x0, 0.0E0 AS x1, 4.0E0 AS a, 0.0E0 AS b, 1.0E0 AS c, z AS out FROM z WHERE epoch_ix = 0
  UNION ALL
  SELECT session_id, epoch_ix, px + k0 * (z - px), x1 + k1 * (z - px), (1 - k0) * pa, (1 - k0) * pb, pc - k1 * pb, px + k0 * (z - px)
  FROM (SELECT *, pa / (pa + 4) AS k0, pb / (pa + 4) AS k1 FROM (
    SELECT z.session_id, z.epoch_ix, z.z, kf.x0 + kf.x1 AS px, kf.x1, kf.a + 2 * kf.b + kf.c + 0.0625E0 AS pa, kf.b + kf.c + 0.125E0 AS pb, kf.c + 0.25E0 AS pc
    FROM kf JOIN z ON z.session_id = kf.session_id AND z.epoch_ix = kf.epoch_ix + 1)))
SELECT session_id, epoch_ix, round(out, 4) + 0.0E0 AS e_f FROM kf"""


@query(_KF)
def kernel_forward_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The constant-velocity filter, forwards only, at a step of one second."""
    f, q = kernels._cv(1.0, 0.5)
    h, r = np.array([[1.0, 0.0]]), np.array([[4.0]])

    def run(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        z = rows["e_m"].to_numpy(float)
        start = np.array([z[0], 0.0]), np.diag([4.0, 1.0])
        # The first row is the start itself.
        xs, _ = kernels._smooth(len(z) - 1, start, lambda _: (f, q), lambda k: [(z[k + 1 : k + 2], h, r)], two_way=False)
        return {"e_f": np.concatenate([z[:1], xs[:, 0]])}

    return rounded(kernels.per_session(_enu(spark, sf).select("session_id", "epoch_ix", "utc_s", "e_m"), run, {"e_f": D}).select("session_id", "epoch_ix", "e_f"), 4)


@query(recursions.CV_RTS)
def kernel_cv_rts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _enu(spark, sf).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m", "u_m")

    def run(r: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        x = kernels.cv_rts_all(cuts, r[["e_m", "n_m", "u_m"]].to_numpy(float), kernels.usual_step(r["utc_s"].to_numpy(float), cuts), np.array([2.0, 2.0, 4.0]))
        return {"e_s": x[:, 0], "n_s": x[:, 1], "u_s": x[:, 2]}

    return rounded(kernels.per_sessions(rows, run, {"e_s": D, "n_s": D, "u_s": D}).select("session_id", "epoch_ix", "e_s", "n_s", "u_s"), 4)


@query(recursions.RTS_IRREGULAR)
def kernel_rts_irregular(spark: SparkSession, sf: str) -> DataFrame:
    rows = _enu(spark, sf).select("session_id", "epoch_ix", "utc_s", "e_m")
    run = lambda r, cuts: dict(zip(("e_s", "ve_s"), kernels.rts_irregular_all(cuts, r["e_m"].to_numpy(float), r["utc_s"].to_numpy(float)), strict=True))
    return rounded(kernels.per_sessions(rows, run, {"e_s": D, "ve_s": D}).select("session_id", "epoch_ix", "e_s", "ve_s"), 4)


@query(recursions.KALMAN_SIGMA)
def kernel_kalman_sigma(spark: SparkSession, sf: str) -> DataFrame:
    rows = _enu(spark, sf).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m", "u_m", "sd_n", "sd_e", "sd_u")
    out = ("e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s", "sigma_h")
    return rounded(kernels.per_sessions(rows, kernels.kalman_sigma, dict.fromkeys(out, D)).select("session_id", "epoch_ix", *out), 4)


@query()
def kernel_epoch_weighted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _enu(spark, sf).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m", "u_m", "ve", "vn", "vu", "sd_n", "sd_e")
    return rounded(kernels.per_sessions(rows, kernels.epoch_weighted_v2, {c: D for c in ("e_s", "n_s", "u_s", "eff_sigma", "innovation", "disagree_m")}), 4)


@query(recursions.JUMP_GATE.format(track=TRACK, reason=_STATIC.replace("> 0.5", "> 5"), **dict(zip("xyz", sql_ecef("lat_deg", "lon_deg", "h_m"), strict=True))))
def kernel_jump_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade: static gates, then jumps from the median of kept rows."""
    t = track(spark, sf).withColumn("age_s", F.col("ratio"))
    x, y, z = geo.llh_to_ecef(F.col("lat_deg"), F.col("lon_deg"), F.col("h_m"))
    rows = t.select("session_id", "epoch_ix", "utc_s", x.alias("x"), y.alias("y"), z.alias("z"), gates.static_reasons().alias("reason"))
    return kernels.per_session(rows, lambda r: kernels.jump_gate(r, jump_m=100.0), {"reason": T.StringType()}).select("session_id", "epoch_ix", "reason")


_SPACED = f"""WITH RECURSIVE {TRACK}, n AS (SELECT session_id, epoch_ix, utc_s FROM track),
keep AS (SELECT session_id, epoch_ix, utc_s, utc_s AS last, true AS keep FROM n WHERE epoch_ix = 0
  UNION ALL SELECT n.session_id, n.epoch_ix, n.utc_s, CASE WHEN n.utc_s - k.last >= 2.5 - 1E-9 THEN n.utc_s ELSE k.last END, n.utc_s - k.last >= 2.5 - 1E-9 FROM keep k JOIN n ON n.session_id = k.session_id AND n.epoch_ix = k.epoch_ix + 1)
SELECT session_id, epoch_ix FROM keep WHERE keep"""


@query(_SPACED)
def kernel_keep_spaced(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at least 2.5 s after the last that stayed."""
    rows = track(spark, sf).select("session_id", "epoch_ix", "utc_s")
    out = kernels.per_session(rows, lambda r: {"keep": kernels.keep_spaced(r["utc_s"].to_numpy(float), 2.5)}, {"keep": T.BooleanType()})
    return out.where("keep").select("session_id", "epoch_ix")


@query(recursions.KEEP_BY_MOTION.format(track=TRACK))
def kernel_keep_by_motion(spark: SparkSession, sf: str) -> DataFrame:
    rows = track(spark, sf).select("session_id", "epoch_ix", "utc_s", F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2).alias("speed"), (F.col("k") % 12).cast("double").alias("turn"))
    out = kernels.per_session(rows, lambda r: {"keep": kernels.keep_by_motion(r["utc_s"].to_numpy(float), r["speed"].to_numpy(float), r["turn"].to_numpy(float), spacing=20.0)}, {"keep": T.BooleanType()})
    return out.where("keep").select("session_id", "epoch_ix")


@query(recursions.ENVELOPE.format(clean=_PLAUSIBLE + ", clean AS MATERIALIZED (SELECT session_id, epoch_ix, utc_s, e_m, n_m, len(reasons) = 0 AS fine FROM reasons)"))
def kernel_envelope_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.plausibility(track(spark, sf)).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m", "reasons")
    return kernels.per_session(rows, kernels.envelope_gates, {"speed_jump": T.BooleanType(), "turn_rate": T.BooleanType()}).select("session_id", "epoch_ix", "speed_jump", "turn_rate")


@query()
def kernel_fuse_masks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(masks.fuse(common_times(mask_rows(spark, sf), "mask")), 4)


@query(recursions.ALLAN.format(track=TRACK))
def kernel_allan(spark: SparkSession, sf: str) -> DataFrame:
    """Allan deviation of a rate of each session, in long form."""

    def run(r: pd.DataFrame) -> pd.DataFrame:
        tau, dev = kernels.allan_deviation(r.sort_values("utc_s")["sd_n"].to_numpy(float), 1.0)
        return pd.DataFrame({"session_id": r["session_id"].iloc[0], "tau_s": tau, "adev": dev.round(8)})

    return track(spark, sf).select("session_id", "utc_s", "sd_n").groupBy("session_id").applyInPandas(run, "session_id long, tau_s double, adev double")


@query()
def kernel_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the median by rows and by blocks of ten; sessions of equal length share their draws."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in kernels.whole_sessions(batches, "session_id"):
            begins = kernels.session_starts(rows["session_id"])
            sizes, x, names = np.diff(np.append(begins, len(rows))), rows["sd_n"].to_numpy(float), rows["session_id"].to_numpy()
            for n in np.unique(sizes):
                first = begins[sizes == n]
                series = x[first[:, None] + np.arange(n)]
                a, b = kernels.bootstrap_interval(series, kernels.median), kernels.bootstrap_interval(series, kernels.median, block=min(10, n))
                yield pd.DataFrame({"session_id": names[first], "lo": a[0], "hi": a[1], "block_lo": b[0], "block_hi": b[1]})

    rows = kernels.spread(track(spark, sf).select("session_id", "utc_s", "sd_n"), "session_id").sortWithinPartitions("session_id", F.asc_nulls_last("utc_s"))
    return rows.mapInPandas(run, "session_id long, lo double, hi double, block_lo double, block_hi double")


@query()
def kernel_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Scale and residual of a turned, scaled and shifted copy of each track."""

    def run(r: pd.DataFrame) -> pd.DataFrame:
        src = r[["e_m", "n_m", "u_m"]].to_numpy(float)
        a = 0.3
        turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1.0]])
        dst = 2.0 * src @ turn.T + np.array([5.0, -3.0, 1.0])
        s, rot, shift = kernels.similarity(src, dst)
        return pd.DataFrame({"session_id": [r["session_id"].iloc[0]], "scale": [round(s, 6)], "rms": [round(float(np.sqrt(((s * src @ rot.T + shift - dst) ** 2).mean())), 6) + 0.0]})

    return _enu(spark, sf).select("session_id", "e_m", "n_m", "u_m").groupBy("session_id").applyInPandas(run, "session_id long, scale double, rms double")


@query()
def kernel_clock_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Recovers a shift of 0.35 s between two copies of a signal."""

    def run(r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("utc_s")
        t, x = r["utc_s"].to_numpy(float), r["sd_n"].to_numpy(float)
        lag, ratio = kernels.clock_offset(t, x, t + 0.35, x)
        return pd.DataFrame({"session_id": [r["session_id"].iloc[0]], "lag_s": [round(lag, 2)], "confidence": [round(ratio, 3)]})

    return track(spark, sf).select("session_id", "utc_s", "sd_n").groupBy("session_id").applyInPandas(run, "session_id long, lag_s double, confidence double")


@query(recursions.MAHONY.format(track=TRACK))
def kernel_mahony(spark: SparkSession, sf: str) -> DataFrame:
    """Attitude from ten inertial samples a second, at the epochs' rate."""

    def run(r: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        t = r["utc_s"].to_numpy(float)
        gyro = np.stack([np.zeros(len(t)), np.zeros(len(t)), np.full(len(t), 0.01)], 1)
        accel = np.stack([r["ax"].to_numpy(float), np.zeros(len(t)), np.full(len(t), 9.80665)], 1)
        q = kernels.mahony_all(cuts, t - np.repeat(t[cuts[:-1]], np.diff(cuts)), gyro, accel)
        return {"qw": q[:, 0], "qx": q[:, 1], "qy": q[:, 2], "qz": q[:, 3]}

    rows = track(spark, sf).select("session_id", "epoch_ix", "utc_s", ((F.col("k") % 7) / 50.0).alias("ax"))
    return rounded(kernels.per_sessions(rows, run, {c: D for c in ("qw", "qx", "qy", "qz")}).select("session_id", "epoch_ix", "qw", "qx", "qy", "qz"), 5)


@query()
def kernel_spline_offset(spark: SparkSession, sf: str) -> DataFrame:
    """A dead-reckoned path bent by a spline to the measured one."""

    def run(r: pd.DataFrame) -> dict[str, np.ndarray]:
        t, e = r["utc_s"].to_numpy(float), r["e_m"].to_numpy(float)
        base = np.concatenate([[0.0], np.cumsum(r["ve"].to_numpy(float)[:-1] * np.diff(t))])
        return {"e_s": kernels.spline_offset(t - t[0], base, t[::5] - t[0], e[::5])}

    rows = _enu(spark, sf).select("session_id", "epoch_ix", "utc_s", "e_m", "ve")
    return rounded(kernels.per_session(rows, run, {"e_s": D}).select("session_id", "epoch_ix", "e_s"), 3)


@query()
def smoother_bake_off(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered smoother, scored against the track before its noise, best first."""
    t = _enu(spark, sf)
    noisy = t.withColumns({"e_m": F.col("e_m") + ((F.col("k") * 7919) % 13 - 6) / 4.0, "n_m": F.col("n_m") + ((F.col("k") * 104729) % 11 - 5) / 4.0})
    from tracelake.plans.inertial_motion import body

    return smoothers.run_all(noisy, t.select("session_id", "utc_s", F.col("e_m").alias("gt_e"), F.col("n_m").alias("gt_n")), imu=body(spark, sf))
