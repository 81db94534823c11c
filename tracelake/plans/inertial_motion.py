"""Inertial motion between epochs, and the smoothers that it feeds, over the event tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import error_state, preintegration, reckoning
from tracelake.operators.motion import with_enu
from tracelake.plans.tracks import ENU, TRACK, rounded, track
from tracelake.registry import query

HOLD = 0.12


def forces(spark: SparkSession, sf: str) -> DataFrame:
    """Ten samples from each epoch on, 0.1 s apart, in local axes without gravity; every seventeenth epoch has none."""
    t = track(spark, sf).where("k % 17 <> 0").select("session_id", "utc_s", "k", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    k, j = F.col("k"), F.col("j")
    return t.select("session_id", (F.col("utc_s") + j / 10.0).alias("utc_s"), (((k + j) % 7 - 3) / 50.0).alias("a_e"), (((k * j) % 5 - 2) / 40.0).alias("a_n"), (((k + 3 * j) % 4 - 1.5) / 30.0).alias("a_u"))


def body(spark: SparkSession, sf: str) -> DataFrame:
    """The same times on a body that lies level and turns slowly."""
    f = forces(spark, sf)
    return f.select("session_id", "utc_s", F.col("a_e").alias("ax"), F.col("a_n").alias("ay"), (F.col("a_u") + 9.80665).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.002).alias("gz"))


def enu(spark: SparkSession, sf: str) -> DataFrame:
    return with_enu(track(spark, sf)).select("session_id", "epoch_ix", "utc_s", "e_m", "n_m", "u_m", "ve", "vn", "vu", "sd_e", "sd_n", "sd_u", "quality", "ns")


_SUMS = f"""{TRACK},
s AS (SELECT session_id, utc_s + j / 10.0E0 AS ts, ((k + j) % 7 - 3) / 50.0E0 AS e, ((k * j) % 5 - 2) / 40.0E0 AS n, ((k + 3 * j) % 4 - 1.5E0) / 30.0E0 AS u FROM track, range(0, 10) r(j) WHERE k % 17 <> 0),
h AS (SELECT *, least(coalesce(lead(ts) OVER (PARTITION BY session_id ORDER BY ts), ts + {HOLD}), ts + {HOLD}) AS te FROM s),
x AS (SELECT session_id, epoch_ix, utc_s AS t1, lag(utc_s) OVER (PARTITION BY session_id ORDER BY utc_s) AS t0 FROM track),
w AS (SELECT x.*, h.*, greatest(least(te, t1) - greatest(ts, t0), 0) AS w, ((t1 - least(te, t1)) + (t1 - greatest(ts, t0))) / 2 AS ahead, ts >= t0 AND ts < t1 AS own FROM x JOIN h ON x.session_id = h.session_id AND h.ts < x.t1 AND h.te > x.t0),
g AS (SELECT session_id, epoch_ix, {", ".join(f"sum({c} * w) AS dv_{c}, sum({c} * w * ahead) AS dp_{c}" for c in "enu")}, sum(w) AS covered_s, count(CASE WHEN own THEN 1 END) AS n_imu,
  stddev_pop(CASE WHEN own THEN sqrt(e * e + n * n + u * u) END) AS shake FROM w GROUP BY 1, 2)"""
_NAMES = [f"{d}_{c}" for d in ("dv", "dp") for c in "enu"] + ["covered_s", "shake"]


@query(f"WITH {_SUMS} SELECT x.session_id, x.epoch_ix, coalesce(n_imu, 0) AS n_imu, {', '.join(f'round(coalesce({c}, 0), 6) + 0.0E0 AS {c}' for c in _NAMES)} FROM x LEFT JOIN g ON x.session_id = g.session_id AND x.epoch_ix = g.epoch_ix")
def inertial_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What the samples of each step add to velocity and place."""
    t = track(spark, sf).select("session_id", "epoch_ix", "utc_s")
    return rounded(preintegration.preintegrate(t, forces(spark, sf), HOLD).select("session_id", "epoch_ix", "n_imu", *_NAMES))


_BIAS = f"""{_SUMS}, a AS (SELECT t.session_id, t.epoch_ix, t.utc_s, ve, vn, coalesce(dv_e, 0) AS dv_e, coalesce(dv_n, 0) AS dv_n, coalesce(dv_u, 0) AS dv_u, coalesce(n_imu, 0) AS n_imu, 0.5E0 + (k % 10) AS sigma_eff, k % 13 = 0 AS bad, CASE WHEN k % 9 = 0 THEN NULL ELSE 0.0E0 END AS vu
  FROM track t LEFT JOIN g ON t.session_id = g.session_id AND t.epoch_ix = g.epoch_ix),
o AS (SELECT *, dv_e - (ve - lag(ve) OVER w) AS oe, dv_n - (vn - lag(vn) OVER w) AS o_n, dv_u - coalesce(vu - lag(vu) OVER w, 0) AS ou, sigma_eff <= 5 AND NOT bad AND NOT lag(bad) OVER w AND n_imu >= 5 AS fine FROM a WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY utc_s DESC) AS back, count(*) OVER (PARTITION BY session_id) AS m FROM o WHERE fine AND sqrt(oe * oe + o_n * o_n + ou * ou) <= 2),
bias AS (SELECT session_id, {", ".join(f"CASE WHEN max(m) >= 10 THEN sum(0.05E0 * power(0.95E0, back - 1) * {c}) ELSE 0 END AS bias_{x}" for c, x in (("oe", "e"), ("o_n", "n"), ("ou", "u")))} FROM f GROUP BY session_id)"""


@query(f"WITH {_BIAS} SELECT s.session_id, {', '.join(f'round(coalesce(bias_{c}, 0), 6) + 0.0E0 AS bias_{c}' for c in 'enu')} FROM (SELECT DISTINCT session_id FROM track) s LEFT JOIN bias USING (session_id)")
def inertial_doppler_bias(spark: SparkSession, sf: str) -> DataFrame:
    """The samples' velocity steps against Doppler's, as a moving average at the session's end."""
    t = track(spark, sf).withColumns({"sigma_eff": 0.5 + F.col("k") % 10, "bad_doppler": F.col("k") % 13 == 0}).select("session_id", "epoch_ix", "utc_s", "ve", "vn", "vu", "sigma_eff", "bad_doppler")
    steps = preintegration.doppler_bias(preintegration.preintegrate(t, forces(spark, sf), HOLD))
    return rounded(steps.groupBy("session_id").agg(*[F.max(f"bias_{c}").alias(f"bias_{c}") for c in "enu"]))


_STOP = f"""{ENU}, d AS (SELECT *, utc_s - lag(utc_s) OVER w AS dt, sqrt(power(e_m - lag(e_m) OVER w, 2) + power(n_m - lag(n_m) OVER w, 2)) AS step FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)),
r AS (SELECT *, count(CASE WHEN dt > 0 AND NOT step / dt < 11.45E0 THEN 1 END) OVER (PARTITION BY session_id ORDER BY utc_s ROWS UNBOUNDED PRECEDING) AS run FROM d)"""


@query(f"WITH {_STOP} SELECT session_id, epoch_ix, max(utc_s) OVER (PARTITION BY session_id, run) - min(utc_s) OVER (PARTITION BY session_id, run) >= 1.5 AS standing FROM r")
def reckoning_standing(spark: SparkSession, sf: str) -> DataFrame:
    """Epochs in slow runs, led by the epoch before."""
    return reckoning.standing(with_enu(track(spark, sf)), below=11.45).select("session_id", "epoch_ix", "standing")


#: One axis of the nine states: the forward recursion and the backward pass, with a place known by quality, Doppler, and no velocity where it stands.
_AXES = (("e", "e_m", "ve", 0.5, 0.3, 1.0, 9.0, 1.0, 4.0), ("n", "n_m", "vn", 0.5, 0.3, 1.0, 9.0, 1.0, 4.0), ("u", "u_m", "vu", 1.5, 0.5, 2.0, 100.0, 4.0, 8.0))


def _reckon_sql() -> str:
    """x, v, a and the six covariances of a row; updates one after the other, then smoothing with the inverse of the predicted covariance."""
    inputs = " UNION ALL ".join(
        f"SELECT session_id, epoch_ix, '{c}' AS axis, row_number() OVER w AS k, count(*) OVER (PARTITION BY session_id) AS m, utc_s - lag(utc_s) OVER w AS h, {z} AS z, power(CASE quality WHEN 1 THEN 0.02E0 WHEN 2 THEN 1 WHEN 4 THEN 3 ELSE 10 END * {sp}, 2) AS r,"
        f" CASE WHEN ve IS NOT NULL AND vn IS NOT NULL AND vu IS NOT NULL THEN {v} END AS y, coalesce({v}, 0) AS y0, {sv}E0 * {sv} AS ry, {sa}E0 * {sa} AS q, {p0}E0 AS p0, {v0}E0 AS v0, {a0}E0 AS a0 FROM enu WINDOW w AS (PARTITION BY session_id ORDER BY utc_s)"
        for c, z, v, sp, sv, sa, p0, v0, a0 in _AXES
    )

    def gain(i: int, value: str, var: str, seen: str, before: str, after: str) -> str:
        """One scalar update of state i: x0 to x2 and p00 to p22."""
        column = [f"p{min(i, j)}{max(i, j)}" for j in range(3)]
        g = [f"CASE WHEN {seen} THEN {column[j]} / (p{i}{i} + {var}) ELSE 0 END" for j in range(3)]
        lines = [f"{after}g AS (SELECT *, {', '.join(f'{e} AS g{j}' for j, e in enumerate(g))} FROM {before})"]
        states = ", ".join(f"x{j} + g{j} * coalesce({value} - x{i}, 0) AS x{j}" for j in range(3))
        covs = ", ".join(f"p{j}{k} - g{j} * {column[k]} AS p{j}{k}" for j in range(3) for k in range(j, 3))
        lines.append(f"{after} AS (SELECT * REPLACE ({states}, {covs}) FROM {after}g)")
        return ", ".join(lines)

    state = "x0, x1, x2, p00, p01, p02, p11, p12, p22"
    predicted = """f.x0 + i.h * f.x1 + i.h * i.h / 2 * f.x2 AS x0, f.x1 + i.h * f.x2 AS x1, f.x2 AS x2,
    f.p00 + 2 * i.h * f.p01 + i.h * i.h * (f.p11 + f.p02) + power(i.h, 3) * f.p12 + power(i.h, 4) / 4 * f.p22 + i.q * power(i.h, 4) / 4 AS p00,
    f.p01 + i.h * (f.p11 + f.p02) + 1.5E0 * i.h * i.h * f.p12 + power(i.h, 3) / 2 * f.p22 + i.q * power(i.h, 3) / 2 AS p01,
    f.p02 + i.h * f.p12 + i.h * i.h / 2 * f.p22 AS p02,
    f.p11 + 2 * i.h * f.p12 + i.h * i.h * f.p22 + i.q * i.h * i.h AS p11, f.p12 + i.h * f.p22 AS p12, f.p22 + i.q * i.h AS p22"""
    names = ("x0", "x1", "x2", "p00", "p01", "p02", "p11", "p12", "p22")
    keep = ", ".join(f"{n} AS b{n}" for n in names)
    # The predicted covariance's inverse by cofactors, and the smoother's gain times what the next row moved by.
    det = "(n.bp00 * (n.bp11 * n.bp22 - n.bp12 * n.bp12) - n.bp01 * (n.bp01 * n.bp22 - n.bp12 * n.bp02) + n.bp02 * (n.bp01 * n.bp12 - n.bp11 * n.bp02))"
    inv = {"00": "n.bp11 * n.bp22 - n.bp12 * n.bp12", "01": "n.bp02 * n.bp12 - n.bp01 * n.bp22", "02": "n.bp01 * n.bp12 - n.bp02 * n.bp11", "11": "n.bp00 * n.bp22 - n.bp02 * n.bp02", "12": "n.bp01 * n.bp02 - n.bp00 * n.bp12", "22": "n.bp00 * n.bp11 - n.bp01 * n.bp01"}
    u = [" + ".join(f"({inv[f'{min(j, k)}{max(j, k)}']}) * (s.x{k} - n.bx{k})" for k in range(3)) for j in range(3)]
    u = [f"({e}) / {det}" for e in u]
    cov = lambda j, k: f"f.p{min(j, k)}{max(j, k)}"
    # Columns of (F P)': place takes h v and h h / 2 a, velocity h a.
    fp = [[f"({cov(i, 0)} + n.h * {cov(i, 1)} + n.h * n.h / 2 * {cov(i, 2)})", f"({cov(i, 1)} + n.h * {cov(i, 2)})", cov(i, 2)] for i in range(3)]
    moved = ", ".join(f"f.x{i} + {fp[i][0]} * d.u0 + {fp[i][1]} * d.u1 + {fp[i][2]} * d.u2 AS x{i}" for i in range(3))
    return f"""WITH RECURSIVE {ENU}, i AS MATERIALIZED ({inputs}),
fwd AS (
  SELECT session_id, epoch_ix, axis, k, m, h, z AS x0, y0 AS x1, 0.0E0 AS x2, p0 AS p00, 0.0E0 AS p01, 0.0E0 AS p02, v0 AS p11, 0.0E0 AS p12, a0 AS p22, {", ".join(f"0.0E0 AS b{n}" for n in names)} FROM i WHERE k = 1
  UNION ALL
  SELECT session_id, epoch_ix, axis, k, m, h, {state}, {", ".join(f"b{n}" for n in names)} FROM (
    WITH pr AS (SELECT i.session_id, i.epoch_ix, i.axis, i.k, i.m, i.h, i.z, i.r, i.y, i.ry, {predicted} FROM fwd f JOIN i ON i.session_id = f.session_id AND i.axis = f.axis AND i.k = f.k + 1),
    pb AS (SELECT *, {keep} FROM pr), {gain(0, "z", "r", "true", "pb", "ua")}, {gain(1, "y", "ry", "y IS NOT NULL", "(SELECT * EXCLUDE (g0, g1, g2) FROM ua)", "ub")}
    SELECT * FROM ub)),
bwd AS (
  SELECT session_id, epoch_ix, axis, k, x0, x1, x2 FROM fwd WHERE k = m
  UNION ALL
  SELECT f.session_id, f.epoch_ix, f.axis, f.k, {moved} FROM bwd s JOIN fwd n ON n.session_id = s.session_id AND n.axis = s.axis AND n.k = s.k JOIN fwd f ON f.session_id = s.session_id AND f.axis = s.axis AND f.k = s.k - 1,
    LATERAL (SELECT {", ".join(f"{e} AS u{j}" for j, e in enumerate(u))}) d)
SELECT session_id, epoch_ix, {", ".join(f"round(max(CASE WHEN axis = '{c}' THEN x0 END), 3) + 0.0E0 AS {c}_s, round(max(CASE WHEN axis = '{c}' THEN x1 END), 3) + 0.0E0 AS v{c}_s" for c in "enu")} FROM bwd GROUP BY 1, 2"""


@query(_reckon_sql())
def reckoning_nine_states(spark: SparkSession, sf: str) -> DataFrame:
    """Place, velocity and acceleration, carried over outages, forwards and back."""
    got = reckoning.dead_reckon(enu(spark, sf), stop_speed=0.0)
    return rounded(got.select("session_id", "epoch_ix", *reckoning.SMOOTH), 3)


@query()
def inertial_error_state(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen-state error filter over samples and epochs, smoothed backwards."""
    got = error_state.smooth_sessions(enu(spark, sf), body(spark, sf), max_hold=HOLD)
    return rounded(got.select("session_id", "epoch_ix", *error_state.OUT), 3)


@query()
def inertial_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Strong, medium and weak epochs; the last two carried by samples."""
    got = preintegration.tiered_filter(enu(spark, sf), forces(spark, sf), medium=0.6, weak=0.9, max_hold=HOLD, least=5)
    return rounded(got.select("session_id", "epoch_ix", "tier", "n_imu", "e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s"), 3)


@query()
def robust_factor_chain(spark: SparkSession, sf: str) -> DataFrame:
    """All epochs of a session at once, outliers weighed down, motion by samples."""
    got = reckoning.factor_chain(enu(spark, sf), forces(spark, sf), max_hold=HOLD)
    return rounded(got.select("session_id", "epoch_ix", "e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s", "weight"), 3)
