"""Dead reckoning with acceleration as a state, and robust smoothing of a chain of epochs.

Both fold many sessions side by side, a step of time for all of them at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import kernels
from tracelake.operators.motion import ordered

AXES, RATES = ("e_m", "n_m", "u_m"), ("ve", "vn", "vu")
SMOOTH = ("e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s")
#: Sigmas by solution quality as multiples of those of a float solution (fixed values).
QUALITY_SCALE = {1: 0.02, 2: 1.0, 4: 3.0, 5: 10.0}


def standing(track: DataFrame, below: float = 0.5, least_s: float = 1.5, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track with standing: whether an epoch is in a run of steps slower than below that lasts least_s or more, its first epoch included.

    Steps of no length neither end nor lengthen a run.
    """
    w = ordered(by, t)
    dt = F.col(t) - F.lag(t).over(w)
    step = F.sqrt((F.col("e_m") - F.lag("e_m").over(w)) ** 2 + (F.col("n_m") - F.lag("n_m").over(w)) ** 2)
    rows = track.withColumn("__slow", F.when(dt > 0, F.coalesce(step / dt < below, F.lit(False))))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A run is led by the epoch before its first slow step; fast steps count the runs.
    rows = rows.withColumn("__run", F.count(F.when(~F.col("__slow"), 1)).over(so_far))
    whole = Window.partitionBy(by, "__run")
    return rows.withColumn("standing", F.max(t).over(whole) - F.min(t).over(whole) >= least_s).drop("__slow", "__run")


def reckon(cuts: np.ndarray, z: np.ndarray, r: np.ndarray, v: np.ndarray, rv: np.ndarray, dt: np.ndarray, still: np.ndarray, sigma_a: np.ndarray, first_var: tuple[np.ndarray, np.ndarray, np.ndarray], zupt: float = 0.03) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, velocity and variance of place for rows by axes: three states an axis, filtered and smoothed.

    Acceleration walks at random (sigma_a an axis). Missing measurements are NaN; a
    standing row is held at no velocity besides. The first row of a session is its start.
    """
    side, (rows, axes) = kernels._SideBySide(cuts), z.shape
    n = len(cuts) - 1
    x = np.zeros((n, axes, 3))
    x[..., 0], x[..., 1] = np.nan_to_num(z[cuts[:-1]])[side.order], np.nan_to_num(v[cuts[:-1]])[side.order]
    p = np.zeros((n, axes, 3, 3))
    for i, var in enumerate(first_var):
        p[..., i, i] = var
    xs, ps = np.zeros((rows, axes, 3)), np.zeros((rows, axes, 3, 3))
    xp, pp, fs = np.zeros((rows, axes, 3)), np.zeros((rows, axes, 3, 3)), np.zeros((rows, 1, 3, 3))

    def update(x: np.ndarray, p: np.ndarray, i: int, value: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.isfinite(value)
        gain = np.where(seen[..., None], p[..., i] / (p[..., i, i] + var)[..., None], 0.0)
        x = x + gain * np.where(seen, value - x[..., i], 0.0)[..., None]
        p = p - gain[..., :, None] * p[..., None, i, :]
        return x, (p + np.swapaxes(p, -1, -2)) / 2

    for k in range(side.longest):
        at = side.rows(k)
        x, p = x[: len(at)], p[: len(at)]
        if k:
            h = dt[at][:, None]
            f = np.zeros((len(at), 1, 3, 3))
            f[..., 0, 0] = f[..., 1, 1] = f[..., 2, 2] = 1.0
            f[..., 0, 1] = f[..., 1, 2] = h
            f[..., 0, 2] = h * h / 2
            q = np.zeros((len(at), axes, 3, 3))
            for i, j, term in ((0, 0, h**4 / 4), (1, 1, h * h), (2, 2, h), (0, 1, h**3 / 2), (1, 0, h**3 / 2)):
                q[..., i, j] = sigma_a**2 * term
            x, p = (f @ x[..., None])[..., 0], f @ p @ np.swapaxes(f, -1, -2) + q
            xp[at], pp[at], fs[at] = x, p, f
            moves = h > 0  # a row at the time of the one before adds nothing
            a, b = update(x, p, 0, z[at], r[at])
            a, b = update(a, b, 1, v[at], rv[at])
            a, b = update(a, b, 1, np.where(still[at][:, None], 0.0, np.nan) + np.zeros_like(z[at]), np.full(z[at].shape, zupt**2))
            x, p = np.where(moves[..., None], a, x), np.where(moves[..., None, None], b, p)
        xs[at], ps[at] = x, p
    for k in range(side.longest - 2, -1, -1):
        nxt = side.rows(k + 1)
        at = nxt - 1
        gain = np.swapaxes(np.linalg.solve(pp[nxt] + 1e-12 * np.eye(3), fs[nxt] @ ps[at]), -1, -2)
        xs[at] += (gain @ (xs[nxt] - xp[nxt])[..., None])[..., 0]
        ps[at] += gain @ (ps[nxt] - pp[nxt]) @ np.swapaxes(gain, -1, -2)
    return xs[..., 0], xs[..., 1], ps[..., 0, 0]


def dead_reckon(track: DataFrame, accel: float = 1.0, sigma_p: tuple[float, float] = (0.5, 1.5), sigma_v: tuple[float, float] = (0.3, 0.5), stop_speed: float = 0.5, stop_s: float = 1.5, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track with e_s, n_s, u_s, ve_s, vn_s, vu_s, sigma_h and standing: nine states that carry a track over outages and hold it at stops.

    Position sigmas follow the solution's quality (a fix 0.02, differential 3, single and unknown 10 times a
    float's; a null quality measures no place); Doppler counts where all three parts are known; vertical
    acceleration is twice as uncertain. An outage is just a long step.
    """
    rows = standing(track, stop_speed, stop_s, by, t).withColumn("__scale", reckon_scale())

    def fold(d: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        return reckon_rows(cuts, d[[*AXES]].to_numpy(float), d[[*RATES]].to_numpy(float), d["__scale"].to_numpy(float), d[t].to_numpy(float), d["standing"].to_numpy(bool), accel, sigma_p, sigma_v)

    return kernels.per_sessions(rows, fold, dict.fromkeys((*SMOOTH, "sigma_h"), T.DoubleType()), by, t).drop("__scale")


def _by_quality(scale: dict[int, float]) -> Column:
    """A quality's entry, null without one."""
    scales = F.create_map(*[F.lit(v) for kv in scale.items() for v in kv])
    return F.get(F.map_values(F.map_filter(scales, lambda k, _: k == F.col("quality"))), F.lit(0))


def reckon_scale() -> Column:
    return F.coalesce(_by_quality(QUALITY_SCALE), F.when(F.col("quality").isNotNull(), 10.0))


def reckon_rows(cuts: np.ndarray, z: np.ndarray, v: np.ndarray, scale: np.ndarray, times: np.ndarray, still: np.ndarray, accel: float = 1.0, sigma_p: tuple[float, float] = (0.5, 1.5), sigma_v: tuple[float, float] = (0.3, 0.5)) -> dict[str, np.ndarray]:
    """dead_reckon() of many sessions' rows; scale is reckon_scale()."""
    known = scale[:, None]
    z_seen = np.where(np.isfinite(known), z, np.nan)
    z_seen[cuts[:-1]] = z[cuts[:-1]]
    r = (np.nan_to_num(known, nan=1.0) * np.array([sigma_p[0], sigma_p[0], sigma_p[1]])) ** 2
    start_v = np.where(np.isfinite(v[:, :2]).all(1, keepdims=True), np.nan_to_num(v), 0.0)
    v = np.where(np.isfinite(v).all(1, keepdims=True), v, np.nan)
    v[cuts[:-1]] = start_v[cuts[:-1]]
    rv = np.broadcast_to(np.array([sigma_v[0], sigma_v[0], sigma_v[1]]) ** 2, v.shape)
    gaps = np.maximum(np.diff(times, prepend=0.0), 0.0)
    first = np.array([9.0, 9.0, 100.0]), np.array([1.0, 1.0, 4.0]), np.array([4.0, 4.0, 8.0])
    x, vel, var = reckon(cuts, z_seen, r, v, rv, gaps, still, accel * np.array([1.0, 1.0, 2.0]), first)
    return dict(zip(SMOOTH, [*x.T, *vel.T], strict=True)) | {"sigma_h": np.sqrt(np.maximum(var[:, :2].sum(1), 0.0))}


def robust_chain(
    cuts: np.ndarray, z: np.ndarray, sigma: np.ndarray, v: np.ndarray, sigma_v: np.ndarray, dt: np.ndarray, sigma_a: float, push: tuple[np.ndarray, np.ndarray] | None = None, huber: float = 1.345, rounds: int = 30, tolerance: float = 1e-4
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, velocities and weights that make the chain's cost least: Huber's loss of each epoch's place (all axes together), squares of Doppler and motion.

    The normal equations of such a chain are block-tridiagonal, and a filter
    with its backward pass is their elimination. Each round solves them with an
    epoch's variances divided by its weight, huber over the size of its
    residual in sigmas, until no place moves by more than tolerance.
    """
    weight = np.ones(len(z))
    seen = np.isfinite(z).all(1)
    z = np.where(seen[:, None], z, np.nan)
    first, known = kernels._first_known(cuts, z)
    start = np.where(known, np.take_along_axis(z, first, 0), 0.0), np.nan_to_num(v[cuts[:-1]]), 1e4, 1e2
    before = None
    for _ in range(rounds):
        x, vel, _, _ = kernels.two_state(cuts, z, sigma**2 / weight[:, None], dt, sigma_a, start, v, sigma_v**2, push=push, variances=False)
        if before is not None and np.abs(x - before).max() <= tolerance:
            break
        before = x
        size = np.sqrt(np.where(seen, (((z - x) / sigma) ** 2).sum(1), 0.0))
        weight = np.where(size > huber, huber / np.maximum(size, huber), 1.0)
    return x, vel, weight


#: Multiples of a position's sigma by solution quality, from a fix to a single solution (fixed values); a single solution and an unknown one measure no place.
CHAIN_SCALE = {1: 0.5, 2: 3.0, 4: 20.0}


def factor_chain(track: DataFrame, imu: DataFrame | None = None, sigma_a: float = 0.5, sigma_v: float = 0.3, vertical: float = 2.5, least_sigma: float = 0.2, huber: float = 1.345, max_hold: float = 0.1, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track with e_s, n_s, u_s, ve_s, vn_s, vu_s and weight: all epochs of a session estimated at once, outliers weighed down.

    Place sigmas are sd_e and sd_n (least_sigma at least) times a scale of the quality; motion between epochs is what
    inertial samples add up to (preintegrate), where they hold for half of the step or more, else constant velocity.
    """
    from tracelake.operators.preintegration import preintegrate

    rows = track.withColumn("__scale", chain_scale())
    zero = F.lit(0.0)
    rows = rows.withColumns({c: zero for k in "enu" for c in (f"dv_{k}", f"dp_{k}")} | {"covered_s": zero, "n_imu": F.lit(0), "shake": zero}) if imu is None else preintegrate(rows, imu, max_hold, by, t)

    def fold(d: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        sums = d[["dv_e", "dv_n", "dv_u"]].to_numpy(float), d[["dp_e", "dp_n", "dp_u"]].to_numpy(float), d["covered_s"].to_numpy(float)
        return chain_rows(cuts, d[[*AXES]].to_numpy(float), d[[*RATES]].to_numpy(float), d["__scale"].to_numpy(float), d[t].to_numpy(float), np.hypot(d["sd_e"].to_numpy(float), d["sd_n"].to_numpy(float)), sums, sigma_a, sigma_v, vertical, least_sigma, huber)

    return kernels.per_sessions(rows, fold, dict.fromkeys((*SMOOTH, "weight"), T.DoubleType()), by, t).select(*track.columns, *SMOOTH, "weight")


def chain_scale() -> Column:
    return _by_quality(CHAIN_SCALE)


def chain_rows(
    cuts: np.ndarray, z: np.ndarray, v: np.ndarray, scale: np.ndarray, times: np.ndarray, sd: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray] | None, sigma_a: float = 0.5, sigma_v: float = 0.3, vertical: float = 2.5, least_sigma: float = 0.2, huber: float = 1.345
) -> dict[str, np.ndarray]:
    """factor_chain() of many sessions' rows; scale is chain_scale(), sums are what samples add to velocity and place in each step and how long they hold."""
    known = scale[:, None]
    z = np.where(np.isfinite(known), z, np.nan)
    sigma = np.maximum(np.nan_to_num(sd, nan=1.0), least_sigma)[:, None] * np.nan_to_num(known, nan=1.0) * np.array([1.0, 1.0, vertical])
    gaps = np.maximum(np.diff(times, prepend=0.0), 0.0)
    gaps[cuts[:-1]] = 0.0
    dv, dp, covered = sums or (np.zeros(z.shape), np.zeros(z.shape), np.zeros(len(z)))
    on = (covered >= gaps / 2)[:, None] & (gaps > 0)[:, None]
    x, vel, weight = robust_chain(cuts, z, sigma, v, np.full(v.shape, sigma_v), gaps, sigma_a, (np.where(on, dp, 0.0), np.where(on, dv, 0.0)), huber)
    return dict(zip(SMOOTH, [*x.T, *vel.T], strict=True)) | {"weight": weight}
