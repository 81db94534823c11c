"""Kernels that join inertial samples and epochs of a session: attitude, strapdown filters, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import islands, kernels
from tracelake.operators.ranges import interval_join

G = 9.80665


def rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows of v turned by rows of unit quaternions, body to world."""
    w, u = q[:, :1], q[:, 1:]
    c = np.cross(u, v)
    return v + 2 * (w * c + np.cross(u, c))


def strapdown_rts(epochs: pd.DataFrame, samples: pd.DataFrame, **options: float) -> pd.DataFrame:
    """strapdown_rts_all() of one session."""
    got = strapdown_rts_all(epochs, np.array([0, len(epochs)]), samples, np.array([0, len(samples)]), **options)
    return pd.DataFrame({"session_id": epochs["session_id"], "utc_s": epochs["utc_s"].to_numpy(float), **got})


STRAPDOWN = ("e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s")


def strapdown_rts_all(
    epochs: pd.DataFrame, cuts: np.ndarray, samples: pd.DataFrame, sample_cuts: np.ndarray, accel_noise: float = 3.0, bias_walk: float = 0.003, sigma_p: tuple[float, float] = (0.3, 0.5), sigma_v: float = 0.3, gate: float = 25.0
) -> dict[str, np.ndarray]:
    """Nine states (position, velocity, acceleration bias): samples predict, epochs update position and Doppler, then the backward pass; many sessions side by side.

    World acceleration is the rotated specific force less gravity, averaged
    between epochs; velocity updates beyond the chi-squared gate are left out.
    Without samples the filter is one of constant velocity.
    """
    t = epochs["utc_s"].to_numpy(float)
    z, v = epochs[["e_m", "n_m", "u_m"]].to_numpy(float), epochs[["ve", "vn", "vu"]].to_numpy(float)
    mean = np.zeros((len(t), 3))
    if len(samples):
        ts = samples["utc_s"].to_numpy(float)
        force, gyro = samples[["ax", "ay", "az"]].to_numpy(float), samples[["gx", "gy", "gz"]].to_numpy(float)
        world = rotate(kernels.mahony_all(sample_cuts, ts, gyro, force), force) - [0, 0, G]
        for a, b, c, d in zip(cuts[:-1], cuts[1:], sample_cuts[:-1], sample_cuts[1:], strict=True):
            total = np.vstack([np.zeros(3), np.cumsum(world[c:d], axis=0)])
            hi = np.searchsorted(ts[c:d], t[a:b])
            lo = np.append(hi[:1], hi[:-1])
            some = hi > lo
            mean[a:b][some] = (total[hi[some]] - total[lo[some]]) / (hi - lo)[some, None]
    gaps = np.diff(t, prepend=t[0])
    gaps[cuts[:-1]] = 0.0
    gaps = np.clip(gaps, 0.0, 30.0)
    var_p = np.array([sigma_p[0], sigma_p[0], sigma_p[1]]) ** 2
    side, n = kernels._SideBySide(cuts), len(t)
    one, eye, swap = np.eye(9), np.eye(3), kernels.swap
    first = side.begin
    x = np.concatenate([z[first], np.where(np.isfinite(v[first]), v[first], 0.0), np.zeros((len(first), 3))], axis=1)
    p = np.tile(np.diag([9.0, 9, 225, 1, 1, 4, 0.04, 0.04, 0.04]), (len(first), 1, 1))
    xs, ps, xp, pp, fs = np.zeros((n, 9)), np.zeros((n, 9, 9)), np.zeros((n, 9)), np.zeros((n, 9, 9)), np.zeros((n, 9, 9))
    there = np.repeat(np.isfinite(z).all(1)[:, None], 3, 1)
    for k in range(side.longest):
        at = side.rows(k)
        dt = gaps[at][:, None, None]
        f, q = np.tile(one, (len(at), 1, 1)), np.zeros((len(at), 9, 9))
        f[:, :3, 3:6], f[:, :3, 6:], f[:, 3:6, 6:] = eye * dt, -eye * dt * dt / 2, -eye * dt
        q[:, :3, :3], q[:, :3, 3:6], q[:, 3:6, 3:6] = (accel_noise**2 * s * eye for s in (dt**4 / 4, dt**3 / 2, dt**2))
        q[:, 3:6, :3], q[:, 6:, 6:] = q[:, :3, 3:6], eye * bias_walk**2 * dt
        push, h = mean[at], dt[:, :, 0]
        x = (f @ x[: len(at), :, None])[..., 0] + np.concatenate([push * h * h / 2, push * h, np.zeros_like(push)], axis=1)
        p = f @ p[: len(at)] @ swap(f) + q + one * 1e-12
        xp[at], pp[at], fs[at] = x, p, f
        for matrix, var, value, seen, most in ((one[:3], var_p, z[at], there[at], np.inf), (one[3:6], np.full(3, sigma_v**2), v[at], np.isfinite(v[at]), gate)):
            p, add, _ = kernels.measured(p, matrix, var, value - (matrix @ x[:, :, None])[..., 0], seen, most)
            x = x + add
        xs[at], ps[at] = x, p
    for k in range(side.longest - 2, -1, -1):
        nxt = side.rows(k + 1)
        at = nxt - 1
        xs[at] += (ps[at] @ swap(fs[nxt]) @ np.linalg.solve(pp[nxt], (xs[nxt] - xp[nxt])[..., None]))[..., 0]
    return dict(zip(STRAPDOWN, xs.T, strict=False))


def turn_rate_ekf(t: np.ndarray, z: np.ndarray, accel: float = 1.0, turn: float = 0.2, sigma: float = 3.0) -> np.ndarray:
    """turn_rate_all() of one session."""
    return turn_rate_all(np.array([0, len(t)]), t, z, accel, turn, sigma)


def turn_rate_all(cuts: np.ndarray, t: np.ndarray, z: np.ndarray, accel: float = 1.0, turn: float = 0.2, sigma: float = 3.0) -> np.ndarray:
    """Five states (east, north, heading, speed, turn rate) with constant turn rate and speed, many sessions side by side; returns east and north of each row."""
    side, out = kernels._SideBySide(cuts), np.zeros((len(t), 2))
    begin, pair = side.begin, side.running[1] if side.longest > 1 else 0
    first, gap = np.tile([0.0, 1.0], (len(begin), 1)), np.ones(len(begin))
    first[:pair], gap[:pair] = z[begin[:pair] + 1] - z[begin[:pair]], np.maximum(t[begin[:pair] + 1] - t[begin[:pair]], 1e-3)
    x = np.stack([z[begin, 0], z[begin, 1], np.arctan2(first[:, 0], first[:, 1]), np.hypot(first[:, 0], first[:, 1]) / gap, np.zeros(len(begin))], 1)
    p = np.tile(np.diag([sigma**2, sigma**2, 1.0, 25.0, 0.1]), (len(begin), 1, 1))
    var, noise, h = np.array([accel**2, turn**2]), np.eye(2) * sigma**2, np.eye(2, 5)
    for k in range(side.longest):
        at = side.rows(k)
        (e, n, a, s, w), p = x[: len(at)].T, p[: len(at)]
        dt = t[at] - t[at - 1] if k else np.zeros(len(at))
        straight = np.abs(w) < 1e-6
        safe = np.where(straight, 1.0, w)
        b = a + w * dt
        sin_a, cos_a, sin_b, cos_b = np.sin(a), np.cos(a), np.sin(b), np.cos(b)
        # Path, and path over speed, by east and north: along an arc, or along a line where it doesn't turn.
        path = np.where(straight, [s * dt * sin_a, s * dt * cos_a], [s / safe * (cos_a - cos_b), s / safe * (sin_b - sin_a)])
        ds = np.where(straight, [dt * sin_a, dt * cos_a], np.array([cos_a - cos_b, sin_b - sin_a]) / safe)
        da = np.where(straight, [s * dt * cos_a, -s * dt * sin_a], [s / safe * (sin_b - sin_a), s / safe * (cos_b - cos_a)])
        dw = np.where(straight, [s * dt * dt * cos_a / 2, -s * dt * dt * sin_a / 2], s / safe * (dt * np.array([sin_b, cos_b]) - ds))
        x = np.stack([e + path[0], n + path[1], np.where(straight, a, b), s, w], 1)
        f = np.tile(np.eye(5), (len(at), 1, 1))
        f[:, :2, 2], f[:, :2, 3], f[:, :2, 4], f[:, 2, 4] = da.T, ds.T, dw.T, dt
        g = np.zeros((len(at), 5, 2))
        g[:, 0, 0], g[:, 1, 0], g[:, 3, 0] = dt * dt / 2 * np.sin(x[:, 2]), dt * dt / 2 * np.cos(x[:, 2]), dt
        g[:, 2, 1], g[:, 4, 1] = dt * dt / 2, dt
        p = f @ p @ kernels.swap(f) + (g * var) @ kernels.swap(g)
        gain = kernels.swap(np.linalg.solve(p[:, :2, :2] + noise, p[:, :2]))
        x = x + (gain @ (z[at] - x[:, :2])[..., None])[..., 0]
        p = (np.eye(5) - gain @ h) @ p
        out[at] = x[:, :2]
    return out


def allan_parameters(rate: np.ndarray, fs: np.ndarray | float) -> dict[str, np.ndarray | float | bool]:
    """Random walk (read at 1 s), bias instability (minimum over 0.664) and rate random walk (read at 3 s) from slopes of -1/2, 0 and +1/2; of one rate, or of a stack of equal lengths."""
    tau, dev = kernels.allan_deviation(rate, fs)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = _slopes(np.log(dev), np.log(tau))

    def read(slope: float, at: float) -> np.ndarray:
        k = np.abs(local - slope).argmin(-1)[..., None]
        d, x = (np.take_along_axis(np.broadcast_to(a, dev.shape), k, -1)[..., 0] for a in (dev, tau))
        return np.exp(np.log(d) + slope * (np.log(at) - np.log(x)))

    got = {"random_walk": read(-0.5, 1.0), "bias_instability": dev.min(-1) / 0.664, "rate_random_walk": read(0.5, 3.0), "reliable": np.broadcast_to(tau[..., -1] >= 10.0, dev.shape[:-1])}
    return got if rate.ndim > 1 else {k: x.item() for k, x in got.items()}


def _slopes(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """np.gradient of y by x along the last axis, each row with its own x."""
    dx = np.diff(x)
    a, b = dx[..., :-1], dx[..., 1:]
    uneven = -b / (a * (a + b)) * y[..., :-2] + (b - a) / (a * b) * y[..., 1:-1] + a / (b * (a + b)) * y[..., 2:]
    even = (y[..., 2:] - y[..., :-2]) / (2.0 * dx[..., :1])
    inner = np.where((dx == dx[..., :1]).all(-1, keepdims=True), even, uneven)
    ends = np.diff(y) / dx
    return np.concatenate([ends[..., :1], inner, ends[..., -1:]], axis=-1)


def turn_trust(t: np.ndarray, yaw_rate: np.ndarray, track_t: np.ndarray, heading_deg: np.ndarray, alpha: float = 0.2) -> tuple[float, str]:
    """Correlation of the low-passed yaw rate with the track's turn rate, and a verdict."""
    low = np.zeros(len(yaw_rate))
    for k in range(len(yaw_rate)):
        low[k] = yaw_rate[k] if k == 0 else low[k - 1] + alpha * (yaw_rate[k] - low[k - 1])
    turn = np.gradient(np.unwrap(np.radians(heading_deg)), track_t)
    mine = np.interp(track_t, t, low)
    if mine.std() < 1e-9 or turn.std() < 1e-9:
        return 0.0, "DEAD"
    r = float(abs(np.corrcoef(mine, turn)[0, 1]))
    return r, "GOOD" if r >= 0.8 else "OK" if r >= 0.5 else "WEAK"


def chi_square_interval(d: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Bounds of the mean of n squared Mahalanobis distances in d dimensions (Wilson and Hilferty's quantile)."""
    from statistics import NormalDist

    k = d * n
    q = lambda p: k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3 / n
    return q(alpha / 2), q(1 - alpha / 2)


def nees(errors: np.ndarray, covariances: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float, bool]:
    """Mean squared Mahalanobis distance, its interval, and whether it lies inside."""
    m = float(np.mean(np.einsum("ni,ni->n", errors, np.linalg.solve(covariances, errors[:, :, None])[:, :, 0])))
    lo, hi = chi_square_interval(errors.shape[1], len(errors), alpha)
    return m, lo, hi, lo <= m <= hi


def position_filter(track: DataFrame, imu: DataFrame, sigma_a: float = 0.5, sigma_p: float = 3.0, sigma_v: float = 0.5, two_way: bool = False, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, t, epoch, e_s, n_s, u_s, ve_s, vn_s, vu_s at every sample and epoch from a session's first epoch on.

    imu holds accelerations in local axes without gravity (a_e, a_n, a_u), which
    drive constant-velocity filters of each axis; epochs (e_m, n_m, u_m, ve, vn,
    vu; missing ones are skipped) correct them, so that holes between epochs are
    bridged by the samples. two_way smooths. Samples and epochs are one timeline,
    with one shuffle; a whole session is in a task.
    """
    axes, rates, forces = ("e_m", "n_m", "u_m"), ("ve", "vn", "vu"), ("a_e", "a_n", "a_u")
    none = lambda cols: [F.lit(None).cast("double").alias(c) for c in cols]
    epochs = track.select(by, t, F.lit(1).alias("epoch"), *axes, *rates, *none(forces))
    line = epochs.unionByName(imu.select(by, t, F.lit(0).alias("epoch"), *none(axes), *none(rates), *forces))
    so_far = Window.partitionBy(by).orderBy(t, "epoch").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("epoch") == 1, F.col(t))).over(Window.partitionBy(by))
    line = line.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0.0)) for c in forces} | {"__first": first})
    line = line.where((F.col("epoch") == 1) | (F.col(t) > F.col("__first"))).drop("__first")

    def fold(rows: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        z, v, force = (rows[[*c]].to_numpy(float) for c in (axes, rates, forces))
        gaps = np.maximum(np.diff(rows[t].to_numpy(float), prepend=rows[t].iloc[0]), 0.0)
        gaps[cuts[:-1]] = 0.0
        start = np.nan_to_num(z[cuts[:-1]]), np.nan_to_num(v[cuts[:-1]]), sigma_p**2, 4.0
        shape = lambda sigma: np.full(z.shape, sigma**2)
        x, vel, _, _ = kernels.two_state(cuts, z, shape(sigma_p), gaps, sigma_a, start, v, shape(sigma_v), push=force, two_way=two_way)
        return {f"{c}_s": x[:, k] for k, c in enumerate("enu")} | {f"v{c}_s": vel[:, k] for k, c in enumerate("enu")}

    out = {c: T.DoubleType() for c in ("e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s")}
    return kernels.per_sessions(line, fold, out, by, t).select(by, t, "epoch", *out)


def calibrate(imu: DataFrame, track: DataFrame | None = None, max_speed: float = 0.4, min_s: float = 2.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, axis, random_walk, bias_instability, rate_random_walk, reliable, n, source: noise of each inertial axis (ax to gz).

    Without a track the samples are taken to be at rest (dedicated_static);
    otherwise those within its standing periods count (mined_zupt), and a session
    without one has no row. Axes below eight samples have none either; without
    any noise all is 0.
    """
    source, still = "dedicated_static", imu
    if track is not None:
        source = "mined_zupt"
        still = interval_join(imu, islands.static_periods(track, max_speed, min_s, by, t), t=t, by=by).select(*imu.columns)
    axes = ["ax", "ay", "az", "gx", "gy", "gz"]
    names = [by, "axis", "random_walk", "bias_instability", "rate_random_walk", "reliable", "n", "source"]

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        begins = kernels.session_starts(rows[by])
        sizes = np.diff(np.append(begins, len(rows)))
        x, times = rows[axes].to_numpy(float), rows[t].to_numpy(float)
        usual = np.full(len(begins), np.nan)
        for s in np.flatnonzero(sizes >= 8):
            steps = np.diff(times[begins[s] : begins[s] + sizes[s]])
            steps = steps[steps > 0]
            usual[s] = np.median(steps) if len(steps) else np.nan
        # Sessions of equal length side by side, all axes at once.
        for n in np.unique(sizes[np.isfinite(usual)]):
            which = np.flatnonzero(np.isfinite(usual) & (sizes == n))
            rates = np.ascontiguousarray(np.swapaxes(x[begins[which][:, None] + np.arange(n)], 1, 2))
            noisy = rates.std(-1) > 0
            found = allan_parameters(rates, np.repeat(1 / usual[which][:, None], len(axes), 1))
            yield pd.DataFrame(
                {by: np.repeat(rows[by].to_numpy()[begins[which]], len(axes)), "axis": axes * len(which), "n": n, "source": source} | {c: np.where(noisy, v, 0).astype(v.dtype).ravel() for c, v in found.items()}
            )[names]

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in kernels.whole_sessions(batches, by):
            yield from run(rows)

    kind = dict(imu.dtypes)[by]
    ordered = kernels.spread(still.select(by, t, *axes), by).sortWithinPartitions(by, F.asc_nulls_last(t))
    return ordered.mapInPandas(run_all, f"{by} {kind}, axis string, random_walk double, bias_instability double, rate_random_walk double, reliable boolean, n long, source string")


def static_bias(imu: DataFrame, periods: DataFrame, clip: float = 1.0, least: int = 20, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, bias_x, bias_y, bias_z: acceleration beyond gravity in the session's first standing period with enough samples, cut at +-clip.

    imu holds ax, ay, az and gravity in the body (gx_m, gy_m, gz_m, from its
    attitude) at each sample; the one in the middle of the period counts.
    periods: start_s (included), end_s (excluded).
    """
    inside = interval_join(imu, periods, t=t, by=by).where(F.col(t) < F.col("end_s"))
    w = Window.partitionBy(by, "start_s")
    rows = inside.withColumns({"__i": F.row_number().over(w.orderBy(t)), "__n": F.count(F.lit(1)).over(w)}).where(F.col("__n") >= least)
    middle = F.col("__i") == F.floor(F.col("__n") / 2) + 1
    sums = rows.groupBy(by, "start_s").agg(*[(F.avg(f"a{c}") - F.max(F.when(middle, F.col(f"g{c}_m")))).alias(f"__{c}") for c in "xyz"])
    first = sums.groupBy(by).agg(F.min(F.struct("start_s", "__x", "__y", "__z")).alias("b"))
    cut = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(f"b.__{c}")))
    return first.select(by, cut("x").alias("bias_x"), cut("y").alias("bias_y"), cut("z").alias("bias_z"))
