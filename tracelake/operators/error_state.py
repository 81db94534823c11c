"""Error-state smoother of inertial samples and epochs: place, velocity, attitude and both sensors' biases.

Samples between two epochs are preintegrated in the body's frame of the first
one, with their derivatives by the biases and their noise (all steps of many sessions side by
side, so the loop is over samples of a step). The filter runs at the epochs'
pace on a nominal state and a 15-state error, which each update moves into the
nominal state; a backward pass smooths it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import kernels
from tracelake.operators.reckoning import standing

G = np.array([0.0, 0.0, -9.80665])
P, V, A, BA, BG = (slice(3 * k, 3 * k + 3) for k in range(5))


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((*v.shape[:-1], 3, 3))
    x, y, z = v[..., 0], v[..., 1], v[..., 2]
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -z, y, -x
    return out - np.swapaxes(out, -1, -2)


def turn(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors."""
    angle = np.linalg.norm(v, axis=-1)[..., None, None]
    safe, k = np.maximum(angle, 1e-9), skew(v)
    a = np.where(angle < 1e-6, 1 - angle**2 / 6, np.sin(angle) / safe)
    b = np.where(angle < 1e-6, 0.5 - angle**2 / 24, (1 - np.cos(angle)) / safe**2)
    return np.eye(3) + a * k + b * (k @ k)


def turned(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotation matrices (below half a turn)."""
    angle = np.arccos(np.clip((np.trace(r, axis1=-2, axis2=-1) - 1) / 2, -1, 1))[..., None]
    axis = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], -1)
    small = angle < 1e-7
    return np.where(small, axis / 2, axis * angle / (2 * np.sin(np.where(small, 1.0, angle))))


def right_jacobian(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=-1)[..., None, None]
    safe, k = np.maximum(angle, 1e-9), skew(v)
    a = np.where(angle < 1e-4, 0.5, (1 - np.cos(angle)) / safe**2)
    b = np.where(angle < 1e-4, 1 / 6, (angle - np.sin(angle)) / safe**3)
    return np.eye(3) - a * k + b * (k @ k)


@dataclass
class Steps:
    """What the samples of each step add up to in its first epoch's body frame, and how long they hold for."""

    r: np.ndarray
    v: np.ndarray
    p: np.ndarray
    r_bg: np.ndarray
    v_ba: np.ndarray
    v_bg: np.ndarray
    p_ba: np.ndarray
    p_bg: np.ndarray
    noise: np.ndarray  # of turn, velocity, place
    covered: np.ndarray


def pieces(t: np.ndarray, ts: np.ndarray, max_hold: float, cuts: np.ndarray, sample_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples cut at the epochs that they hold over: each piece's sample, the epoch that its step leads to, begin and length; and how many samples lie in each step.

    A sample holds until the next one, max_hold at most. Sessions s are the epochs cuts[s] to cuts[s + 1] and the samples sample_cuts[s] to sample_cuts[s + 1].
    """
    following = np.append(ts[1:], np.inf)
    following[sample_cuts[1:][sample_cuts[1:] > 0] - 1] = np.inf
    ends = np.minimum(following, ts + max_hold)
    first, last, begins, ends_at = (np.zeros(len(ts), np.int64) for _ in range(4))
    for a, b, c, d in zip(cuts[:-1], cuts[1:], sample_cuts[:-1], sample_cuts[1:], strict=True):
        first[c:d], last[c:d] = a + np.searchsorted(t[a:b], ts[c:d], "right"), a + np.searchsorted(t[a:b], ends[c:d], "left")
        begins[c:d], ends_at[c:d] = a, b
    within = np.bincount(first[(first > begins) & (first < ends_at)], minlength=len(t))
    count = np.maximum(last - first + 1, 0)
    sample = np.repeat(np.arange(len(ts)), count)
    k = first[sample] + np.arange(len(sample)) - np.repeat(np.cumsum(count) - count, count)
    inside = (k > begins[sample]) & (k < ends_at[sample])
    sample, k = sample[inside], k[inside]
    begin, end = np.maximum(ts[sample], t[k - 1]), np.minimum(ends[sample], t[k])
    some = end > begin
    return sample[some], k[some], begin[some], (end - begin)[some], within


def preintegrate(t: np.ndarray, ts: np.ndarray, force: np.ndarray, rate: np.ndarray, sigma_f: float = 0.1, sigma_w: float = 0.01, max_hold: float = 0.1, cuts: np.ndarray | None = None, sample_cuts: np.ndarray | None = None) -> Steps:
    """Sums for the steps from t[k - 1] to t[k] (none for a session's first epoch). A sample holds until the next one, max_hold at most; epochs part it.

    Sessions as in pieces(); one session without cuts.
    """
    return preintegrate_each(t, ts, force, rate, [sigma_f], sigma_w, max_hold, cuts, sample_cuts)[0]


#: Steps that preintegrate_each() takes side by side.
STEPS_AT_ONCE = 512


def preintegrate_each(t: np.ndarray, ts: np.ndarray, force: np.ndarray, rate: np.ndarray, sigmas_f: list[float], sigma_w: float = 0.01, max_hold: float = 0.1, cuts: np.ndarray | None = None, sample_cuts: np.ndarray | None = None) -> list[Steps]:
    """preintegrate() for each sigma_f: only the noise differs, all else is shared."""
    n = len(t)
    cuts, sample_cuts = (np.array([0, len(x)]) if c is None else c for x, c in ((t, cuts), (ts, sample_cuts)))
    step = Steps(np.tile(np.eye(3), (n, 1, 1)), np.zeros((n, 3)), np.zeros((n, 3)), *(np.zeros((n, 3, 3)) for _ in range(5)), np.zeros((n, 9, 9)), np.zeros(n))
    each = [step, *(replace(step, noise=np.zeros((n, 9, 9))) for _ in sigmas_f[1:])]
    if not len(ts):
        return each
    sample, k, _, dt, _ = pieces(t, ts, max_hold, cuts, sample_cuts)
    if not len(k):
        return each
    np.add.at(step.covered, k, dt)
    sizes = np.bincount(k, minlength=n)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    turns = rate[sample] * dt[:, None]
    # As many steps at a time as the processor's cache holds.
    for lot in range(0, n, STEPS_AT_ONCE):
        own = order[lot : lot + STEPS_AT_ONCE]
        own = own[sizes[own] > 0]
        for i in range(sizes[own[0]] if len(own) else 0):
            s = own[: np.searchsorted(-sizes[own], -(i + 1), "right")]
            at = begins[s] + i
            h, f = dt[at][:, None], force[sample[at]]
            r, hh = step.r[s], h[..., None]
            rf, r_fx = (r @ f[..., None])[..., 0], r @ skew(f)
            push = r_fx @ step.r_bg[s]
            step.p[s] += step.v[s] * h + rf * h * h / 2
            step.p_ba[s] += step.v_ba[s] * hh - r * hh * hh / 2
            step.p_bg[s] += step.v_bg[s] * hh - push * hh * hh / 2
            step.v[s] += rf * h
            step.v_ba[s] -= r * hh
            step.v_bg[s] -= push * hh
            small, jac = turn(turns[at]), right_jacobian(turns[at])
            back = np.swapaxes(small, -1, -2)
            a = np.zeros((len(s), 9, 9))
            a[:, :3, :3] = back
            a[:, 3:6, :3], a[:, 6:, :3] = -r_fx * hh, -r_fx * hh * hh / 2
            a[:, 3:6, 3:6] = a[:, 6:, 6:] = np.eye(3)
            a[:, 6:, 3:6] = np.eye(3) * hh
            b = np.zeros((len(s), 9, 6))
            b[:, :3, 3:], b[:, 3:6, :3], b[:, 6:, :3] = jac * hh, r * hh, r * hh * hh / 2
            # Densities over a piece: variances of its mean are the squares over its length.
            for sigma_f, steps in zip(sigmas_f, each, strict=True):
                power = np.concatenate([np.full(3, sigma_f**2), np.full(3, sigma_w**2)]) / h
                steps.noise[s] = a @ steps.noise[s] @ np.swapaxes(a, -1, -2) + (b * power[:, None, :]) @ np.swapaxes(b, -1, -2)
            step.r_bg[s] = back @ step.r_bg[s] - jac * hh
            step.r[s] = r @ small
    return each


def start_attitude(force: np.ndarray, heading: float | None) -> np.ndarray:
    """Body (forward, left, up) to east, north, up: level by the mean specific force, forward to the heading (radians from north, clockwise)."""
    up = force / max(np.linalg.norm(force), 1e-9)
    forward = np.array([1.0, 0, 0]) - up[0] * up
    if np.linalg.norm(forward) < 1e-6:
        forward = np.array([0.0, 1, 0]) - up[1] * up
    forward /= np.linalg.norm(forward)
    level = np.stack([forward, np.cross(up, forward), up])
    h = heading or 0.0
    return np.array([[np.sin(h), -np.cos(h), 0], [np.cos(h), np.sin(h), 0], [0, 0, 1.0]]) @ level


def smooth(epochs: pd.DataFrame, samples: pd.DataFrame, **options: float) -> pd.DataFrame:
    """smooth_all() of one session."""
    return epochs.assign(**smooth_all(epochs, np.array([0, len(epochs)]), samples, np.array([0, len(samples)]), **options))


def smooth_all(
    epochs: pd.DataFrame, cuts: np.ndarray, samples: pd.DataFrame, sample_cuts: np.ndarray, sigma_p: tuple[float, float] = (0.5, 1.0), sigma_v: tuple[float, float] = (0.3, 0.5), sigma_f: float = 0.1, sigma_w: float = 0.01, walk_f: float = 0.003, walk_w: float = 0.0003,
    zupt: float = 0.05, sideways: float = 0.3, gate: float = 30.0, accel: float = 3.0, max_hold: float = 0.1, t: str = "utc_s", step: Steps | None = None, variances: bool = True,
) -> dict[str, np.ndarray]:
    """Many sessions side by side: epochs (t, e_m, n_m, u_m, ve, vn, vu, standing) and samples (t, ax to gz; forward, left, up), both in order of time in each session.

    A step that samples hold for less than half of is one of constant velocity
    with an acceleration of accel. Places or velocities whose squared
    distance in sigmas is above gate are left out (never more than five places in a row); standing epochs have no
    velocity, moving ones (1.5 m/s and more) none sideways, sigma sideways. step: preintegrate()'s sums, if they are
    there already. Without variances sigma_h is the filter's.
    """
    tt = epochs[t].to_numpy(float)
    z, v = epochs[["e_m", "n_m", "u_m"]].to_numpy(float), epochs[["ve", "vn", "vu"]].to_numpy(float)
    still = epochs["standing"].to_numpy(bool) if "standing" in epochs else np.zeros(len(tt), bool)
    ts, force, rate = samples[t].to_numpy(float), samples[["ax", "ay", "az"]].to_numpy(float), samples[["gx", "gy", "gz"]].to_numpy(float)
    step = step or preintegrate(tt, ts, force, rate, sigma_f, sigma_w, max_hold, cuts, sample_cuts)
    side, n, m = kernels._SideBySide(cuts), len(tt), len(cuts) - 1
    gaps = np.diff(tt, prepend=tt[:1])
    gaps[cuts[:-1]] = 0.0
    speed = np.hypot(v[:, 0], v[:, 1])
    r, p = np.zeros((m, 3, 3)), np.zeros((m, 15, 15))
    for i, s in enumerate(side.order):
        a, b, c, d = cuts[s], cuts[s + 1], sample_cuts[s], sample_cuts[s + 1]
        fast = a + np.flatnonzero(speed[a:b] >= 1.0)
        heading = float(np.arctan2(v[fast[0], 0], v[fast[0], 1])) if len(fast) else None
        early = force[c:d][(ts[c:d] >= tt[a]) & (ts[c:d] <= tt[a] + 1.0)]
        r[i] = start_attitude(early.mean(0) if len(early) else np.array([0, 0, -G[2]]), heading)
        p[i] = np.diag(np.concatenate([[9.0, 9, 25, 1, 1, 4], np.array([0.05, 0.05, 0.2 if heading is not None else 2.0]) ** 2, [0.09] * 3, [1e-4] * 3]))
    pos, vel, ba, bg = np.nan_to_num(z[side.begin]), np.nan_to_num(v[side.begin]), np.zeros((m, 3)), np.zeros((m, 3))
    one, eye, swap = np.eye(15), np.eye(3), kernels.swap
    times = lambda a, x: (a @ x[..., None])[..., 0]
    after, before = ([np.zeros((n, 3)), np.zeros((n, 3)), np.zeros((n, 3, 3)), np.zeros((n, 3)), np.zeros((n, 3))] for _ in range(2))
    ps, pp, fs = np.zeros((n, 15, 15)), np.zeros((n, 15, 15)), np.zeros((n, 15, 15))
    missed = np.zeros(m, int)
    var_p, var_v = (np.array([s[0], s[0], s[1]]) ** 2 for s in (sigma_p, sigma_v))
    for k in range(side.longest):
        at = side.rows(k)
        pos, vel, r, ba, bg, p, missed = (x[: len(at)] for x in (pos, vel, r, ba, bg, p, missed))
        h = gaps[at][:, None]
        hh = h[..., None]
        on = ((step.covered[at][:, None] >= h / 2) & (h > 0))[..., None]
        dv, dp = step.v[at] + times(step.v_ba[at], ba) + times(step.v_bg[at], bg), step.p[at] + times(step.p_ba[at], ba) + times(step.p_bg[at], bg)
        dr = step.r[at] @ turn(times(step.r_bg[at], bg))
        f, q = np.tile(one, (len(at), 1, 1)), np.zeros((len(at), 15, 15))
        f[:, P, V] = hh * eye
        f[:, P, A], f[:, P, BA], f[:, P, BG] = (np.where(on, r @ x, 0.0) for x in (-skew(dp), step.p_ba[at], step.p_bg[at]))
        f[:, V, A], f[:, V, BA], f[:, V, BG] = (np.where(on, r @ x, 0.0) for x in (-skew(dv), step.v_ba[at], step.v_bg[at]))
        f[:, A, A], f[:, A, BG] = np.where(on, swap(dr), eye), np.where(on, step.r_bg[at], 0.0)
        world = np.zeros((len(at), 9, 9))
        world[:, 0:3, 6:9] = world[:, 3:6, 3:6] = r
        world[:, 6:9, 0:3] = eye
        # Without samples: constant velocity, with an acceleration that lasts for the step.
        free = np.zeros((len(at), 9, 9))
        free[:, P, P], free[:, P, V], free[:, V, V] = (accel**2 * x * eye for x in (hh**4 / 4, hh**3 / 2, hh**2))
        free[:, V, P] = free[:, P, V]
        free[:, A, A] = np.diag([0.01, 0.01, 0.3]) * np.minimum(hh, 10.0)
        q[:, :9, :9] = np.where(on, world @ step.noise[at] @ swap(world), np.where(hh > 0, free, 0.0))
        q[:, BA, BA], q[:, BG, BG] = eye * walk_f**2 * hh, eye * walk_w**2 * hh
        some = on[..., 0]
        pos = pos + vel * h + np.where(some, G * h * h / 2 + times(r, dp), 0.0)
        vel = vel + np.where(some, G * h + times(r, dv), 0.0)
        r = np.where(on, r @ dr, r)
        p = f @ p @ swap(f) + q
        for into, x in zip(before, (pos, vel, r, ba, bg), strict=True):
            into[at] = x
        pp[at], fs[at] = p, f
        dx = np.zeros((len(at), 15))
        there = np.isfinite(z[at]).all(1)
        p, add, used = kernels.measured(p, one[P], var_p, z[at] - pos, np.repeat(there[:, None], 3, 1), np.where(missed < 5, gate, np.inf))
        dx, missed = dx + add, np.where(there, np.where(used, 0, missed + 1), missed)
        p, add, _ = kernels.measured(p, one[V], var_v, v[at] - vel - dx[:, V], np.isfinite(v[at]), gate)
        dx = dx + add
        stop = still[at]
        if stop.any():
            p, add, _ = kernels.measured(p, one[V], np.full(3, zupt**2), -vel - dx[:, V], np.repeat(stop[:, None], 3, 1))
            dx = dx + add
        # The body's velocity to the left: first order in velocity and attitude.
        own, where = times(swap(r), vel), np.zeros((len(at), 1, 15))
        where[:, 0, V], where[:, 0, A] = r[:, :, 1], skew(own)[:, 1]
        drives = ~stop & (np.hypot(vel[:, 0], vel[:, 1]) >= 1.5)
        p, add, _ = kernels.measured(p, where, np.array([sideways**2]), -own[:, 1:2] - times(where, dx), drives[:, None], gate)
        dx = dx + add
        pos, vel, r, ba, bg = pos + dx[:, P], vel + dx[:, V], r @ turn(dx[:, A]), ba + dx[:, BA], bg + dx[:, BG]
        reset = eye - skew(dx[:, A]) / 2
        p[:, A] = reset @ p[:, A]
        p[:, :, A] = p[:, :, A] @ swap(reset)
        p = (p + swap(p)) / 2
        for into, x in zip(after, (pos, vel, r, ba, bg), strict=True):
            into[at] = x
        ps[at] = p
    for k in range(side.longest - 2, -1, -1):
        nxt = side.rows(k + 1)
        at = nxt - 1
        (sp, sv, sr, sba, sbg), (bp, bv, br, bba, bbg) = ([x[nxt] for x in xs] for xs in (after, before))
        apart = np.concatenate([sp - bp, sv - bv, turned(swap(br) @ sr), sba - bba, sbg - bbg], axis=1)
        gain = swap(np.linalg.solve(pp[nxt] + 1e-12 * one, fs[nxt] @ ps[at]))
        dx = times(gain, apart)
        pos, vel, r, ba, bg = (x[at] for x in after)
        for into, x in zip(after, (pos + dx[:, P], vel + dx[:, V], r @ turn(dx[:, A]), ba + dx[:, BA], bg + dx[:, BG]), strict=True):
            into[at] = x
        if variances:
            ps[at] += gain @ (ps[nxt] - pp[nxt]) @ swap(gain)
    pos, vel, rot, ba, bg = after
    out = {c: x for cs, xs in ((("e_s", "n_s", "u_s"), pos), (("ve_s", "vn_s", "vu_s"), vel), (("bias_ax", "bias_ay", "bias_az"), ba), (("bias_gx", "bias_gy", "bias_gz"), bg)) for c, x in zip(cs, xs.T, strict=True)}
    forward = rot[:, :, 0]
    return out | {
        "yaw_deg": np.degrees(np.arctan2(forward[:, 0], forward[:, 1])) % 360,
        "pitch_deg": np.degrees(np.arcsin(np.clip(forward[:, 2], -1, 1))),
        "roll_deg": np.degrees(np.arctan2(rot[:, 2, 1], rot[:, 2, 2])),
        "sigma_h": np.sqrt(np.maximum(ps[:, 0, 0] + ps[:, 1, 1], 0.0)),
    }


OUT = ("e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s", "bias_ax", "bias_ay", "bias_az", "bias_gx", "bias_gy", "bias_gz", "yaw_deg", "pitch_deg", "roll_deg", "sigma_h")


def smooth_sessions(track: DataFrame, imu: DataFrame, by: str = "session_id", t: str = "utc_s", **options: float) -> DataFrame:
    """track with the smoothed place, velocity, attitude and biases of smooth_all(), many sessions at a time; standing is found from the steps.

    Attitude: yaw from north, clockwise; pitch nose up; roll right side down. A
    session without samples is smoothed at constant velocity; samples of a
    session without epochs give no rows. A whole session is in a task: epochs take about 7 kB each, samples 60 bytes and their sums.
    """
    samples = imu.dropna(subset=[t, "ax", "ay", "az", "gx", "gy", "gz"]).select(by, t, *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "az", "gx", "gy", "gz")])
    run = lambda *sides: smooth_all(*sides, t=t, **options)
    return kernels.per_sessions_with(standing(track, by=by, t=t), samples, run, dict.fromkeys(OUT, T.DoubleType()), by, t)
