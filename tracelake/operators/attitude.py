"""Attitude of a device from gyros, gravity and Doppler, and the angles of frames.

What a sample needs (velocity at its time, the stop that it is in, the next heading, gravity
averaged over the stop) is joined and summed on Spark; only the fold itself runs
in NumPy, a step of time for many sessions at once. The world's axes are north, west and up;
yaw is told as a compass heading.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.angles import wrap_deg
from tracelake.operators import georef, islands, kernels, ranges, smoothing

G = 9.80665
FORCE, RATE = ("ax", "ay", "az"), ("gx", "gy", "gz")
#: Longest step of the fold; longer ones are taken in equal parts.
STEP_S = 0.05
#: Force and turn rate between which a sample is taken for gravity.
FORCE_BAND, RATE_LIMIT = 2.0, 2.0


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of quaternions, row by row."""
    v = a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:])
    return np.hstack([a[:, :1] * b[:, :1] - (a[:, 1:] * b[:, 1:]).sum(1, keepdims=True), v])


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def yaw(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    return np.arctan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def turned_to(q: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Quaternions turned about up so that their yaw is angle; pitch and roll stay."""
    half = (angle - yaw(q)) / 2
    zero = np.zeros(len(q))
    return _unit(_times(np.stack([np.cos(half), zero, zero, np.sin(half)], 1), q))


def upright(force: np.ndarray) -> np.ndarray:
    """The least turns that bring measured gravity up; forces below 1 m/s2 turn nothing."""
    size = np.linalg.norm(force, axis=1, keepdims=True)
    f = np.where(size >= 1, force / np.maximum(size, 1e-12), [0.0, 0.0, 1.0])
    # Half-way between a direction and up lies the axis: (1 + f.up, f x up), normalised; upside down, any level axis.
    q = np.stack([1 + f[:, 2], f[:, 1], -f[:, 0], np.zeros(len(f))], 1)
    q[f[:, 2] < -1 + 1e-12] = [0.0, 1.0, 0.0, 0.0]
    return _unit(q)


def fold(cuts: np.ndarray, t: np.ndarray, rate: np.ndarray, force: np.ndarray, heading: np.ndarray, gravity: np.ndarray, start: np.ndarray, first: np.ndarray, course: np.ndarray, kp: float, ki: float) -> np.ndarray:
    """Quaternions of every row; session s is at rows cuts[s] to cuts[s + 1].

    heading: compass radians that the row's yaw is set to, gravity: force that its tilt is
    set to first (NaN: none). Of each session: start, the row (within the session) that
    the fold begins at, those before it get the first attitude; first, the force it is set upright
    by; course, its first heading (NaN: none).
    """
    side = kernels._SideBySide(cuts)
    start, first, course = start[side.order], first[side.order], course[side.order]
    q = upright(first)
    known = np.isfinite(course)
    q[known] = turned_to(q[known], -course[known])
    bias, out = np.zeros((len(q), 3)), np.empty((len(t), 4))
    for k in range(side.longest):
        rows = side.rows(k)
        m = len(rows)
        live = k >= start[:m]
        level = np.flatnonzero(live & (np.linalg.norm(np.nan_to_num(gravity[rows]), axis=1) >= 1))
        if len(level):
            q[level] = turned_to(upright(gravity[rows[level]]), yaw(q[level]))
            bias[level] = 0.0
        dt = np.where(k > start[:m], t[rows] - t[rows - 1], 0.0)
        steps = np.where(dt > 0, np.maximum(1, np.ceil(dt / STEP_S)), 0).astype(int)
        size = np.linalg.norm(force[rows], axis=1)
        calm = (np.abs(size - G) < FORCE_BAND) & (np.linalg.norm(rate[rows], axis=1) < RATE_LIMIT)
        for i in range(int(steps.max(initial=0))):
            on = np.flatnonzero(steps > i)
            w, x, y, z = q[on].T
            up = np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], 1)
            error = np.where(calm[on, None], np.cross(force[rows[on]] / np.maximum(size[on, None], 1e-12), up), 0.0)
            h = (dt[on] / steps[on])[:, None]
            bias[on] += ki * error * h
            turn = np.hstack([np.zeros((len(on), 1)), rate[rows[on]] + kp * error + bias[on]])
            q[on] = _unit(q[on] + 0.5 * h * _times(q[on], turn))
        snap = np.flatnonzero((steps > 0) & np.isfinite(heading[rows]))
        q[snap] = turned_to(q[snap], -heading[rows[snap]])
        out[rows] = q[:m]
    return out


def stop_gravity(imu: DataFrame, stops: DataFrame, least: int = 20, floor: float = 5.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, start_s, end_s, mid_s, n, f_x, f_y, f_z, pitch_deg, roll_deg of each stop (start_s <= t < end_s) with least samples or more and a mean force of floor or more.

    A device at rest feels gravity alone, so that its mean tells pitch and roll
    without drift. Samples with a missing component or time are left out.
    """
    rows = imu.select(by, t, *[_known(c).alias(c) for c in FORCE]).dropna()
    inside = ranges.interval_join(rows, stops.select(by, "start_s", "end_s"), t=t, by=by).where(F.col(t) < F.col("end_s"))
    mean = inside.groupBy(by, "start_s", "end_s").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"f_{c[1]}") for c in FORCE])
    x, y, z = F.col("f_x"), F.col("f_y"), F.col("f_z")
    mean = mean.where((F.col("n") >= least) & (F.sqrt(x * x + y * y + z * z) >= floor))
    return mean.withColumns({"mid_s": (F.col("start_s") + F.col("end_s")) / 2, "pitch_deg": F.degrees(-F.atan2(x, F.sqrt(y * y + z * z))), "roll_deg": F.degrees(F.atan2(y, z))})


def prepared(imu: DataFrame, track: DataFrame, min_speed: float = 0.5, course_speed: float = 1.0, least: int = 5, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """imu's rows with heading (compass radians while Doppler, on a line between epochs and held at the ends, exceeds min_speed), course (heading of the next epoch faster than course_speed), stop_no, in_stop, n_still and f_x, f_y, f_z (mean force of the stop) and level (whether the row is the first at or after the middle of a stop with least samples)."""
    epochs = track.select(by, t, _known("ve").alias("__e"), _known("vn").alias("__n"))
    fast = epochs.where(F.sqrt(F.col("__e") ** 2 + F.col("__n") ** 2) > course_speed).select(by, t, F.atan2("__e", "__n").alias("course"))
    order = Window.partitionBy(by).orderBy("start_s")
    stops = islands.static_periods(track, by=by, t=t).select(by, F.col("start_s").alias(t), F.row_number().over(order).alias("stop_no"), F.col("end_s").alias("__end"), ((F.col("start_s") + F.col("end_s")) / 2).alias("__mid"))
    ever = float("inf")
    streams = [
        georef.Stream(epochs.withColumns({"__in": F.lit(1.0), "__e0": F.col("__e"), "__n0": F.col("__n")}), linear=("__e", "__n", "__in"), nearest=("__e0", "__n0"), max_gap=ever),
        georef.Stream(fast, ahead=("course",), max_gap=ever),
        georef.Stream(stops, held=("stop_no", "__end", "__mid"), max_gap=ever),
    ]
    rows = georef.join_streams(imu.withColumns({c: _known(c) for c in (*FORCE, *RATE)}).dropna(subset=[by, t, *FORCE, *RATE]), streams, by, t)
    e, n = (F.when(F.col("__in").isNull(), F.col(f"{c}0")).otherwise(F.col(c)) for c in ("__e", "__n"))
    rows = rows.withColumns({"heading": F.when(F.sqrt(e * e + n * n) > min_speed, F.atan2(e, n)), "in_stop": F.coalesce(F.col(t) < F.col("__end"), F.lit(False))})
    session, stop = Window.partitionBy(by).orderBy(t), Window.partitionBy(by, "stop_no")
    rows = rows.withColumns({"__past": F.coalesce(F.col(t) >= F.col("__mid"), F.lit(False))})
    rows = rows.withColumn("__first", F.col("__past") & ~F.coalesce(F.lag("__past").over(session) & F.lag("stop_no").over(session).eqNullSafe(F.col("stop_no")), F.lit(False)))
    still = {f"f_{c[1]}": F.avg(F.when(F.col("in_stop"), F.col(c))).over(stop) for c in FORCE}
    rows = rows.withColumns(still | {"n_still": F.count(F.when(F.col("in_stop"), 1)).over(stop)})
    return rows.withColumn("level", F.col("__first") & (F.col("n_still") >= least)).drop("__e", "__n", "__in", "__e0", "__n0", "__end", "__mid", "__past", "__first")


def headed(imu: DataFrame, track: DataFrame, kp: float = 2.0, ki: float = 0.005, least: int = 5, by: str = "session_id", t: str = "utc_s", **speeds: float) -> DataFrame:
    """imu's rows with qw, qx, qy, qz (body to north, west, up) and att_yaw (compass, 0 to 360), att_pitch, att_roll in degrees.

    Gyros turn the attitude and calm samples pull its tilt to gravity. While the
    vehicle drives, Doppler's heading sets the yaw at every sample and leaves the tilt alone; while it
    stands, yaw goes on by the gyros. Half-way through a stop (its first sample at or
    after the middle, before the next stop) the mean force of the stop sets the tilt, and
    the gyros' bias starts anew. A session begins at its first stop, if that has least samples
    and a mean force above 5, else at its first sample; the next heading is its first yaw, and
    samples before have the attitude it begins with. Rows without a session, a time or a component are left out; without
    epochs there is no heading. Of equal times the order is open.
    """
    rows = prepared(imu, track, least=least, by=by, t=t, **speeds)

    def run(d: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        at = cuts[:-1]
        rate, force, still = (d[list(c)].to_numpy(float) for c in (RATE, FORCE, ("f_x", "f_y", "f_z")))
        begins = (d["stop_no"] == 1) & d["in_stop"] & (d["n_still"] >= least) & (np.linalg.norm(np.nan_to_num(still), axis=1) > 5)
        hits = np.flatnonzero(begins.to_numpy(bool))
        near = np.searchsorted(hits, at)
        found = (near < len(hits)) & (np.append(hits, len(d))[near] < cuts[1:])
        row = np.where(found, np.append(hits, 0)[np.minimum(near, len(hits))], at)
        q = fold(cuts, d[t].to_numpy(float), rate, force, d["heading"].to_numpy(float), np.where(d["level"].to_numpy(bool)[:, None], still, np.nan), row - at, np.where(found[:, None], still[row], force[at]), d["course"].to_numpy(float)[row], kp, ki)
        w, x, y, z = q.T
        return {
            **dict(zip(("qw", "qx", "qy", "qz"), q.T, strict=True)),
            "att_yaw": np.degrees(-yaw(q)) % 360.0,
            "att_pitch": np.degrees(np.arcsin(np.clip(2 * (w * y - z * x), -1, 1))),
            "att_roll": np.degrees(np.arctan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))),
        }

    got = kernels.per_sessions(rows, run, {c: T.DoubleType() for c in ("qw", "qx", "qy", "qz", "att_yaw", "att_pitch", "att_roll")}, by, t)
    return got.drop("heading", "course", "stop_no", "in_stop", "n_still", "f_x", "f_y", "f_z", "level")


def thinned(samples: DataFrame, hz: float, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """The first sample of each 1 / hz seconds from the session's first one on; none without a time."""
    w = Window.partitionBy(by).orderBy(t)
    rows = samples.where(F.col(t).isNotNull()).withColumn("__slot", F.floor((F.col(t) - F.first(t).over(w)) * hz))
    return rows.withColumn("__new", ~F.lag("__slot").over(w).eqNullSafe(F.col("__slot"))).where("__new").drop("__slot", "__new")


def frame_tilts(frames: DataFrame, orientation: DataFrame, gravity: DataFrame | None = None, hz: float = 10.0, sigma_s: float = 0.5, max_gap: float = 2.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """frames with att_yaw, att_pitch, att_roll (degrees) at their times and tilt_source (gravity, orientation, null).

    orientation (att_yaw, att_pitch, att_roll) is thinned to hz, smoothed by a Gaussian of
    sigma_s seconds of time (angles of a circle by sine and cosine) and interpolated over
    gaps up to max_gap. In a stop, start_s and end_s included, pitch and roll
    are those of gravity (stop_gravity()'s rows), which doesn't drift.
    """
    rows = thinned(orientation.select(by, t, "att_yaw", "att_pitch", "att_roll"), hz, by, t)
    if sigma_s > 0:
        round_ = ("att_yaw", "att_roll")
        parts = {f"__{f.__name__}_{c}": f(F.radians(c)) for c in round_ for f in (F.sin, F.cos)}
        rows = rows.withColumns(parts)
        for c in ("att_pitch", *parts):
            rows = smoothing.gaussian_time(rows, c, sigma_s, [by], t, name=f"{c}_s")
        arcs = {c: F.pmod(F.degrees(F.atan2(f"__sin_{c}_s", f"__cos_{c}_s")), F.lit(360.0)) for c in round_}
        rows = rows.select(by, t, F.col("att_pitch_s").alias("att_pitch"), *[a.alias(c) for c, a in arcs.items()])
    streams = [georef.Stream(rows, linear=("att_pitch",), circular=("att_yaw", "att_roll"), max_gap=max_gap)]
    if gravity is not None:
        held = gravity.select(by, F.col("start_s").alias(t), F.col("end_s").alias("__end"), F.col("pitch_deg").alias("__pitch"), F.col("roll_deg").alias("__roll"))
        streams.append(georef.Stream(held, held=("__end", "__pitch", "__roll"), max_gap=float("inf")))
    found = georef.join_streams(frames, streams, by, t)
    roll = wrap_deg(F.col("att_roll"))
    source = F.when(F.col("att_pitch").isNotNull(), "orientation")
    if gravity is None:
        return found.withColumns({"att_roll": roll, "tilt_source": source})
    still = F.coalesce(F.col(t) <= F.col("__end"), F.lit(False))
    found = found.withColumns({"att_pitch": F.when(still, F.col("__pitch")).otherwise(F.col("att_pitch")), "att_roll": F.when(still, F.col("__roll")).otherwise(roll), "tilt_source": F.when(still, "gravity").otherwise(source)})
    return found.drop("__end", "__pitch", "__roll")


def merged_yaw(velocity: Column, path: Column) -> Column:
    """Doppler's heading, else the path's; NaN counts as missing."""
    return F.coalesce(F.when(~F.isnan(velocity), velocity), F.when(~F.isnan(path), path))
