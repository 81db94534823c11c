"""Attitude, angles of frames and video velocity against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from tracelake.operators import attitude, georef, video

IMU = "session_id long, utc_s double, ax double, ay double, az double, gx double, gy double, gz double"


def test_streams_hold_and_look_ahead(spark):
    marks = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b"), (1, 9.0, None)], "session_id long, utc_s double, m string")
    asked = spark.createDataFrame([(1, t, i) for i, t in enumerate([0.5, 1.0, 1.5, 3.0, 8.0, 9.5])], "session_id long, utc_s double, query_id int")
    streams = [georef.Stream(marks, held=("m",), max_gap=3.0), georef.Stream(marks.withColumnRenamed("m", "n"), ahead=("n",), max_gap=0.5)]
    got = {r.query_id: (r.m, r.n) for r in georef.join_streams(asked, streams).collect()}
    assert got == {0: (None, "a"), 1: ("a", "a"), 2: ("a", "b"), 3: ("b", None), 4: (None, None), 5: (None, None)}


def _matrix(axis, angle):
    k = np.cross(np.eye(3), axis)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def _plain(samples, epochs, kp=2.0, ki=0.005):
    """One session, a sample at a time, with rotation matrices (columns: body axes in north, west, up)."""
    t, acc, gyr = samples[:, 0], samples[:, 1:4], samples[:, 4:7]
    te, ve, vn = epochs.T
    slow = np.hypot(ve, vn) < 0.4
    stops, k = [], 0
    while k < len(te):
        if slow[k]:
            end = next((i for i in range(k, len(te)) if not slow[i]), len(te) - 1)
            if te[end] - te[k] >= 1.5:
                stops.append((te[k], te[end]))
            k = max(end, k + 1)
            while k < len(te) and slow[k]:
                k += 1
        else:
            k += 1

    def yaw(r):
        return math.atan2(r[1, 0], r[0, 0])

    def turn(r, angle):
        return _matrix(np.array([0, 0, 1.0]), angle - yaw(r)) @ r

    def upright(f):
        f = f / np.linalg.norm(f)
        axis = np.cross(f, [0, 0, 1.0])
        s = np.linalg.norm(axis)
        return np.eye(3) if s < 1e-12 else _matrix(axis / s, math.atan2(s, f[2]))

    snaps, first, begin = {}, acc[0], 0
    for no, (a, b) in enumerate(stops):
        inside = (t >= a) & (t < b)
        if inside.sum() >= 5:
            i = int(np.searchsorted(t, (a + b) / 2))
            if i < len(t) and (no + 1 == len(stops) or t[i] < stops[no + 1][0]):
                snaps[i] = acc[inside].mean(0)
            if no == 0 and np.linalg.norm(acc[inside].mean(0)) > 5:
                first, begin = acc[inside].mean(0), int(np.flatnonzero(inside)[0])
    r = upright(first)
    ahead = [i for i in range(len(te)) if te[i] >= t[begin] and math.hypot(ve[i], vn[i]) > 1]
    if ahead:
        r = turn(r, -math.atan2(ve[ahead[0]], vn[ahead[0]]))
    out, bias = [], np.zeros(3)
    for i in range(len(t)):
        if i >= begin:
            if i in snaps:
                r, bias = turn(upright(snaps[i]), yaw(r)), np.zeros(3)
            dt = t[i] - t[i - 1] if i > begin else 0.0
            n = math.ceil(dt / 0.05) if dt > 0 else 0
            for _ in range(n):
                e = np.zeros(3)
                size = np.linalg.norm(acc[i])
                if abs(size - 9.80665) < 2 and np.linalg.norm(gyr[i]) < 2:
                    e = np.cross(acc[i] / size, r[2])
                bias = bias + ki * e * dt / n
                w = gyr[i] + kp * e + bias
                # A quaternion step of half the turn, then normalised, turns by twice the arc tangent of it.
                half = np.linalg.norm(w) * dt / n / 2
                if half > 0:
                    r = r @ _matrix(w / np.linalg.norm(w), 2 * math.atan(half))
            if n:
                e, nn = np.interp(t[i], te, ve), np.interp(t[i], te, vn)
                if math.hypot(e, nn) > 0.5:
                    r = turn(r, -math.atan2(e, nn))
        out.append((math.degrees(-yaw(r)) % 360, math.degrees(-math.asin(max(-1, min(1, r[2, 0])))), math.degrees(math.atan2(r[2, 1], r[2, 2]))))
    return np.array(out)


def _drive(seed, still_first):
    rng = np.random.default_rng(seed)
    te = np.arange(0, 60, 1.0)
    speed = np.where((te >= 20) & (te < 30) | ((te < 6) & still_first), 0.0, 8.0)
    course = 0.3 + 0.03 * te
    epochs = np.stack([te, speed * np.sin(course), speed * np.cos(course)], 1)
    t = np.sort(np.concatenate([np.arange(-1, 25, 0.1), np.arange(26, 61, 0.1)])) + 0.013
    base = np.array([1.2, -0.7, 9.7])
    acc = base + rng.normal(0, 0.3, (len(t), 3))
    gyr = rng.normal(0, 0.05, (len(t), 3))
    acc[40] *= 3
    return np.hstack([t[:, None], acc, gyr]), epochs


def test_headed_equals_a_plain_fold(spark):
    drives = {1: _drive(1, False), 2: _drive(2, True), 3: (_drive(3, True)[0][:50], _drive(3, True)[1])}
    imu = [(s, *map(float, r)) for s, (a, _) in drives.items() for r in a]
    epochs = [(s, *map(float, r)) for s, (_, e) in drives.items() for r in e]
    imu += [(1, None, 1.0, 1.0, 9.0, 0.0, 0.0, 0.0), (1, 3.3, None, 1.0, 9.0, 0.0, 0.0, 0.0), (2, 3.3, float("nan"), 1.0, 9.0, 0.0, 0.0, 0.0), (9, 0.0, 0.0, 0.0, 9.8, 0.0, 0.0, 0.0)]
    samples = spark.createDataFrame(imu, IMU)
    track = spark.createDataFrame(epochs, "session_id long, utc_s double, ve double, vn double")
    got = attitude.headed(samples.withColumn("heading_name", F.lit("x")), track)
    assert got.columns == [*samples.columns, "heading_name", "qw", "qx", "qy", "qz", "att_yaw", "att_pitch", "att_roll"]
    rows = got.orderBy("session_id", "utc_s").collect()
    for s, (a, e) in drives.items():
        mine = np.array([(r.att_yaw, r.att_pitch, r.att_roll) for r in rows if r.session_id == s])
        want = _plain(a, e)
        assert mine.shape == want.shape
        off = (mine - want + 180) % 360 - 180
        assert np.abs(off).max() < 1e-6
    alone = [r for r in rows if r.session_id == 9]
    assert len(alone) == 1 and abs(alone[0].att_pitch) < 1e-9 and alone[0].att_yaw == 0
    assert attitude.headed(samples.limit(0), track).count() == 0
    assert attitude.headed(samples, track.limit(0)).count() == len(rows)


def test_yaw_goes_the_gyros_way_in_a_stop(spark):
    """A left turn (counter-clockwise about up) while standing lowers the compass heading; tilt stays."""
    t = np.arange(0, 20, 0.02)
    imu = spark.createDataFrame([(1, float(x), 0.0, 0.0, 9.80665, 0.0, 0.0, 0.1 if x > 12 else 0.0) for x in t], IMU)
    track = spark.createDataFrame([(1, float(x), 5.0 if 3 <= x < 10 else 0.0, 0.0) for x in range(21)], "session_id long, utc_s double, ve double, vn double")
    last = attitude.headed(imu, track).orderBy(F.desc("utc_s")).first()
    assert abs(last.att_yaw - (90 - math.degrees(0.1 * (t[-1] - 12)))) < 0.5 and abs(last.att_roll) < 1e-6


def test_tilts_of_frames(spark):
    frames = spark.createDataFrame([(1, 0.5, 1), (1, 5.0, 2), (1, 7.0, 3), (1, 30.0, 4), (2, 1.0, 5), (1, None, 6)], "session_id long, utc_s double, frame_id int")
    device = spark.createDataFrame([(1, i / 20, 359.0 if i % 2 else 1.0, 3.0, 179.0 if i % 2 else -179.0) for i in range(200)] + [(1, None, 0.0, 0.0, 0.0)], "session_id long, utc_s double, att_yaw double, att_pitch double, att_roll double")
    still = spark.createDataFrame([(1, 4.0, 6.0, 1.5, -2.5)], "session_id long, start_s double, end_s double, pitch_deg double, roll_deg double")
    got = {r.frame_id: r for r in attitude.frame_tilts(frames, device, still, hz=20.0).collect()}
    assert got[1].tilt_source == "orientation" and abs((got[1].att_yaw + 180) % 360 - 180) < 0.3 and abs(got[1].att_pitch - 3) < 1e-9 and abs(abs(got[1].att_roll) - 180) < 0.3
    assert (got[2].tilt_source, got[2].att_pitch, got[2].att_roll) == ("gravity", 1.5, -2.5)
    assert got[3].tilt_source == "orientation" and all(got[i].tilt_source is None and got[i].att_pitch is None for i in (4, 5, 6))
    assert {r.frame_id for r in attitude.frame_tilts(frames, device.limit(0), None).collect()} == {1, 2, 3, 4, 5, 6}
    assert attitude.thinned(device, 5.0).count() == 50


def test_merged_yaw(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (None, 2.0), (None, float("nan"))], "v double, p double")
    assert [r.y for r in rows.select(attitude.merged_yaw(F.col("v"), F.col("p")).alias("y")).collect()] == [1.0, 2.0, 2.0, None]


def test_video_velocity_and_blend(spark):
    rng = np.random.default_rng(0)
    te = np.arange(0, 30, 1.0)
    ve, vn = 6 + np.sin(te), 3 + np.cos(te / 2)
    vn[7] = np.nan
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    mount = q * np.sign(np.linalg.det(q))
    t = np.sort(rng.uniform(0.1, 28.9, 80))
    c = rng.normal(size=(80, 3))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    track = spark.createDataFrame([(1, float(a), float(b), float(x)) for a, b, x in zip(te, ve, vn)], "session_id long, utc_s double, ve double, vn double")
    seen = spark.createDataFrame([(1, float(a), *map(float, b)) for a, b in zip(t, c)] + [(1, 99.0, 1.0, 0.0, 0.0), (1, 5.0, None, 0.0, 1.0), (2, 5.0, 1.0, 0.0, 0.0)], "session_id long, utc_s double, c_x double, c_y double, c_z double")
    mountings = spark.createDataFrame([(1, *map(float, mount.ravel()))], "session_id long, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
    ok = np.isfinite(vn)
    x, e, n = te[ok], ve[ok], vn[ok]
    speed = np.array([np.median(np.hypot(e, n)[np.abs(x - a) <= 5]) for a in x])
    want = []
    for a, d in zip(t, c):
        fwd, right, down = mount @ d
        h = math.atan2(np.interp(a, x, e), np.interp(a, x, n))
        want.append(np.interp(a, x, speed) * np.array([math.sin(h) * fwd + math.cos(h) * right, math.cos(h) * fwd - math.sin(h) * right, -down]))
    velocity = video.velocities(seen, track, mountings)
    got = np.array([(r.v_e, r.v_n, r.v_u) for r in velocity.orderBy("utc_s").collect()])
    assert got.shape == (80, 3) and np.abs(got - np.array(want)).max() < 1e-9

    enu = spark.createDataFrame([(1, float(a), float(a * 5), float(-a)) for a in te] + [(2, 0.0, 1.0, 1.0)], "session_id long, utc_s double, e_m double, n_m double")
    few = velocity.where("utc_s < 10 OR utc_s > 12")
    v = np.array(want)[(t < 10) | (t > 12)]
    at = t[(t < 10) | (t > 12)]
    rows = {(r.session_id, r.utc_s): r for r in video.blend(enu, few).collect()}
    assert rows[(2, 0.0)].e_m == 1.0 and len(rows) == 31
    for a, b in zip(te[:-1], te[1:]):
        inside = (at > a) & (at <= b)
        r = rows[(1, b)]
        if not inside.any():
            assert (r.e_m, r.n_m, r.n_video) == (b * 5, -b, 0)
            continue
        times, vs = np.concatenate([[a], at[inside], [b]]), np.vstack([v[inside][:1], v[inside], v[inside][-1:]])
        way = ((vs[1:] + vs[:-1]) / 2 * np.diff(times)[:, None]).sum(0)
        assert abs(r.e_m - (a * 5 + way[0])) < 1e-9 and abs(r.n_m - (-a + way[1])) < 1e-9 and r.n_video == inside.sum()
