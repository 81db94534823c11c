"""Georeferencing, mountings, offsets and warps against plain versions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import georef, rotations, warps


def test_streams_are_read_each_their_own_way(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0, 350.0), (1, 1.0, 20.0, 10.0), (1, 5.0, 60.0, None), (1, None, 0.0, 0.0), (2, 0.0, 1.0, 1.0)], "session_id long, utc_s double, x double, yaw double")
    b = spark.createDataFrame([(1, 0.4, "p"), (1, 0.9, "q"), (1, 9.0, None)], "session_id long, utc_s double, mark string")
    times = [0.0, 0.5, 1.0, 3.0, 5.0, 9.5, -0.2, None]
    asked = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)] + [(3, 0.5, 99)], "session_id long, utc_s double, query_id int")
    got = {r.query_id: (r.x, r.yaw, r.mark) for r in georef.join_streams(asked, [georef.Stream(a, ("x",), ("yaw",), max_gap=2.0), georef.Stream(b, nearest=("mark",), max_gap=0.45)]).collect()}
    assert got == {0: (10.0, 350.0, "p"), 1: (15.0, 0.0, "p"), 2: (20.0, 10.0, "q"), 3: (None, None, None), 4: (60.0, None, None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 99: (None, None, None)}
    with pytest.raises(ValueError):
        georef.join_streams(asked.withColumn("x", F.lit(1)), [georef.Stream(a, ("x",))])


def test_one_shuffle_for_all_streams(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 1.0)], "session_id long, utc_s double, x double, y double").cache()
    streams = [georef.Stream(rows.select("session_id", "utc_s", F.col("x").alias(f"x{i}")), (f"x{i}",)) for i in range(4)]
    plan = georef.join_streams(rows.select("session_id", "utc_s"), streams)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_frames_are_georeferenced_with_one_sort(spark):
    rows = spark.createDataFrame([(1, float(k), *[1.0] * 13) for k in range(3)], "session_id long, utc_s double, lat_deg double, lon_deg double, h_m double, ve double, vn double, vu double, sd_e double, sd_n double, sd_u double, att_yaw double, att_pitch double, att_roll double, trust double").cache()
    got = georef.georeference(rows.select("session_id", "utc_s"), rows, rows.select("session_id", "utc_s", "att_yaw", "att_pitch", "att_roll"), rows.select("session_id", "utc_s", "trust"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and got.count() == 3


def test_one_sort_or_two_read_streams_alike(spark):
    """Random times with ties between queries and samples, missing samples and times; two sorts carry what was found on queries only, and leave them in order of time."""
    rng = np.random.default_rng(3)
    some = lambda x: None if rng.random() < 0.1 else float(x)
    samples = lambda n: [(int(s), some(x) if k % 9 == 0 else float(x), some(rng.normal()), some(rng.uniform(-180, 180))) for s in (1, 2) for k, x in enumerate(rng.permutation(60)[:n] / 2)]
    streams = [georef.Stream(spark.createDataFrame(samples(n), f"session_id long, utc_s double, x{n} double, y{n} double"), (f"x{n}",) if n == 40 else (), (f"y{n}",), (f"x{n}",) if n == 25 else (), gap, (), (f"x{n}",) if n == 9 else ()) for n, gap in ((40, 2.0), (25, 1.0), (9, 5.0))]
    asked = spark.createDataFrame([(s, some(x / 4), k) for s in (1, 2, 3) for k, x in enumerate(range(-4, 130))], "session_id long, utc_s double, query_id int")
    two, one = (georef.join_streams(asked, streams, one_sort=o) for o in (False, True))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.dropna().count() > 10
    assert two.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("utc_s")))._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2


def test_mounting_is_kabsch_without_strays(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for s in range(3):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        r = q * np.sign(np.linalg.det(q))
        own = rng.normal(size=(80, 3))
        to = own @ r.T + rng.normal(0, 0.01, own.shape)
        to[:8] = rng.normal(size=(8, 3))
        rows += [(s, *map(float, t), *map(float, o * 5)) for t, o in zip(to, own)]
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        t, o = unit(to), unit(own)
        keep = np.ones(80, bool)
        for _ in range(3):
            u, _, v = np.linalg.svd(t[keep].T @ o[keep])
            best = u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v
            angles = np.degrees(np.arccos(np.clip((t * (o @ best.T)).sum(1), -1, 1)))
            n, keep = int(keep.sum()), angles <= 20
        want[s] = best, n, np.sort(angles)[40], r
    rows += [(7, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (8, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (8, None, 0.0, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "session_id long, tx double, ty double, tz double, ox double, oy double, oz double")
    got = {r.session_id: r for r in rotations.mounting(df, ["tx", "ty", "tz"], ["ox", "oy", "oz"]).collect()}
    assert set(got) == set(want)
    for s, (best, n, median, r) in want.items():
        mine = np.array([got[s][c] for c in rotations.R]).reshape(3, 3)
        assert np.allclose(mine, best, atol=1e-9) and np.abs(mine - r).max() < 0.02 and got[s].n == n and abs(got[s].median_deg - median) < 1e-6
    assert rotations.mounting(df.limit(0), ["tx", "ty", "tz"], ["ox", "oy", "oz"]).count() == 0


def test_offset_search_finds_the_shift(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], []
    for s, shift in ((1, 0.6125), (2, -1.4), (3, 0.0)):
        t = np.arange(0, 90, 0.5)
        path = lambda x: (30 * np.sin(x / 7) + 3 * x, 20 * np.cos(x / 5))
        truth += [(s, float(x), *map(float, path(x))) for x in t if not 30 < x < 36]
        at = np.arange(2, 88, 1.0)
        rows += [(s, float(x - shift), *[float(c + rng.normal(0, 0.05)) for c in path(x)]) for x in at]
    df = spark.createDataFrame(rows + [(4, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0)], "session_id long, utc_s double, e_m double, n_m double")
    gt = spark.createDataFrame(truth + [(1, 0.0, 30 * 0.0, 20.0)], "session_id long, utc_s double, gt_e double, gt_n double")
    got = {r.session_id: r for r in warps.time_offset(df, gt).collect()}
    assert set(got) == {1, 2, 3}
    for s, shift in ((1, 0.6125), (2, -1.4), (3, 0.0)):
        assert abs(got[s].lag_s - shift) <= 0.005 and got[s].cost_m < 0.1 and got[s].n > 70


def test_curve_goes_through_its_rows_and_is_exact_for_parabolas(spark):
    t = [0.0, 1.0, 2.5, 3.0, 5.0]
    f = lambda x: 2 + 3 * x - 0.5 * x * x
    track = spark.createDataFrame([(1, x, f(x), -f(x)) for x in t], "session_id long, utc_s double, e double, n double")
    for r in warps.hermite(track, ("e", "n")).collect():
        for x in (r.t0, r.t1):
            s = x - r.t0
            assert abs(r.e_0 + s * (r.e_1 + s * (r.e_2 + s * r.e_3)) - f(x)) < 1e-9
        if r.t0 > 0 and r.t1 < 5:
            s = (r.t1 - r.t0) / 2
            assert abs(r.n_0 + s * (r.n_1 + s * (r.n_2 + s * r.n_3)) + f(r.t0 + s)) < 1e-9


def test_warps_never_run_back(spark):
    points = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 30.0), (1, 12.0, 25.0), (1, 20.0, 35.0), (1, 20.0, 90.0), (1, None, 1.0), (2, 5.0, 6.0)], "session_id long, from_s double, to_s double")
    asked = [(1, -1.0), (1, 0.0), (1, 5.0), (1, 10.0), (1, 15.0), (1, 20.0), (1, 22.0), (2, 1.0), (2, 9.0), (3, 1.0), (1, None)]
    df = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(asked)], "session_id long, utc_s double, query_id int")
    got = {r.query_id: r.warped_s for r in warps.stretch(df, points).collect()}
    want = [8.0, 10.0, 20.0, 30.0, 32.5, 35.0, 36.0, 2.0, 10.0, None, None]
    assert len(got) == len(want) and all((got[i] is None) == (w is None) and (w is None or abs(got[i] - w) < 1e-9) for i, w in enumerate(want))
