"""Kernels and joins on small cases with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types

from tracelake.functions import geo, timefn
from tracelake.operators import asof, islands, kernels, masks, motion, ranges, smoothers, smoothing, stats

T = "session_id long, utc_s double, v double"


def values(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_interpolation_at_ends_and_in_gaps(spark):
    samples = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 5.0, 50.0), (2, 0.0, 7.0)], T)
    queries = spark.createDataFrame([(1, q, k) for k, q in enumerate([0.0, 0.25, 1.0, 3.0, 5.0, 6.0, -1.0])], "session_id long, utc_s double, query_id long")
    rows = {r.query_id: r for r in asof.interpolated(asof.bracket(queries, samples, ["v"]), ["v"]).collect()}
    # The first sample is fine; an inner exact hit counts the gap before it; gaps and outside give null.
    assert [rows[k].v for k in range(7)] == [0.0, 2.5, 10.0, None, None, None, None]


def test_nearest_ties_and_tolerance(spark):
    samples = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 20.0)], T)
    queries = spark.createDataFrame([(1, 1.0, 0), (1, 1.5, 1), (1, 9.0, 2)], "session_id long, utc_s double, query_id long")
    b = asof.bracket(queries, samples, ["v"])
    pick = lambda df: [r.v for r in df.orderBy("query_id").collect()]
    assert pick(asof.nearest(b, ["v"])) == [0.0, 20.0, 20.0]
    assert pick(asof.nearest(b, ["v"], tie="later", tolerance=1.0)) == [20.0, 20.0, None]
    assert pick(asof.step(queries, samples, ["v"])) == [0.0, 0.0, 20.0]


def test_band_join_is_exact_at_bucket_edges(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 20, 80).round(2), rng.uniform(0, 20, 80).round(2)
    left = spark.createDataFrame([(1, float(x), float(x)) for x in a], T)
    right = spark.createDataFrame([(1, float(x), float(x)) for x in b], T)
    got = sorted((r.v, r.v_r) for r in ranges.band_join(left, right, 0.5).collect())
    assert got == sorted((x, y) for x in a for y in b if abs(x - y) < 0.5)


def test_runs_are_repaired_or_dropped(spark):
    bad = [False, True, True, False, False] + [True] * 12 + [False]
    rows = [(1, float(k), 100.0 if b else float(k), b) for k, b in enumerate(bad)]
    out = islands.bridge_bad_runs(spark.createDataFrame(rows, T + ", bad boolean"), "bad", ["v"]).orderBy("utc_s").collect()
    assert [r.outcome for r in out] == ["kept", "repaired", "repaired", "kept", "kept"] + ["dropped"] * 12 + ["kept"]
    assert [r.v for r in out[:4]] == [0.0, 1.0, 2.0, 3.0] and out[-1].gap


def test_smoothing_keeps_constants_and_lowers_noise(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 1, 200)
    rows = spark.createDataFrame([(1, float(k), float(x)) for k, x in enumerate(noise)], T).withColumn("c", F.lit(3.0))
    out = smoothing.gaussian_rows(rows, ["v", "c"], 3.0).orderBy("utc_s").toPandas()
    assert np.allclose(out.c_s, 3.0) and out.v_s.std() < 0.5
    padded = np.pad(noise, 12, mode="edge")
    assert np.allclose(out.v_s, np.convolve(padded, smoothing.gaussian_kernel(3.0), "valid"))


def test_filters_follow_straight_lines_and_lower_noise():
    t = np.arange(120.0)
    line = 13.0 * t
    noisy = line + np.random.default_rng(0).normal(0, 0.5, 120)
    assert np.allclose(kernels.cv_rts(line, 1.0)[10:-10], line[10:-10], atol=0.5)
    for got in (kernels.cv_rts(noisy, 1.0, 0.5, 0.1), kernels.rts_irregular(noisy, t, 0.25, 0.1)[0], kernels.cv_rts_pv(noisy, np.full(120, 13.0), np.ones(120, bool), 1.0)):
        assert np.abs(got - line)[5:-5].mean() < np.abs(noisy - line)[5:-5].mean()
    gap = noisy.copy()
    gap[40:50] = np.nan
    assert np.isfinite(kernels.cv_rts(gap, 1.0)).all() and np.isnan(kernels.cv_rts(np.full(3, np.nan), 1.0)).all()


def test_sigma_filter_restarts_after_holes():
    t = np.concatenate([np.arange(50.0), np.arange(100.0, 150.0)])
    rows = pd.DataFrame({"utc_s": t, "e_m": np.where(t < 60, 5 * t, -3 * t), "n_m": 0.0, "u_m": 0.0, "sd_n": 0.1, "sd_e": 0.1, "sd_u": np.nan})
    out = kernels.kalman_sigma(rows)
    assert np.abs(out["e_s"] - rows["e_m"]).max() < 0.5
    assert abs(np.median(out["ve_s"][70:]) + 3) < 0.1 and (out["sigma_h"] > 0).all()


def test_weighted_filter_trusts_good_epochs():
    t = np.arange(60.0)
    sd = np.where(t == 30, 8.0, 0.1)
    rows = pd.DataFrame({"utc_s": t, "e_m": np.where(t == 30, 9.0, 0.0), "n_m": 11.0 * t, "u_m": 0.0, "ve": 0.0, "vn": 11.0, "vu": np.nan, "sd_n": sd, "sd_e": sd})
    out = kernels.epoch_weighted_v2(rows)
    assert abs(out["e_s"][30]) < 0.5 and out["disagree_m"][30] > 8


def test_canyon_epochs_weigh_less():
    t = np.arange(60.0)
    bad = (t > 25) & (t < 35)
    rows = pd.DataFrame({"utc_s": t, "e_m": np.where(bad, 6.0, 0.0), "n_m": 11.0 * t, "u_m": 0.0, "ve": 0.0, "vn": 11.0, "vu": np.nan, "sd_n": 0.5, "sd_e": 0.5, "ns": np.where(bad, 5, 12), "quality": np.where(bad, 2, 1)})
    plain, canyon = (np.abs(kernels.epoch_weighted_v2(rows, **o)["e_s"]).max() for o in ({}, {"canyon": 15.0, "gate": 5.0}))
    assert canyon < 0.5 * plain


def test_kept_history_gate_and_spacing():
    rows = pd.DataFrame({"x": [0.0, 1, 2, 3, 4, 100, 101, 5], "y": 0.0, "z": 0.0, "reason": [None] * 8})
    assert list(kernels.jump_gate(rows)["reason"]) == [None] * 5 + ["position_jump"] * 2 + [None]
    assert list(kernels.keep_spaced(np.array([0, 0.4, 1.0, 1.9, 2.0]), 1.0)) == [True, False, True, False, True]
    moving = kernels.keep_by_motion(np.arange(0, 5, 0.5), np.full(10, 2.0), np.zeros(10))
    assert list(np.flatnonzero(moving)) == [0, 2, 4, 6, 8]
    assert kernels.keep_by_motion(np.arange(0, 61, 10.0), np.zeros(7), np.zeros(7)).sum() == 3


def test_envelope_gates_have_no_echo():
    e = np.arange(20) * 15.0
    e[10] += 60
    rows = pd.DataFrame({"utc_s": np.arange(20.0), "e_m": e, "n_m": 0.0, "reasons": [[] for _ in range(20)]})
    flagged = np.flatnonzero(kernels.envelope_gates(rows)["speed_jump"])
    assert list(flagged) == [10, 11]


def test_allan_deviation_of_white_noise_falls_by_half():
    rate = np.random.default_rng(2).normal(0, 0.1, 20_000)
    tau, dev = kernels.allan_deviation(rate, 100.0)
    slope = np.polyfit(np.log(tau[tau < 10]), np.log(dev[tau < 10]), 1)[0]
    assert abs(slope + 0.5) < 0.05


def test_similarity_offset_and_intervals():
    rng = np.random.default_rng(3)
    src = rng.normal(0, 5, (40, 3))
    turn, _ = np.linalg.qr(rng.normal(0, 1, (3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    s, r, shift = kernels.similarity(src, 1.7 * src @ turn.T + [1, 2, 3])
    assert abs(s - 1.7) < 1e-9 and np.allclose(r, turn) and np.allclose(shift, [1, 2, 3])
    t = np.arange(0, 60, 0.1)
    x = np.sin(t) + np.sin(2.7 * t)
    lag, ratio = kernels.clock_offset(t, x, t + 0.35, x)
    assert abs(lag - 0.35) < 0.02 and ratio > 1
    lo, hi = kernels.bootstrap_interval(rng.normal(4, 1, 400), np.mean)
    assert lo < 4.1 and hi > 3.9 and hi - lo < 0.3


def test_attitude_levels_out():
    n = 2000
    q = kernels.mahony(np.arange(n) * 0.01, np.zeros((n, 3)), np.tile([0.0, 1.0, 9.75], (n, 1)))
    roll = np.arctan2(2 * (q[-1, 0] * q[-1, 1] + q[-1, 2] * q[-1, 3]), 1 - 2 * (q[-1, 1] ** 2 + q[-1, 2] ** 2))
    assert abs(roll - np.arctan2(1.0, 9.75)) < 0.02


def test_spline_bends_to_anchors_without_outliers():
    t = np.arange(0, 100, 0.5)
    anchors = 5 + 0.05 * t[::4]
    anchors[10] += 80
    out = kernels.spline_offset(t, np.zeros(len(t)), t[::4], anchors)
    assert np.abs(out - (5 + 0.05 * t)).max() < 1.0


def test_masks_agree_escalate_and_hold(spark):
    rows = []
    for k in range(30):
        for m, off in ((5, 3.0 if k >= 10 else 0.0), (10, 0.1), (15, 0.0)):
            rows.append((1, float(k), m, off, 0.0, 0.0, 1, 9, 3.0, 0.2))
    long = spark.createDataFrame(rows, "session_id long, utc_s double, mask int, e_m double, n_m double, u_m double, quality int, ns int, ratio double, sd_h double")
    assert {round(r.spread_m, 6) for r in masks.spread(long).collect()} == {0.1, 3.0}
    out = masks.fuse(long).orderBy("utc_s").collect()
    assert [r.mask for r in out] == [5] * 10 + [10] * 20 and out[15].escalated and out[15].flag and not out[5].flag


def test_registry_refuses_doubles_and_odd_signatures():
    assert {"raw", "cv_rts", "kalman_sigma"} <= set(smoothers.names())
    with pytest.raises(ValueError, match="already"):
        smoothers.register("raw")(lambda df: df)
    with pytest.raises(TypeError):
        smoothers.register("odd")(lambda a, b: a)
    with pytest.raises(KeyError, match="there are"):
        smoothers.run("nothing", None)


def test_geodesy_and_clocks(spark):
    lit = F.lit
    p = values(spark, geo.ecef_to_llh_struct(lit(0.0), lit(0.0), lit(-6400000.0)))
    assert p.lat_deg == -90.0 and abs(p.h_m - (6400000 - 6356752.314245)) < 1e-3
    e, n = geo.utm_forward(lit(0.0), lit(33.0), lit(36))
    assert abs(values(spark, e) - 500000) < 1e-6 and abs(values(spark, n)) < 1e-6
    e, n = geo.utm_forward(lit(60.0), lit(3.0), lit(31))
    assert abs(values(spark, n) - 6651411.190) < 0.01
    assert values(spark, geo.heading_from_enu(lit(0.0), lit(0.0))) is None
    assert abs(values(spark, geo.parse_dms(lit("32 30 0 S"))) + 32.5) < 1e-12
    assert [values(spark, timefn.leap_seconds(lit(float(s)))) for s in (0, 1483228799, 1483228800)] == [0, 17, 18]
    assert values(spark, timefn.fraction(lit("30000/1001"))) == 30000 / 1001 and values(spark, timefn.fraction(lit("1/0"))) is None


def test_many_sessions_side_by_side_equal_each_alone():
    rng = np.random.default_rng(5)
    sizes = [3, 40, 1, 17]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    z = rng.normal(size=(cuts[-1], 2)).cumsum(0)
    z[rng.random(z.shape) < 0.2] = np.nan
    z[cuts[2]] = np.nan
    dt = np.full(cuts[-1], 1.3)
    together = kernels.cv_rts_all(cuts, z, dt)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for k in range(2):
            assert np.allclose(together[a:b, k], kernels.cv_rts(z[a:b, k], 1.3), equal_nan=True)


def test_two_state_smoother_equals_the_matrix_form():
    rng = np.random.default_rng(6)
    z, t = rng.normal(size=30).cumsum(), np.cumsum(rng.random(30))
    gaps = np.diff(t, prepend=t[0])
    h, r = np.array([[1.0, 0.0]]), np.array([[0.7]])
    start = np.array([z[0], 0.0]), np.diag([0.7, 100.0])
    want, cov = kernels._smooth(30, start, lambda k: kernels._cv(gaps[k], 0.5), lambda k: [(z[k : k + 1], h, r)])
    x, v, a, c = kernels.two_state(np.array([0, 30]), z[:, None], np.full((30, 1), 0.7), gaps, 0.5, (z[0], 0.0, 0.7, 100.0))
    assert np.allclose(np.stack([x[:, 0], v[:, 0]], 1), want) and np.allclose(a[:, 0], cov[:, 0, 0]) and np.allclose(c[:, 0], cov[:, 1, 1])


def test_sessions_are_whole_when_batches_part_them(spark, monkeypatch):
    monkeypatch.setattr(kernels, "SIDE_BY_SIDE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = spark.createDataFrame([(s, float(t)) for s in range(7) for t in range(1 + 3 * (s % 4))], "session_id long, utc_s double").repartition(2)
        count = lambda r, cuts: {"n": np.repeat(np.diff(cuts), np.diff(cuts))}
        got = kernels.per_sessions(rows, count, {"n": types.LongType()}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == rows.count() and all(r.n == 1 + 3 * (r.session_id % 4) for r in got)


def test_quantiles_and_ranks_of_large_groups(spark):
    """A group with two thirds of the rows, frequent values, null keys and missing values."""
    rng = np.random.default_rng(9)
    rows = [(None if k % 11 == 0 else "a" if k % 3 else "b", None if k % 13 == 0 else float("nan") if k % 29 == 0 else float(rng.integers(0, 8) if k % 2 else rng.normal(0, 5)), k) for k in range(3000)] + [("c", 4.0, -1), ("d", None, -2)]
    df = spark.createDataFrame(rows, "g string, x double, k long")
    got = {r.g: r for r in stats.quantiles(df, "x", {"lo": 0.0, "q": 0.3, "med": 0.5, "hi": 1.0}, ["g"], buckets=7).collect()}
    groups = {g: np.array([x for h, x, _ in rows if h == g and x is not None and x == x]) for g in (None, "a", "b", "c")}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g].n == len(x) and np.allclose([got[g].lo, got[g].q, got[g].med, got[g].hi], np.quantile(x, [0, 0.3, 0.5, 1]))
    clean = df.where("NOT isnan(x)")
    for r in stats.ranks(clean, "x", ["k"], ["g"], buckets=7).collect():
        mine = sorted((x, k) for h, x, k in rows if h == r.g and x is not None and x == x)
        assert mine[r["rank"] - 1] == (r.x, r.k) and r.up_to == sum(x <= r.x for x, _ in mine) and r.n == len(mine)
    assert stats.quantiles(df.limit(0), "x", {"med": 0.5}, ["g"]).count() == 0 and stats.ranks(df.limit(0), "x", ["k"], ["g"]).count() == 0


def _events(spark, tmp_path, rows):
    """A table of events (event_id, minute, user, value, k) in files of one row each, so that they come in any order."""
    day = "TIMESTAMP '2024-01-01 00:00:00'"
    df = spark.createDataFrame(rows, "event_id long, minute int, user_id long, value double, k long")
    df = df.selectExpr("event_id", f"{day} + make_interval(0, 0, 0, 0, 0, minute) AS ts", "user_id", "'view' AS event_type", "value", "concat('{\"k\": ', k, '}') AS props")
    df.repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_of_equal_sigmas_the_first_epoch_is_worst(spark, tmp_path):
    from tracelake import registry

    sf = _events(spark, tmp_path, [(i, i, 1, v, 1) for i, v in enumerate([1.0, 9.0, 2.0, 9.0, 9.0])])
    assert registry.queries()["worst_epoch"](spark, sf).first().worst_epoch == 1


def test_of_equally_frequent_qualities_the_first_counts(spark, tmp_path):
    from tracelake import registry

    # k 9 is quality 5, k 0 is quality 1; both users have two of each.
    rows = [(i, i, 1, 1.0, k) for i, k in enumerate([9, 0, 0, 9])] + [(10 + i, i, 2, 1.0, k) for i, k in enumerate([0, 9, 9, 0])]
    got = {r.session_id: r.mostly_fix for r in registry.queries()["report_accuracy"](spark, _events(spark, tmp_path, rows)).collect()}
    assert got == {1: False, 2: True}


def test_equal_sessions_rank_by_their_ids(spark, tmp_path):
    from tracelake import registry

    values = [0.1, 0.7, 1e5, 0.3, 12.7, 0.9, 33.3, 1e-3]
    # The same values, in files and orders of their own.
    rows = [(100 * u + i, i, u, values[(i * (2 * u + 1)) % 8], 1) for u in range(20) for i in range(8)] + [(9000, 0, 50, 1e6, 1), (9001, 0, 51, 0.0, 9)]
    got = {r.session_id: r.place for r in registry.queries()["rank_variants"](spark, _events(spark, tmp_path, rows)).collect()}
    places = [got[u] for u in range(20)]
    assert places == list(range(places[0], places[0] + 20))
    odd = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, None), (3, 1e300), (3, 3e300), (4, None), (4, 0.5)], "g long, v double")
    means = {r.g: r.m for r in odd.groupBy("g").agg(stats.steady_avg("v").alias("m")).collect()}
    assert means[1] != means[1] and means[2] is None and means[3] == 2e300 and means[4] == 0.5


def test_inverse_geodesy_takes_its_inputs_once(spark):
    lat, lon, h = F.col("id") % 80 + 0.5, F.col("id") % 170 - 80.25, F.col("id") * 3.0
    ref = (F.lit(32.0), F.lit(34.8), F.lit(50.0))
    rows = spark.range(500).select(lat.alias("lat"), lon.alias("lon"), h.alias("h"))
    got = rows.withColumn("p", geo.ecef_to_llh_struct(F.col("lat") + F.lit(6e6), F.col("lon") * 1e4, F.col("h") + F.lit(12345.0)))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("12345.0") == 1
    back = spark.range(500).select(lat.alias("lat"), lon.alias("lon"), h.alias("h")).withColumn("p", geo.enu_to_llh(*geo.llh_to_enu(F.col("lat"), F.col("lon"), F.col("h"), ref), ref))
    off = back.agg(F.max(F.abs(F.col("p.lat_deg") - F.col("lat"))).alias("a"), F.max(F.abs(F.col("p.lon_deg") - F.col("lon"))).alias("b"), F.max(F.abs(F.col("p.h_m") - F.col("h"))).alias("c")).first()
    assert off.a < 1e-9 and off.b < 1e-9 and off.c < 1e-5
    odd = spark.createDataFrame([(0.0, 0.0, 6356752.3), (0.0, 0.0, -6356752.3)], "x double, y double, z double").select(geo.ecef_to_llh_struct(F.col("x"), F.col("y"), F.col("z")).alias("p")).collect()
    assert odd[0].p.lat_deg == 90.0 and odd[1].p.lat_deg == -90.0


def test_sides_of_a_band_join_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.4, 2.0), (1, 9.0, 3.0)], T)
    got = ranges.band_join(rows, rows.withColumnRenamed("v", "w"), 0.5)
    assert got.count() == 5 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_track_is_spread_over_all_tasks(spark, tmp_path):
    from tracelake.plans.tracks import track

    sf = _events(spark, tmp_path, [(i, i % 50, i // 50, 1.0, 1) for i in range(400)])
    assert track(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = kernels.per_sessions(track(spark, sf).select("session_id", "utc_s"), lambda r, cuts: {"n": np.full(len(r), len(cuts))}, {"n": types.LongType()})
    assert kept.count() == 400 and kept.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_epoch_weights_of_many_sessions_are_those_of_each():
    rng = np.random.default_rng(6)
    cuts = np.array([0, 25, 26, 60, 72])
    n = cuts[-1]
    rows = pd.DataFrame(rng.normal(0, 1, (n, 6)) * [1, 1, 1, 3, 3, 1], columns=["e_m", "n_m", "u_m", "ve", "vn", "vu"])
    rows = rows.assign(utc_s=np.concatenate([np.cumsum(rng.choice([0.0, 1.0, 20.0], k)) for k in np.diff(cuts)]), sd_n=rng.uniform(0.1, 4, n), sd_e=1.0, ns=rng.integers(4, 12, n), quality=rng.integers(1, 5, n))
    rows.loc[::9, "vu"], rows.loc[4::11, "ve"], rows.loc[3::7, ["ve", "vn"]] = np.nan, np.nan, 0.01
    rows.loc[30, "n_m"] = 500.0
    for options in ({}, {"canyon": 15.0, "gate": 5.0}):
        got = kernels.epoch_weighted_v2(rows, cuts, **options)
        for a, b in zip(cuts[:-1], cuts[1:]):
            alone = kernels.epoch_weighted_v2(rows.iloc[a:b].reset_index(drop=True), **options)
            assert all(np.allclose(got[c][a:b], alone[c], atol=1e-7) for c in alone)


def test_masks_of_many_sessions_are_fused_as_those_of_each(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s, kinds in ((1, (5, 10, 15, 20)), (2, (10, 20)), (3, (15,)), (None, (5, 15, 20))):
        for t in np.cumsum(rng.choice([1.0, 1.0, 25.0], 60)):
            for m in kinds:
                if rng.random() < 0.9:
                    e, n = (rng.choice([0.1, 0.5, 2.0]) * rng.normal(0, 1, 2)).tolist()
                    rows.append((s, float(t), m, None if rng.random() < 0.05 else e, n, 0.0, 1, int(rng.integers(3, 9)), 3.0, float(rng.uniform(0.1, 0.9))))
    long = spark.createDataFrame(rows, "session_id long, utc_s double, mask int, e_m double, n_m double, u_m double, quality int, ns int, ratio double, sd_h double").repartition(1)
    key = lambda r: (-1 if r.session_id is None else r.session_id, r.utc_s)
    got = sorted(masks.fuse(long).collect(), key=key)
    alone = [r for s in (1, 2, 3, None) for r in masks.fuse(long.where(F.col("session_id").eqNullSafe(F.lit(s)))).collect()]
    assert got == sorted(alone, key=key)
    assert {r.session_id for r in got} == {1, 2, 3, None} and {r.mask for r in got if r.session_id == 3} == {15} and {r.mask for r in got if r.session_id == 2} == {10, 20}


def test_masks_read_no_pivot_for_each_session(spark):
    long = spark.range(40).selectExpr("id AS session_id", "0.0D AS utc_s", "5 AS mask", "1.0D AS e_m", "2.0D AS n_m", "0.0D AS u_m", "1 AS quality", "9 AS ns", "3.0D AS ratio", "0.2D AS sd_h")
    assert "FlatMapGroupsInPandas" not in masks.fuse(long)._jdf.queryExecution().toString() and masks.fuse(long).count() == 40


def test_bootstrap_of_a_stack_is_that_of_each_series():
    x = np.random.default_rng(10).normal(0, 1, (4, 37)).round(1)
    for block in (1, 10):
        lo, hi = kernels.bootstrap_interval(x, kernels.median, block)
        assert list(zip(lo, hi)) == [kernels.bootstrap_interval(one, np.median, block) for one in x]
    x[1, 3] = np.nan
    for part in (x, x[:, :36], x[:, :1]):
        assert np.array_equal(kernels.median(part, axis=1), np.median(part, axis=1), equal_nan=True)


def test_sessions_are_folded_in_bounded_parts():
    rows = pd.DataFrame({"session_id": np.arange(150_000) // 67})
    parts = list(kernels.whole_sessions((rows.iloc[k : k + 10_000] for k in range(0, len(rows), 10_000)), "session_id"))
    assert max(map(len, parts)) < 50_000 + 10_000 + 67 and pd.concat(parts, ignore_index=True).equals(rows)
    assert all(parts[k].session_id.iloc[-1] < parts[k + 1].session_id.iloc[0] for k in range(len(parts) - 1))


def test_places_on_track_are_the_nearest_without_copies(spark):
    """Against a loop: long stands, strays far away, holes in place and time, equal epochs, a key twice; nothing is copied or joined."""
    rng = np.random.default_rng(5)
    epochs = [(s, float(k), float(20 * k + rng.normal()) if k < 40 else 800.0, float(rng.normal(0, 60)) if k < 40 else 0.0) for s in (1, 2) for k in range(60)]
    epochs += [(1, 100.0, 1e13, -1e13), (1, 101.0, None, 5.0), (2, 102.0, float("nan"), 5.0), (1, None, -300.0, 0.0), (4, 0.0, 0.0, 0.0)]
    epochs = [e for e in epochs if e[:2] != (2, 30.0)] + [(2, 31.0, 700.0, 0.0)]
    frames = [(s, k, float(rng.uniform(-100, 900)), float(rng.normal(0, 60))) for s in (1, 2, 3) for k in range(80)]
    frames += [(1, 80, 1e13, -1e13), (1, 81, 801.0, 1.0), (1, 82, -300.0, 3.0), (1, 83, None, 0.0), (1, 5, 300.0, 0.0), (None, 1, 0.0, 0.0), (2, 84, -2e13, 0.0), (1, 85, 100.0, 250.0)]
    track = spark.createDataFrame(epochs, "session_id long, utc_s double, e_m double, n_m double")
    got = motion.places_on_track(spark.createDataFrame(frames, "session_id long, frame long, fe_m double, fn_m double"), track)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan

    def on(p, a, b):
        (e, n, t), (e1, n1, t1) = a, b
        sq = (e1 - e) ** 2 + (n1 - n) ** 2
        u = min(1.0, max(0.0, ((p[0] - e) * (e1 - e) + (p[1] - n) * (n1 - n)) / sq)) if sq >= 1e-12 else 0.0
        return np.hypot(p[0] - e - u * (e1 - e), p[1] - n - u * (n1 - n)), None if t is None or t1 is None else t + u * (t1 - t)

    want = {}
    for s in (1, 2):
        line = sorted(((e, n, t) for i, t, e, n in epochs if i == s), key=lambda r: (-1.0 if r[2] is None else r[2], r[0] or 0.0, r[1]))
        good = [k for k, r in enumerate(line) if r[0] is not None and np.isfinite(r[0])]
        for i, key, *p in frames:
            near = [k for k in good if i == s and p[0] is not None and all(abs(np.floor(x / 100) - np.floor(y / 100)) <= 1 for x, y in zip(line[k], p))]
            if near:
                k = min(near, key=lambda k: ((line[k][0] - p[0]) ** 2 + (line[k][1] - p[1]) ** 2, k))
                d = np.hypot(line[k][0] - p[0], line[k][1] - p[1])
                ways = [(d, line[k][2])] + [on(p, *sorted((line[k], line[j]), key=lambda r: -1.0 if r[2] is None else r[2])) for j in (k - 1, k + 1) if j in good]
                off, at = min(ways, key=lambda w: w[0])
                if (s, key) not in want or d < want[s, key][0]:
                    want[s, key] = (d, off, at)
    want = {k: (at, off) for k, (_, off, at) in want.items() if off <= 25}
    rows = {(r.session_id, r.frame): (r.utc_s, r.off_m) for r in got.collect()}
    assert got.count() == len(rows) and rows.keys() == want.keys() and len(rows) > 60
    for k, (at, off) in want.items():
        assert abs(rows[k][1] - off) < 1e-9 and (rows[k][0] is None) == (at is None) and (at is None or abs(rows[k][0] - at) < 1e-6)
