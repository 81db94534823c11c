"""Constraints, inertial filters and media operators on cases with known answers."""

import math

import numpy as np
import pandas as pd

from tracelake.operators import inertial, media


def test_strapdown_follows_a_line_and_lowers_noise():
    rng = np.random.default_rng(0)
    t = np.arange(60.0)
    e = 10 * t + rng.normal(0, 0.3, 60)
    epochs = pd.DataFrame({"session_id": 1, "utc_s": t, "e_m": e, "n_m": 0.0, "u_m": 0.0, "ve": 10.0, "vn": 0.0, "vu": np.nan})
    ts = np.arange(0, 60, 0.05)
    samples = pd.DataFrame({"utc_s": ts, "ax": 0.0, "ay": 0.0, "az": inertial.G, "gx": 0.0, "gy": 0.0, "gz": 0.0})
    for imu in (samples, samples.iloc[:0]):
        out = inertial.strapdown_rts(epochs, imu)
        assert np.abs(out.e_s - 10 * t).mean() < np.abs(e - 10 * t).mean()
        assert abs(out.ve_s.iloc[30] - 10) < 0.3


def test_turn_rate_filter_follows_a_circle():
    t = np.arange(0, 60, 0.5)
    circle = np.stack([50 * np.sin(0.2 * t), 50 * np.cos(0.2 * t)], 1)
    noisy = circle + np.random.default_rng(1).normal(0, 1.0, circle.shape)
    out = inertial.turn_rate_ekf(t, noisy, sigma=1.0)
    assert np.linalg.norm(out - circle, axis=1)[40:].mean() < np.linalg.norm(noisy - circle, axis=1)[40:].mean()


def test_noise_parameters_and_consistency():
    rng = np.random.default_rng(2)
    p = inertial.allan_parameters(rng.normal(0, 0.1, 40_000), 100.0)
    assert abs(p["random_walk"] - 0.01) < 0.002 and p["reliable"]
    errors = rng.normal(0, 1, (500, 3))
    m, lo, hi, inside = inertial.nees(errors, np.tile(np.eye(3), (500, 1, 1)), 0.001)
    assert inside and lo < 3 < hi and not inertial.nees(3 * errors, np.tile(np.eye(3), (500, 1, 1)))[3] and m < 4


def test_turn_trust():
    t = np.arange(0, 60, 0.01)
    rate = 0.3 * np.sin(0.3 * t)
    heading = np.degrees(np.cumsum(rate) * 0.01)
    r, verdict = inertial.turn_trust(t, rate, t[::100], heading[::100])
    assert verdict == "GOOD" and r > 0.9
    assert inertial.turn_trust(t, np.zeros(len(t)), t[::100], heading[::100])[1] == "DEAD"


def test_robust_similarity_leaves_out_outliers():
    rng = np.random.default_rng(3)
    src = rng.normal(0, 5, (50, 3))
    dst = 2 * src + [1, 2, 3]
    dst[:3] += 40
    s, _, shift, keep = media.similarity_robust(src, dst)
    assert abs(s - 2) < 1e-6 and np.allclose(shift, [1, 2, 3]) and keep.sum() == 47
    assert media.reconstruction_frame(src, src + 0.1, src + 1e4) == "local"
    assert media.reconstruction_frame(src, src + 1e4, src + 1e4 + 1) == "llh"
    assert media.reconstruction_frame(src * 1000, src + 1e6, src) == "raw"


def test_anchor_choice_follows_the_prediction():
    t = np.arange(10.0)
    a = np.stack([t, np.zeros(10)], 1)
    b = a + [0, 30.0]
    b[4] = a[4]
    a[4] = [500, 500]
    out = media.pick_anchors(t, a, b, np.tile([1.0, 0.0], (10, 1)))
    assert np.allclose(out, np.stack([t, np.zeros(10)], 1), atol=1e-3)


def test_spectrum_peaks_at_the_tone(spark):
    rate = 8000
    x = np.sin(2 * np.pi * 1000 * np.arange(8192) / rate)
    blocks = spark.createDataFrame([("f", rate, 0, x.tolist())], "file string, rate long, start long, samples array<double>")
    rows = media.spectrogram(blocks).collect()
    assert len(rows) == 15 and all(int(np.argmax(r.power_db)) == 16 for r in rows)


def test_spectra_do_not_depend_on_the_blocks(spark):
    x = np.random.default_rng(3).normal(size=5000)
    schema = "file string, start long, samples array<double>"
    whole = spark.createDataFrame([("f", 0, x.tolist())], schema)
    parts = spark.createDataFrame([("f", k, x[k : k + 1100].tolist()) for k in range(0, 5000, 1100)], schema)
    one, many = ({(r.start, tuple(r.power_db)) for r in media.spectrogram(b).collect()} for b in (whole, parts))
    assert len(one) == (5000 - 1024) // 512 + 1 and one == many


def test_strapdown_of_many_sessions_is_that_of_each():
    rng = np.random.default_rng(5)
    parts = []
    for n, m in ((20, 150), (1, 10), (35, 0), (12, 200)):
        t = np.cumsum(rng.choice([1.0, 1.0, 40.0], n))
        v = np.where(rng.random((n, 3)) < 0.2, np.nan, rng.normal(0, 1, (n, 3)))
        v[n // 2] = 90.0
        z = rng.normal(0, 1, (n, 3))
        z[n // 3, 1] = np.nan if n > 1 else 0.0
        epochs = pd.DataFrame(np.column_stack([t, z, v]), columns=["utc_s", "e_m", "n_m", "u_m", "ve", "vn", "vu"]).assign(session_id=n)
        ts = np.sort(rng.uniform(0, t[-1] + 1, m))
        force = rng.normal(0, 0.3, (m, 6)) + [0, 0, inertial.G, 0, 0, 0]
        force[: m // 50, :3] = 0.0
        parts.append((epochs, pd.DataFrame(np.column_stack([ts, force]), columns=["utc_s", "ax", "ay", "az", "gx", "gy", "gz"])))
    epochs, samples = (pd.concat([p[k] for p in parts], ignore_index=True) for k in (0, 1))
    cuts, sample_cuts = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 1))
    got = inertial.strapdown_rts_all(epochs, cuts, samples, sample_cuts)
    for s, (one, own) in enumerate(parts):
        alone = inertial.strapdown_rts(one, own)
        for c in inertial.STRAPDOWN:
            assert np.isfinite(alone[c]).all() and np.allclose(got[c][cuts[s] : cuts[s + 1]], alone[c], atol=1e-7)


def test_noise_of_many_rates_is_that_of_each():
    rng = np.random.default_rng(8)
    for n in (8, 9, 50, 333):
        rates, fs = rng.normal(0, 1, (5, n)).round(1), rng.uniform(1, 100, 5)
        got = inertial.allan_parameters(rates, fs)
        for k in range(5):
            alone = inertial.allan_parameters(rates[k], float(fs[k]))
            assert all(np.allclose(got[c][k], alone[c]) for c in alone)
        x = np.cumsum(rng.uniform(0.1, 1, (2, n)), 1)
        x[1] = np.arange(n)
        assert np.allclose(inertial._slopes(rates[:2], x), [np.gradient(rates[k], x[k]) for k in range(2)])


def test_calibration_goes_by_sessions_of_equal_length(spark):
    rng = np.random.default_rng(9)
    rows = [(s, float(t), *rng.normal(0, 1, 5).tolist(), 0.5) for s, n in ((1, 60), (2, 60), (3, 7), (None, 30), (4, 45)) for t in range(n)]
    imu = spark.createDataFrame(rows, "session_id long, utc_s double, ax double, ay double, az double, gx double, gy double, gz double")
    found = inertial.calibrate(imu)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {(r.session_id, r.axis): r for r in found.collect()}
    assert len(got) == 24 and {s for s, _ in got} == {1, 2, 4, None}
    for k, axis in enumerate(("ax", "ay", "az", "gx", "gy", "gz")):
        for s, n in ((1, 60), (2, 60), (None, 30), (4, 45)):
            r = got[s, axis]
            want = inertial.allan_parameters(np.array([x[2 + k] for x in rows if x[0] == s]), 1.0) if axis != "gz" else {"random_walk": 0.0, "bias_instability": 0.0, "rate_random_walk": 0.0, "reliable": False}
            assert r.n == n and all(np.isclose(r[c], v) for c, v in want.items())


def test_distance_from_the_normal_law_takes_one_sort(spark):
    """Against the sum over ranks with math.erf, with many equal values and missing ones; a group's rows are sorted once."""
    rng = np.random.default_rng(9)
    groups = {1: rng.normal(3, 2, 300), 2: np.round(rng.exponential(2, 500)), 3: np.repeat([1.0, 2.0], 40), None: rng.normal(0, 1, 50)}
    rows = [(g, float(x)) for g, v in groups.items() for x in rng.permutation(v)] + [(1, None), (4, None)]
    got = media.anderson_darling(spark.createDataFrame(rows, "g long, x double"), "x", "g")
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    found = {r.g: r.a2 for r in got.collect()}
    assert found.keys() == groups.keys()
    for g, v in groups.items():
        x, n = np.sort(v), len(v)
        p = np.array([0.5 + math.erf(z / 2**0.5) / 2 for z in (x - x.mean()) / x.std(ddof=1)])
        i = np.arange(1, n + 1)
        assert abs(found[g] - (-n - np.sum((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))) / n)) < 1e-3
