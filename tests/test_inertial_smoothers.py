"""Preintegration, tiers, dead reckoning, the robust chain and the error-state smoother against plain versions."""

import numpy as np
import pandas as pd
import pytest

from tracelake.operators import error_state, kernels, preintegration, reckoning

TRACK = "session_id long, utc_s double, e_m double, n_m double, u_m double, ve double, vn double, vu double, sd_e double, sd_n double, quality int"


def drive(seed=0, seconds=120, rate=50.0, bias_f=(0.15, -0.1, 0.05), bias_w=(0.004, -0.003, 0.01), noise=0.3):
    """A car that stands, speeds up and turns: truth at epochs, epochs with noise, biased samples."""
    rng = np.random.default_rng(seed)
    ts = np.arange(0, seconds, 1 / rate)
    speed = np.clip((ts - 10) * 1.0, 0, 12)
    yaw_rate = np.where((ts > 30) & (ts < 45), 0.15, np.where((ts > 70) & (ts < 90), -0.12, 0.0))
    heading = 0.4 + np.concatenate([[0], np.cumsum(yaw_rate[:-1]) / rate])
    v = np.stack([speed * np.sin(heading), speed * np.cos(heading), np.zeros_like(ts)], 1)
    pos = np.vstack([np.zeros(3), np.cumsum((v[1:] + v[:-1]) / 2 / rate, axis=0)])
    a = np.gradient(v, 1 / rate, axis=0)
    force = np.stack([a[:, 0] * np.sin(heading) + a[:, 1] * np.cos(heading), -a[:, 0] * np.cos(heading) + a[:, 1] * np.sin(heading), np.full_like(ts, 9.80665)], 1)
    samples = pd.DataFrame(np.hstack([force + bias_f + rng.normal(0, 0.02, force.shape), np.stack([0 * ts, 0 * ts, -yaw_rate], 1) + bias_w + rng.normal(0, 0.001, force.shape)]), columns=["ax", "ay", "az", "gx", "gy", "gz"])
    samples.insert(0, "utc_s", ts)
    at = np.arange(0, len(ts), int(rate))
    truth = pd.DataFrame(np.hstack([pos[at], v[at], heading[at, None]]), columns=["e", "n", "u", "ve", "vn", "vu", "heading"])
    truth.insert(0, "utc_s", ts[at])
    epochs = pd.DataFrame({"utc_s": ts[at], "standing": speed[at] < 0.01})
    for c, x in (("e_m", "e"), ("n_m", "n"), ("u_m", "u"), ("ve", "ve"), ("vn", "vn"), ("vu", "vu")):
        epochs[c] = truth[x] + rng.normal(0, noise if c.endswith("_m") else 0.1, len(at))
    return truth, epochs, samples


def test_preintegrated_steps_are_the_samples_one_by_one():
    _, epochs, samples = drive()
    t, ts = epochs.utc_s.to_numpy() + 0.007, samples.utc_s.to_numpy()
    f, w = samples[["ax", "ay", "az"]].to_numpy(), samples[["gx", "gy", "gz"]].to_numpy()
    step = error_state.preintegrate(t, ts, f, w)
    for k in (1, 20, 40, 80):
        r, v, p, now = np.eye(3), np.zeros(3), np.zeros(3), t[k - 1]
        j = int(np.searchsorted(ts, now, "right")) - 1
        while now < t[k] - 1e-12:
            end = min(ts[j + 1], t[k])
            h = end - now
            p, v = p + v * h + r @ f[j] * h * h / 2, v + r @ f[j] * h
            r, now, j = r @ error_state.turn(w[j] * h), end, j + 1
        assert np.allclose(step.r[k], r) and np.allclose(step.v[k], v) and np.allclose(step.p[k], p) and abs(step.covered[k] - 1) < 1e-9
    # Derivatives by the biases, against small changes of them.
    for axis in range(3):
        d = np.zeros(3)
        d[axis] = 1e-5
        a, g = error_state.preintegrate(t, ts, f - d, w), error_state.preintegrate(t, ts, f, w - d)
        k = 40
        assert np.allclose((a.v[k] - step.v[k]) / 1e-5, step.v_ba[k][:, axis], atol=1e-4) and np.allclose((a.p[k] - step.p[k]) / 1e-5, step.p_ba[k][:, axis], atol=1e-4)
        assert np.allclose((g.v[k] - step.v[k]) / 1e-5, step.v_bg[k][:, axis], atol=2e-3) and np.allclose((g.p[k] - step.p[k]) / 1e-5, step.p_bg[k][:, axis], atol=2e-3)
        assert np.allclose(error_state.turned(step.r[k].T @ g.r[k]) / 1e-5, step.r_bg[k][:, axis], atol=1e-3)


def test_preintegrated_noise_is_that_of_many_draws():
    rng = np.random.default_rng(4)
    ts, t = np.arange(0, 1.0, 0.02), np.array([0.0, 1.0])
    f, w = np.tile([0.5, 0.2, 9.8], (50, 1)), np.tile([0.0, 0.0, 0.3], (50, 1))
    step = error_state.preintegrate(t, ts, f, w, sigma_f=0.1, sigma_w=0.02)
    draws = [error_state.preintegrate(t, ts, f + rng.normal(0, 0.1 / 0.02**0.5, f.shape), w + rng.normal(0, 0.02 / 0.02**0.5, w.shape)) for _ in range(1500)]
    errors = np.array([np.concatenate([error_state.turned(step.r[1].T @ d.r[1]), d.v[1] - step.v[1], d.p[1] - step.p[1]]) for d in draws])
    got, want = errors.std(0), np.sqrt(np.diag(step.noise[1]))
    assert np.abs(got / want - 1).max() < 0.12


def test_error_state_finds_biases_and_bridges_an_outage():
    truth, epochs, samples = drive()
    lost = (epochs.utc_s > 74) & (epochs.utc_s < 86)
    epochs.loc[lost, ["e_m", "n_m", "u_m", "ve", "vn", "vu"]] = np.nan
    out = error_state.smooth(epochs, samples)
    away = np.hypot(out.e_s - truth.e, out.n_s - truth.n)
    assert away[lost].max() < 1.5 and away.mean() < 0.3
    late = out.iloc[60:100]
    assert np.abs(late[["bias_ax", "bias_ay", "bias_az"]].mean() - [0.15, -0.1, 0.05]).max() < 0.06
    assert np.abs(late[["bias_gx", "bias_gy", "bias_gz"]].mean() - [0.004, -0.003, 0.01]).max() < 0.003
    yaw = np.abs((out.yaw_deg - np.degrees(truth.heading) + 180) % 360 - 180)
    assert yaw[20:].max() < 3 and out.pitch_deg.abs().max() < 3 and out.roll_deg.abs().max() < 3
    blind = error_state.smooth(epochs, samples.iloc[:0])
    assert np.hypot(blind.e_s - truth.e, blind.n_s - truth.n)[lost].max() > 3 * away[lost].max()


def test_error_state_left_out_places_and_odd_sessions(spark):
    truth, epochs, samples = drive(seconds=60)
    epochs.loc[[25, 40], "e_m"] += 80
    out = error_state.smooth(epochs, samples)
    assert np.hypot(out.e_s - truth.e, out.n_s - truth.n).max() < 1.5
    rows = [(1, *map(float, r[["utc_s", "e_m", "n_m", "u_m", "ve", "vn", "vu"]]), 0.3, 0.3, 2) for _, r in epochs.iterrows()] + [(2, 5.0, 1.0, 1.0, 1.0, None, None, None, None, None, None), (3, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.3, 0.3, 1), (3, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.3, 0.3, 1)]
    imu = spark.createDataFrame([(1, *map(float, r)) for r in samples.to_numpy()] + [(9, 1.0, 0.0, 0.0, 9.8, 0.0, 0.0, 0.0), (1, None, None, None, None, None, None, None)], "session_id long, utc_s double, ax double, ay double, az double, gx double, gy double, gz double")
    got = error_state.smooth_sessions(spark.createDataFrame(rows, TRACK), imu)
    assert got.count() == len(rows) and {r.session_id for r in got.collect()} == {1, 2, 3}
    assert error_state.smooth_sessions(spark.createDataFrame(rows, TRACK).limit(0), imu).count() == 0


def test_samples_sum_to_steps(spark):
    """Against a loop over samples, with holes, epochs between samples, ties and missing values."""
    rng = np.random.default_rng(1)
    epochs = [(s, float(x), *rng.normal(0, 1, 8).tolist(), 1) for s in (1, 2) for x in np.sort(rng.uniform(0, 20, 25))] + [(3, 1.0, *[0.0] * 8, 1)]
    epochs.append((1, epochs[4][1], *[0.0] * 8, 1))
    times = np.sort(rng.uniform(-1, 21, 900))
    times = times[(times < 8) | (times > 11)]
    samples = [(1, float(x), *rng.normal(0, 1, 3).tolist()) for x in times] + [(1, epochs[7][1], 1.0, 2.0, 3.0), (4, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0), (1, 3.0, None, 1.0, 1.0)]
    got = preintegration.preintegrate(spark.createDataFrame(epochs, TRACK), spark.createDataFrame(samples, "session_id long, utc_s double, a_e double, a_n double, a_u double"), 0.06).collect()
    assert len(got) == len(epochs)
    known = sorted(s for s in samples if s[0] == 1 and None not in s)
    by = {s: sorted((r for r in got if r.session_id == s), key=lambda r: r.utc_s) for s in (1, 2, 3)}
    for a, b in zip(by[1], by[1][1:]):
        dv, dp, covered = np.zeros(3), np.zeros(3), 0.0
        for j, (_, ts, *force) in enumerate(known):
            end = min(ts + 0.06, known[j + 1][1] if j + 1 < len(known) else np.inf, b.utc_s)
            begin = max(ts, a.utc_s)
            if end > begin:
                dv += np.array(force) * (end - begin)
                dp += np.array(force) * (end - begin) * (b.utc_s - (begin + end) / 2)
                covered += end - begin
        assert np.allclose([b.dv_e, b.dv_n, b.dv_u, b.dp_e, b.dp_n, b.dp_u, b.covered_s], [*dv, *dp, covered], atol=1e-9)
    assert all(r.covered_s == 0 and r.dv_e == 0 and r.n_imu == 0 for s in (2, 3) for r in by[s]) and by[1][0].covered_s == 0


def test_steps_sort_the_samples_once(spark):
    """Samples are sorted by time only, and summed by hashing; values of any type stay with their epochs."""
    columns = "session_id long, utc_s double, n int, name string, ok boolean, parts array<double>, ve float"
    epochs = [(1, 0.0, 7, "a", True, [1.0, None], -0.0), (1, 1.0, None, None, None, None, None), (1, 2.0, -1, "", False, [], float("nan")), (2, 0.0, 1, "b", None, [2.0], 1.0)]
    samples = [(1, k / 10, 1.0, 0.0, 2.0) for k in range(-3, 25)] + [(3, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(epochs, columns)
    got = preintegration.preintegrate(df, spark.createDataFrame(samples, "session_id long, utc_s double, a_e double, a_n double, a_u double"), 0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # One more sort, of steps, follows the sums.
    assert "SortAggregate" not in plan and plan.count("Sort [") == 2
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert [(round(r.dv_e, 9), r.n_imu) for r in got.orderBy("session_id", "utc_s").collect()] == [(0.0, 0), (1.0, 10), (1.0, 10), (0.0, 0)]


def test_bias_is_the_moving_average(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(k), *rng.normal(0, 0.3, 6).tolist(), bool(k % 11 == 3), 7.0 if k % 7 == 0 else 1.0, 20) for k in range(60)]
    df = spark.createDataFrame(rows, "session_id long, utc_s double, ve double, vn double, vu double, dv_e double, dv_n double, dv_u double, bad_doppler boolean, sigma_eff double, n_imu int")
    bias, n = np.zeros(3), 0
    for a, b in zip(rows, rows[1:]):
        off = np.array(b[5:8]) - (np.array(b[2:5]) - np.array(a[2:5]))
        if not (a[8] or b[8]) and b[9] <= 5 and np.linalg.norm(off) <= 2:
            bias, n = 0.95 * bias + 0.05 * off, n + 1
    r = preintegration.doppler_bias(df).first()
    assert n >= 10 and np.allclose([r.bias_e, r.bias_n, r.bias_u], bias)
    assert preintegration.doppler_bias(df.limit(8)).first().bias_e == 0


def frame(spark, session, epochs, quality=2):
    return [(session, *map(float, r[["utc_s", "e_m", "n_m", "u_m", "ve", "vn", "vu"]]), 0.3, 0.3, quality) for _, r in epochs.iterrows()]


def test_tiers_carry_poor_epochs_by_samples(spark):
    truth, epochs, samples = drive(bias_f=(0, 0, 0), bias_w=(0, 0, 0))
    heading = np.interp(samples.utc_s, truth.utc_s, truth.heading)
    local = pd.DataFrame({"utc_s": samples.utc_s, "a_e": samples.ax * np.sin(heading) - samples.ay * np.cos(heading), "a_n": samples.ax * np.cos(heading) + samples.ay * np.sin(heading), "a_u": samples.az - 9.80665})
    lost = (epochs.utc_s > 74) & (epochs.utc_s < 86)
    rows = [r for r in frame(spark, 1, epochs) if not 74 < r[1] < 86]
    rows += [(1, float(x), None, None, None, None, None, None, 50.0, 50.0, 5) for x in epochs.utc_s[lost]]
    df = spark.createDataFrame(rows, TRACK)
    imu = spark.createDataFrame([(1, *map(float, r)) for r in local.to_numpy()], "session_id long, utc_s double, a_e double, a_n double, a_u double")
    error = {}
    for name, source in (("with", imu), ("without", None)):
        got = preintegration.tiered_filter(df, source, sigma_a=1.5).toPandas().sort_values("utc_s").reset_index(drop=True)
        assert (got.tier[lost.to_numpy()] == "weak").all() and (got.tier == "strong").sum() > 80
        error[name] = np.hypot(got.e_s - truth.e, got.n_s - truth.n)[lost].mean()
    assert error["with"] < 0.5 * error["without"]


def dense_reckoning(d, scale):
    """Nine states with whole matrices, as a plain loop."""
    n = len(d)
    z, v = d[["e_m", "n_m", "u_m"]].to_numpy(float), d[["ve", "vn", "vu"]].to_numpy(float)
    x = np.concatenate([z[0], np.nan_to_num(v[0]), np.zeros(3)])
    p = np.diag([9.0, 9, 100, 1, 1, 4, 4, 4, 8])
    xs, ps, xp, pp, fs = [x], [p], [x], [p], [np.eye(9)]
    for k in range(1, n):
        h = d.utc_s[k] - d.utc_s[k - 1]
        f = np.kron(np.array([[1, h, h * h / 2], [0, 1, h], [0, 0, 1]]), np.eye(3))
        q = np.kron(np.array([[h**4 / 4, h**3 / 2, 0], [h**3 / 2, h * h, 0], [0, 0, h]]), np.diag([1, 1, 4.0]))
        x, p = f @ x, f @ p @ f.T + q
        xp.append(x), pp.append(p), fs.append(f)
        updates = []
        if scale[k] is not None:
            updates.append((z[k], np.eye(9)[:3], (scale[k] * np.array([0.5, 0.5, 1.5])) ** 2))
        if np.isfinite(v[k]).all():
            updates.append((v[k], np.eye(9)[3:6], np.array([0.3, 0.3, 0.5]) ** 2))
        if d.standing[k]:
            updates.append((np.zeros(3), np.eye(9)[3:6], np.full(3, 0.03**2)))
        for value, w, r in updates:
            gain = p @ w.T @ np.linalg.inv(w @ p @ w.T + np.diag(r))
            x, p = x + gain @ (value - w @ x), p - gain @ w @ p
        xs.append(x), ps.append(p)
    for k in range(n - 2, -1, -1):
        gain = ps[k] @ fs[k + 1].T @ np.linalg.inv(pp[k + 1] + 1e-12 * np.eye(9))
        xs[k], ps[k] = xs[k] + gain @ (xs[k + 1] - xp[k + 1]), ps[k] + gain @ (ps[k + 1] - pp[k + 1]) @ gain.T
    return np.array(xs), np.array(ps)


def test_dead_reckoning_by_whole_matrices(spark):
    _, epochs, _ = drive(noise=0.05)
    epochs = epochs[(epochs.utc_s < 50) | (epochs.utc_s > 58)]
    rows = frame(spark, 1, epochs)
    rows = [(*r[:7], None if k % 9 == 4 else r[7], *r[8:10], (1, 2, 4, 5, None, 3)[k % 6]) for k, r in enumerate(rows)]
    short = [(2, float(k), float(k), 0.0, 0.0, 1.0, 0.0, 0.0, 0.3, 0.3, 2) for k in range(5)] + [(3, 1.0, 2.0, 3.0, 4.0, None, None, None, None, None, None)]
    got = reckoning.dead_reckon(spark.createDataFrame(rows + short, TRACK)).toPandas().sort_values(["session_id", "utc_s"])
    a = got[got.session_id == 1].reset_index(drop=True)
    assert 5 < a.standing.sum() < 20
    want, cov = dense_reckoning(a, [{1: 0.02, 2: 1.0, 4: 3.0, 5: 10.0, 3: 10.0}.get(q if pd.notna(q) else None) for q in a.quality])
    assert np.allclose(a[["e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s"]], want[:, :6], atol=1e-6)
    assert np.allclose(a.sigma_h, np.sqrt(cov[:, 0, 0] + cov[:, 1, 1]), atol=1e-6)
    assert len(got[got.session_id == 2]) == 5 and got[got.session_id == 3][["e_s", "n_s", "u_s"]].to_numpy().tolist() == [[2.0, 3.0, 4.0]]


def test_standing_runs(spark):
    x = [0, 0, 0, 0.1, 5, 10, 10, 15, 15, 15, 15.1]
    rows = [(1, float(k), float(v), 0.0, 0.0, 0.0, 0.0, 0.0, 0.3, 0.3, 2) for k, v in enumerate(x)]
    got = [r.standing for r in sorted(reckoning.standing(spark.createDataFrame(rows, TRACK)).collect(), key=lambda r: r.utc_s)]
    assert got == [True] * 4 + [False] * 3 + [True] * 4


def test_robust_chain_is_the_least_of_its_cost():
    """Against dense normal equations of the same cost, weighted again until still."""
    rng = np.random.default_rng(3)
    cuts = np.array([0, 30, 55, 56])
    n = 56
    dt = rng.uniform(0.5, 2.0, n)
    dt[cuts[:-1]] = 0.0
    z, v = rng.normal(0, 1, (n, 3)), rng.normal(0, 1, (n, 3))
    z[rng.integers(0, n, 8)] += 40
    z[[5, 33]] = np.nan
    v[[7, 40]] = np.nan
    sigma, sigma_v = rng.uniform(0.5, 2.0, (n, 3)), np.full((n, 3), 0.3)
    push = rng.normal(0, 0.2, (n, 3)), rng.normal(0, 0.2, (n, 3))
    for part in push:
        part[cuts[:-1]] = 0.0  # no step leads to a session's first row
    x, vel, weight = reckoning.robust_chain(cuts, z, sigma, v, sigma_v, dt, 0.5, push, rounds=200, tolerance=1e-10)
    assert (weight < 0.2).sum() >= 5
    for a, b in zip(cuts[:-1], cuts[1:]):
        w = np.ones(b - a)
        for _ in range(200):
            best = np.zeros((b - a, 3, 2))
            for axis in range(3):
                m, y = np.zeros((2 * (b - a), 2 * (b - a))), np.zeros(2 * (b - a))

                def add(row, value, info):
                    nonlocal m, y
                    m += row.T @ info @ row
                    y += row.T @ info @ value

                eye = np.eye(2 * (b - a))
                known = np.flatnonzero(np.isfinite(z[a:b, axis]))
                add(eye[:2], np.array([z[a + known[0], axis], np.nan_to_num(v[a, axis])]), np.diag([1e-4, 1e-2]))
                for k in range(a, b):
                    i = 2 * (k - a)
                    if k > a:
                        h = dt[k]
                        f = np.array([[1, h], [0, 1]])
                        # The motion's noise is one of acceleration: singular, so a tiny part is added for the inverse.
                        q = 0.25 * np.array([[h**4 / 4, h**3 / 2], [h**3 / 2, h * h]]) + 1e-9 * np.eye(2)
                        add(eye[i : i + 2] - f @ eye[i - 2 : i], np.array([push[0][k, axis], push[1][k, axis]]), np.linalg.inv(q))
                    if np.isfinite(z[k, axis]):
                        add(eye[i : i + 1], z[k, axis : axis + 1], np.array([[w[k - a] / sigma[k, axis] ** 2]]))
                    if np.isfinite(v[k, axis]):
                        add(eye[i + 1 : i + 2], v[k, axis : axis + 1], np.array([[1 / 0.09]]))
                best[:, axis] = np.linalg.solve(m, y).reshape(-1, 2)
            size = np.sqrt(np.nansum(((z[a:b] - best[:, :, 0]) / sigma[a:b]) ** 2, axis=1))
            new = np.where(size > 1.345, 1.345 / np.maximum(size, 1.345), 1.0)
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        assert np.allclose(x[a:b], best[:, :, 0], atol=2e-4) and np.allclose(vel[a:b], best[:, :, 1], atol=2e-4)
        assert np.allclose(weight[a:b], w, atol=1e-4)


def test_factor_chain_weighs_outliers_down(spark):
    truth, epochs, _ = drive()
    epochs.loc[[30, 60, 61], "n_m"] += 50
    rows = frame(spark, 1, epochs, quality=1) + [(2, 1.0, 1.0, 2.0, 3.0, None, None, None, None, None, 5)]
    got = reckoning.factor_chain(spark.createDataFrame(rows, TRACK)).toPandas().sort_values(["session_id", "utc_s"])
    a = got[got.session_id == 1].reset_index(drop=True)
    assert a.weight[[30, 60, 61]].max() < 0.02 and a.weight.median() > 0.8
    assert np.hypot(a.e_s - truth.e, a.n_s - truth.n).max() < 1.5
    assert len(got) == len(rows)


def test_smoothers_with_samples_are_registered(spark):
    from tracelake.operators import smoothers

    _, epochs, samples = drive(seconds=40)
    df = spark.createDataFrame(frame(spark, 1, epochs), TRACK)
    imu = spark.createDataFrame([(1, *map(float, r)) for r in samples.to_numpy()], "session_id long, utc_s double, ax double, ay double, az double, gx double, gy double, gz double")
    for name in ("ekf_smoothed", "v2_imu_adaptive", "epoch_weight_v2_imu_bridge", "fgo", "dead_reckoning", "gnss_imu_dr"):
        for source in (None, imu):
            assert smoothers.run(name, df, source).where("e_s IS NOT NULL AND n_s IS NOT NULL AND u_s IS NOT NULL").count() == len(epochs), name
    with pytest.raises(KeyError):
        smoothers.run("none", df)
    assert kernels.SIDE_BY_SIDE > 0


def test_error_state_of_many_sessions_is_that_of_each():
    parts = []
    for s, seconds in enumerate((30, 45, 1, 30)):
        _, epochs, samples = drive(seconds=40, noise=0.05)
        epochs = epochs[epochs.utc_s < seconds].reset_index(drop=True)
        epochs.loc[s + 1 :: 7, "vu"] = np.nan
        epochs["standing"] = (epochs.utc_s > 5 * s + 3) & (epochs.utc_s < 5 * s + 8)
        parts.append((epochs, samples.iloc[: 0 if s == 1 else len(samples)].reset_index(drop=True)))
    epochs, samples = (pd.concat([p[k] for p in parts], ignore_index=True) for k in (0, 1))
    cuts, sample_cuts = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 1))
    got = error_state.smooth_all(epochs, cuts, samples, sample_cuts)
    for s, (one, own) in enumerate(parts):
        alone = error_state.smooth(one, own)
        for c in error_state.OUT:
            assert np.allclose(got[c][cuts[s] : cuts[s + 1]], alone[c], atol=1e-6), (s, c)


def _odd_sessions(rng, sessions=7):
    """Epochs with holes, missing values, stops and poor solutions, and samples with gaps; session 5 has one epoch, session 6 no samples."""
    epochs, samples = [], []
    for s in range(sessions):
        n = 1 if s == 5 else int(rng.integers(30, 60))
        t = np.cumsum(rng.choice([0.9, 1.0, 1.3, 7.0], n, p=[0.3, 0.4, 0.2, 0.1]))
        speed = np.where(np.arange(n) % 25 < 8, 0.05, 9.0) + (0.0 if s % 2 else 2.0)
        e = np.cumsum(speed) + rng.normal(0, 1.0, n)
        for k in range(n):
            vu = None if rng.random() < 0.1 else 0.0
            quality = None if rng.random() < 0.03 else int(rng.choice([1, 2, 4, 5], p=[[0.2, 0.3, 0.1, 0.4], [0.1, 0.6, 0.1, 0.2], [0.6, 0.2, 0.1, 0.1]][s % 3]))
            epochs.append((s, float(t[k]), float(e[k]), float(rng.normal(0, 1)), float(rng.normal(5, 2)), float(speed[k]), float(rng.normal(0, 0.1)), vu, float(rng.uniform(0.1, 5)), float(rng.uniform(0.1, 5)), 1.5, quality, int(rng.integers(4, 20))))
        if s != 6:
            for x in np.arange(t[0] - 0.5, t[-1] + 0.5, 0.08):
                if rng.random() < 0.9:
                    samples.append((s, float(x), *rng.normal(0, 0.2, 2).tolist(), 9.81, 0.0, 0.0, None if rng.random() < 0.01 else 0.01))
    return epochs, samples


ODD = "session_id long, utc_s double, e_m double, n_m double, u_m double, ve double, vn double, vu double, sd_n double, sd_e double, sd_u double, quality int, ns int"
IMU = "session_id long, utc_s double, ax double, ay double, az double, gx double, gy double, gz double"


def test_a_bake_off_folds_all_smoothers_at_once(spark):
    from tracelake.operators import smoothers

    epochs, samples = _odd_sessions(np.random.default_rng(11))
    df, imu = spark.createDataFrame(epochs, ODD), spark.createDataFrame(samples, IMU)
    # Some epochs have no truth, one has two.
    true = [(r[0], r[1], r[2] + 0.3, r[3]) for k, r in enumerate(epochs) if k % 11] + [(epochs[1][0], epochs[1][1], 0.0, 1.0), (99, 1.0, 0.0, 0.0), (None, epochs[2][1], 0.0, 0.0)]
    truth = spark.createDataFrame(true, "session_id long, utc_s double, gt_e double, gt_n double")
    out = smoothers.run_all(df, truth, imu=imu)
    got = out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("MapInPandas") == 1
    assert {r.smoother for r in got} == set(smoothers.names()) and [r.h_rmse_m for r in got] == sorted(r.h_rmse_m for r in got)
    for r in got:
        if r.smoother in ("raw", "gaussian_car", "ctrv", "ekf_smoothed", "v2_imu_adaptive", "fgo", "kalman_smart"):
            d = smoothers.run(r.smoother, df, imu).select("session_id", "utc_s", "e_s", "n_s").toPandas().merge(truth.toPandas(), on=["session_id", "utc_s"])
            d = d.assign(de=d.e_s - d.gt_e, dn=d.n_s - d.gt_n)
            m = d.groupby("session_id")[["de", "dn"]].transform("median")
            h = np.hypot(d.de - m.de, d.dn - m.dn)
            assert r.n == len(h) and abs(r.h_rmse_m - np.sqrt((h**2).mean())) < 1e-4 and abs(r.h_p95_m - np.quantile(h, 0.95)) < 1e-4, r
    none = smoothers.run_all(df.limit(0), truth, ["raw", "cv_rts"]).collect()
    assert [(r.smoother, r.n, r.h_rmse_m) for r in none] == [("raw", 0, None), ("cv_rts", 0, None)]
    with pytest.raises(KeyError):
        smoothers.run_all(df, truth, ["none"])


def test_sums_and_tiers_of_folds_equal_those_of_tables(spark):
    from pyspark.sql import functions as F

    from tracelake.operators import constraints, inertial, smoothers, smoothing

    epochs, samples = _odd_sessions(np.random.default_rng(12))
    df = spark.createDataFrame(epochs, ODD)
    imu = spark.createDataFrame([x for x in samples if None not in x], IMU)
    local = preintegration.local_forces(imu)
    key = ["session_id", "utc_s"]
    rows = df.toPandas().sort_values(key).reset_index(drop=True)
    for name, options in (("v2_imu_adaptive", {}), ("epoch_weight_v2_imu_bridge", {"medium": 6.0, "alpha": None})):
        want = preintegration.tiered_filter(df, local, **options).toPandas().sort_values(key)
        got = smoothers.run(name, df, imu).toPandas().sort_values(key)
        assert (want.n_imu > 0).sum() > 100 and np.allclose(want[["e_s", "n_s", "u_s"]], got[["e_s", "n_s", "u_s"]], atol=1e-7), name
    want = reckoning.factor_chain(df, local).toPandas().sort_values(key)
    assert np.allclose(want[["e_s", "n_s", "u_s"]], smoothers.run("fgo", df, imu).toPandas().sort_values(key)[["e_s", "n_s", "u_s"]], atol=2e-3)
    # Gaussians with missing values, and the adaptive choice.
    cuts = np.append(kernels.session_starts(rows["session_id"]), len(rows))
    holes = df.withColumn("e_m", F.when(F.col("ns") > 5, F.col("e_m")))
    want = smoothing.gaussian_rows(holes, ["e_m"], 2.0).toPandas().sort_values(key)["e_m_s"].to_numpy(float)
    assert np.allclose(want, smoothing.gaussian_all(cuts, np.where(rows["ns"] > 5, rows["e_m"], np.nan)[:, None], 2.0)[:, 0], equal_nan=True)
    want = rows[key].merge(constraints.adaptive(df).toPandas(), on=key, how="left")
    assert want["regime"].dropna().nunique() == 3
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x = rows[["e_m", "n_m", "u_m"]].to_numpy(float)[a:b]
        got = constraints.adaptive_rows(rows["utc_s"].to_numpy(float)[a:b], x, rows[["ve", "vn"]].to_numpy(float)[a:b], rows["quality"].to_numpy(float)[a:b])
        there = want[["e_m", "n_m", "u_m"]].to_numpy(float)[a:b]
        assert np.allclose(np.where(np.isnan(there), x, there), got)
    one = np.concatenate([inertial.turn_rate_ekf(rows["utc_s"].to_numpy()[a:b], rows[["e_m", "n_m"]].to_numpy()[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    assert np.array_equal(one, inertial.turn_rate_all(cuts, rows["utc_s"].to_numpy(), rows[["e_m", "n_m"]].to_numpy()))
