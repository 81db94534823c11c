"""Motion between epochs from inertial samples: one row of sums for each epoch, made on the JVM.

However fast the samples are, a filter at the epochs' pace needs only what they
add up to in each step. Samples and epochs share one timeline of a session; the
sums are a window and a grouping behind one shuffle, so that no sample reaches
Python and no pair of sample and epoch is made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators import gates, kernels

AXES, FORCES, RATES = ("e_m", "n_m", "u_m"), ("a_e", "a_n", "a_u"), ("ve", "vn", "vu")
G = 9.80665
#: Types whose greatest value a hash aggregation keeps in place.
_FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def local_forces(imu: DataFrame, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """by, t, a_e, a_n, a_u: samples (ax to gz, in the body) turned by their attitude to local axes, without gravity."""
    from tracelake.operators.inertial import rotate

    def run(r: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        force = r[["ax", "ay", "az"]].to_numpy(float)
        local = rotate(kernels.mahony_all(cuts, r[t].to_numpy(float), r[["gx", "gy", "gz"]].to_numpy(float), force), force) - [0, 0, G]
        return dict(zip(FORCES, local.T, strict=True))

    return kernels.per_sessions(imu.select(by, t, "ax", "ay", "az", "gx", "gy", "gz"), run, dict.fromkeys(FORCES, T.DoubleType()), by, t).select(by, t, *FORCES)


def preintegrate(track: DataFrame, imu: DataFrame, max_hold: float = 0.1, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track with what the samples since the epoch before add to velocity (dv_e, dv_n, dv_u) and place (dp_e, dp_n, dp_u).

    imu holds accelerations in local axes without gravity (a_e, a_n, a_u). A
    sample holds until the next one, max_hold seconds at most; an epoch between
    parts it exactly. covered_s: how much of the step samples hold for; n_imu:
    samples in it; shake: the deviation of their size. A session's first epoch
    has none of these (0). Samples without a time or an axis are left out, as is what
    comes before the first epoch or after the last. Repeated epochs at one time
    have a step of no length between them.
    """
    keep = [c for c in track.columns if c not in (by, t)]
    # Values of fixed size go through the sums' hash aggregation, one of a group each; the others are part of its key.
    kinds = dict(track.dtypes)
    fixed = [c for c in keep if kinds[c] in _FIXED]
    other = [c for c in keep if c not in fixed]
    epochs = track.select(by, t, F.lit(0).alias("__side"), F.struct(F.lit(True).alias("__here"), *keep).alias("__e"), *[F.lit(None).cast("double").alias(c) for c in FORCES])
    known = imu.dropna(subset=[t, *FORCES])
    samples = known.select(by, t, F.lit(1).alias("__side"), F.lit(None).cast(epochs.schema["__e"].dataType).alias("__e"), *[F.col(c).cast("double").alias(c) for c in FORCES])
    # A sample at an epoch's time is one of the step that begins there.
    order = Window.partitionBy(by).orderBy(t, "__side")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = F.when(F.col("__side") == 1, F.struct(F.col(t).cast("double").alias("t"), *FORCES))
    carried = {"__o": F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__e.{c}").alias(c) for c in other])), ignorenulls=True).over(so_far)} if other else {}
    line = samples.unionByName(epochs).withColumns(
        {"__step": F.count("__e").over(so_far), "__f": F.last(sample, ignorenulls=True).over(so_far), "__from": F.last(F.when(F.col("__side") == 0, F.col(t)), ignorenulls=True).over(so_far), "__next": F.lead(t).over(order), **carried}
    ).where("__step > 0")
    # least() passes over nulls: before the first sample and after the last event nothing holds.
    some = F.col("__f").isNotNull() & F.col("__next").isNotNull()
    held = F.when(some, F.greatest(F.lit(0.0), F.least(F.col("__next"), F.col("__f.t") + max_hold) - F.col(t))).otherwise(0.0)
    line = line.withColumns({"__w": held, "__mid": F.col(t) - F.col("__from") + held / 2})
    size = F.when(F.col("__side") == 1, F.sqrt(sum(F.col(c) ** 2 for c in FORCES)))
    sums = {f"__v{c[-1]}": F.coalesce(F.sum(F.col(f"__f.{c}") * F.col("__w")), F.lit(0.0)) for c in FORCES} | {f"__m{c[-1]}": F.coalesce(F.sum(F.col(f"__f.{c}") * F.col("__w") * F.col("__mid")), F.lit(0.0)) for c in FORCES}
    own = {t: F.col(t)} | {c: F.col(f"__e.{c}") for c in fixed}
    own = [F.max(F.when(F.col("__side") == 0, v)).alias(f"__x_{c}") for c, v in own.items()]
    steps = line.groupBy(by, "__step", *carried).agg(*own, F.sum(F.col("__next") - F.col(t)).alias("__len"), F.sum("__w").alias("__cov"), F.count(FORCES[0]).alias("__n"), F.coalesce(F.stddev_pop(size), F.lit(0.0)).alias("__shake"), *[v.alias(k) for k, v in sums.items()])
    before = Window.partitionBy(by).orderBy("__step")
    lag = lambda c: F.coalesce(F.lag(c).over(before), F.lit(0.0))
    out = {f"dv_{c}": lag(f"__v{c}") for c in "enu"} | {f"dp_{c}": lag(F.coalesce("__len", F.lit(0.0)) * F.col(f"__v{c}") - F.col(f"__m{c}")) for c in "enu"}
    out |= {"covered_s": lag("__cov"), "n_imu": F.coalesce(F.lag("__n").over(before), F.lit(0)), "shake": lag("__shake")}
    return steps.withColumns(out).select(by, F.col(f"__x_{t}").alias(t), *[F.col(f"__x_{c}" if c in fixed else f"__o.{c}").alias(c) for c in keep], *out)


def doppler_bias(steps: DataFrame, alpha: float = 0.05, medium: float = 5.0, most: float = 2.0, least: int = 10, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """steps with bias_e, bias_n, bias_u: what the samples' velocity steps have too much against Doppler, as a moving average at the session's end.

    Steps count that have 5 samples or more and good ends (sigma_eff up to medium, no bad_doppler) and are
    off by up to most; below least of them the bias is 0. A moving average
    is a sum with falling powers, so a window does it.
    """
    order = Window.partitionBy(by).orderBy(t)
    off = [F.col(f"dv_{c}") - F.coalesce(F.col(f"v{c}") - F.lag(f"v{c}").over(order), F.lit(None if c != "u" else 0.0)) for c in "enu"]
    good = (F.col("sigma_eff") <= medium) & ~F.col("bad_doppler") & ~F.lag("bad_doppler").over(order) & (F.col("n_imu") >= 5)
    rows = steps.withColumns({f"__o{c}": o for c, o in zip("enu", off, strict=True)} | {"__good": good})
    rows = rows.withColumn("__good", F.coalesce(F.col("__good") & (F.sqrt(sum(F.col(f"__o{c}") ** 2 for c in "enu")) <= most), F.lit(False)))
    later = F.count(F.when(F.col("__good"), 1)).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("__w", F.when(F.col("__good"), alpha * F.pow(F.lit(1 - alpha), later)))
    whole = Window.partitionBy(by)
    enough = F.count("__w").over(whole) >= least
    bias = {f"bias_{c}": F.when(enough, F.coalesce(F.sum(F.col("__w") * F.col(f"__o{c}")).over(whole), F.lit(0.0))).otherwise(0.0) for c in "enu"}
    return rows.withColumns(bias).drop("__good", "__w", *[f"__o{c}" for c in "enu"])


def tiered_filter(
    track: DataFrame, imu: DataFrame | None, medium: float = 5.0, weak: float = 6.0, wider: float = 2.5, gap_s: float = 3.0, sigma_a: float = 0.15, floor: float = 0.1, ceiling: float = 8.0, alpha: float | None = 0.05, max_hold: float = 0.1, least: int = 10,
    zupt_speed: float = 0.3, zupt_sigma: float = 0.02, by: str = "session_id", t: str = "utc_s",
) -> DataFrame:
    """track with e_s, n_s, u_s, ve_s, vn_s, vu_s and tier: a two-way filter that samples carry where epochs are poor.

    sigma_eff (from sd_e, sd_n) makes an epoch strong (below medium), medium, or
    weak (from weak on, or gated by Doppler); from medium to weak the position's sigma
    grows to wider times. Over steps with more than least samples that lead into or out of a medium or weak epoch, and over
    those longer than gap_s, the samples' sums less the Doppler bias (none where alpha is None) carry the state;
    elsewhere velocity is constant. Standing epochs are held still. A step of gap_s with samples for less
    than half of it isn't carried.
    """
    rows = gates.doppler_gate(gates.bad_doppler(track), 4.0)
    rows = rows.withColumn("sigma_eff", sigma_eff(floor, ceiling))
    zero = F.lit(0.0)
    if imu is None:
        rows = rows.withColumns({c: zero for k in "enu" for c in (f"dv_{k}", f"dp_{k}")} | {"covered_s": zero, "n_imu": F.lit(0), "shake": zero})
    else:
        rows = preintegrate(rows, imu, max_hold, by, t)
    rows = doppler_bias(rows, alpha, medium, by=by, t=t) if alpha else rows.withColumns({f"bias_{k}": zero for k in "enu"})
    step = F.coalesce(F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(t)), zero)
    tier = F.when(F.col("doppler_reject") | (F.col("sigma_eff") >= weak), "weak").when(F.col("sigma_eff") >= medium, "medium").otherwise("strong")
    gap = (step > gap_s) & (F.col("covered_s") >= step / 2)
    order = Window.partitionBy(by).orderBy(t)
    rows = rows.withColumn("tier", tier)
    poor = (F.col("tier") != "strong") | (F.lag("tier").over(order) != "strong")
    carried = F.coalesce((gap | (poor & (step <= gap_s))) & (F.col("n_imu") > least), F.lit(False))
    # The bias is one of a usual step; over a longer one it adds up.
    usual = F.percentile(F.when(step > 0, step), F.lit(0.5)).over(Window.partitionBy(by))
    rows = rows.withColumns({"__dt": step, "__carried": carried, "__usual": F.coalesce(usual, F.lit(1.0))})

    def fold(r: pd.DataFrame, cuts: np.ndarray) -> dict[str, np.ndarray]:
        dv, dp, bias = (r[[f"{c}_{k}" for k in "enu"]].to_numpy(float) for c in ("dv", "dp", "bias"))
        return carried_filter(
            cuts, r[[*AXES]].to_numpy(float), r[[*RATES]].to_numpy(float), r["__dt"].to_numpy(float), r["__carried"].to_numpy(bool), dv, dp, bias, r["__usual"].to_numpy(float), r["sigma_eff"].to_numpy(float),
            r["tier"].to_numpy() == "weak", r["doppler_reject"].to_numpy(bool), r["bad_doppler"].to_numpy(bool), medium, weak, wider, sigma_a, zupt_speed, zupt_sigma,
        )

    out = dict.fromkeys(("e_s", "n_s", "u_s", "ve_s", "vn_s", "vu_s"), T.DoubleType())
    return kernels.per_sessions(rows, fold, out, by, t).select(*track.columns, "tier", "covered_s", "n_imu", *[F.col(f"bias_{c}") for c in "enu"], *out)


def sigma_eff(floor: float = 0.1, ceiling: float = 8.0) -> Column:
    sd = F.sqrt(F.col("sd_n") ** 2 + F.col("sd_e") ** 2 + floor**2)
    return F.coalesce(F.least(F.lit(ceiling), F.greatest(F.lit(floor), sd)), F.lit(4.0))


def carried_filter(
    cuts: np.ndarray, z: np.ndarray, v: np.ndarray, dt: np.ndarray, carried: np.ndarray, dv: np.ndarray, dp: np.ndarray, bias: np.ndarray, usual: np.ndarray, sigma: np.ndarray, is_weak: np.ndarray, reject: np.ndarray, bad: np.ndarray,
    medium: float = 5.0, weak: float = 6.0, wider: float = 2.5, sigma_a: float = 0.15, zupt_speed: float = 0.3, zupt_sigma: float = 0.02,
) -> dict[str, np.ndarray]:
    """The filter of tiered_filter() for the rows of many sessions."""
    dt, on = np.maximum(dt, 0.0)[:, None], carried[:, None]
    rate = bias / usual[:, None]
    kick = np.where(on, dv - rate * dt, 0.0)
    shift = np.where(on, dp - rate * dt**2 / 2, 0.0)
    share = np.clip((sigma - medium) / max(weak - medium, 0.01), 0.0, 1.0)
    share[is_weak] = 1.0
    r_pos = ((sigma * (1 + share * (wider - 1)))[:, None] * np.array([1.0, 1.0, 2.5])) ** 2
    z = np.where(reject[:, None], np.nan, z)
    still = np.hypot(v[:, 0], v[:, 1]) < zupt_speed
    v = np.where(bad[:, None], np.nan, v)
    r_vel = np.full(v.shape, 0.3**2)
    v[still], r_vel[still] = 0.0, zupt_sigma**2
    first, known = kernels._first_known(cuts, z)
    start = np.where(known, np.take_along_axis(z, first, 0), 0.0), np.nan_to_num(v[cuts[:-1]]), 9.0, 4.0
    x, vel, _, _ = kernels.two_state(cuts, z, r_pos, dt[:, 0], sigma_a, start, v, r_vel, push=(shift, kick), variances=False)
    return {f"{c}_s": x[:, k] for k, c in enumerate("enu")} | {f"v{c}_s": vel[:, k] for k, c in enumerate("enu")}


def tiered_rows(
    cuts: np.ndarray, z: np.ndarray, v: np.ndarray, times: np.ndarray, sigma: np.ndarray, reject: np.ndarray, bad: np.ndarray, sums: tuple[np.ndarray, ...] | None, medium: float = 5.0, weak: float = 6.0, gap_s: float = 3.0, alpha: float | None = 0.05, least: int = 10
) -> dict[str, np.ndarray]:
    """tiered_filter() of many sessions' rows; sums are step_sums()."""
    dv, dp, covered, n_imu = sums or (np.zeros(z.shape), np.zeros(z.shape), np.zeros(len(z)), np.zeros(len(z), int))
    bias = doppler_bias_rows(cuts, dv, v, sigma, bad, n_imu, alpha, medium) if alpha else np.zeros(z.shape)
    step = np.diff(times, prepend=times[:1])
    step[cuts[:-1]] = 0.0
    is_weak = reject | (sigma >= weak)
    poor = is_weak | (sigma >= medium)
    led = np.append(False, poor[:-1])
    led[cuts[:-1]] = False
    gap = (step > gap_s) & (covered >= step / 2)
    carried = (gap | ((poor | led) & (step <= gap_s))) & (n_imu > least)
    return carried_filter(cuts, z, v, step, carried, dv, dp, bias, kernels.usual_step(times, cuts), sigma, is_weak, reject, bad, medium, weak)


def step_sums(cuts: np.ndarray, times: np.ndarray, sample_cuts: np.ndarray, ts: np.ndarray, force: np.ndarray, max_hold: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """preintegrate() of many sessions' rows and samples (local axes): dv, dp, covered_s and n_imu of the step to each row."""
    from tracelake.operators.error_state import pieces

    n = len(times)
    sample, k, begin, dt, within = pieces(times, ts, max_hold, cuts, sample_cuts) if len(ts) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(n, int))
    mid = begin - times[k - 1] + dt / 2
    length = np.diff(times, prepend=times[:1])
    total = lambda w: np.bincount(k, w, minlength=n)
    dv, lag = (np.stack([total(force[sample, c] * w) for c in range(3)], 1) for w in (dt, dt * mid))
    return dv, length[:, None] * dv - lag, total(dt), within


def doppler_bias_rows(cuts: np.ndarray, dv: np.ndarray, v: np.ndarray, sigma: np.ndarray, bad: np.ndarray, n_imu: np.ndarray, alpha: float = 0.05, medium: float = 5.0, most: float = 2.0, least: int = 10) -> np.ndarray:
    """doppler_bias() of many sessions' rows."""
    first = cuts[:-1]
    change = np.diff(v, axis=0, prepend=v[:1])
    change[first] = np.nan
    off = dv - np.where(np.isnan(change) & [False, False, True], 0.0, change)
    led = np.append(True, bad[:-1])
    led[first] = True
    good = (sigma <= medium) & ~bad & ~led & (n_imu >= 5) & (np.sqrt((off**2).sum(1)) <= most)
    so_far = np.cumsum(good)
    count = np.add.reduceat(good, first, dtype=np.int64)
    later = np.repeat(so_far[cuts[1:] - 1], np.diff(cuts)) - so_far
    weight = np.where(good, alpha * (1 - alpha) ** later, 0.0)
    bias = np.add.reduceat(weight[:, None] * np.where(good[:, None], off, 0.0), first, axis=0)
    return np.repeat(np.where(count[:, None] >= least, bias, 0.0), np.diff(cuts), axis=0)
