"""Gates: which epochs to trust, with the reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.motion import ordered, steps, with_enu


def static_reasons(max_q: int = 2, drop_q: tuple[int, ...] = (5, 6), min_ns: int = 5, sigma_h: float = 5.0, sigma_v: float = 10.0, max_age: float = 30.0, max_speed: float = 50.0) -> Column:
    """First gate of the ordered cascade that an epoch fails, or null.

    Missing sigmas fail; missing age or speed passes. Needs quality, ns, sd_n,
    sd_e, sd_u, age_s, vn, ve.
    """
    sd = F.sqrt(F.col("sd_n") ** 2 + F.col("sd_e") ** 2)
    speed = F.sqrt(F.col("vn") ** 2 + F.col("ve") ** 2)
    return (
        F.when(F.col("quality").isin(*drop_q), "drop_q")
        .when(F.col("quality") > max_q, "quality")
        .when(F.col("ns") < min_ns, "ns")
        .when(sd.isNull() | (sd > sigma_h), "sigma_h")
        .when(F.col("sd_u").isNull() | (F.col("sd_u") > sigma_v), "sigma_v")
        .when(F.col("age_s") > max_age, "age")
        .when(speed > max_speed, "speed")
    )


def quality_gate(track: DataFrame, max_q: int = 2) -> DataFrame:
    return track.where((F.col("quality") > 0) & (F.col("quality") <= max_q))


def bad_doppler(track: DataFrame, max_speed: float = 100.0, max_accel: float = 15.0, max_sigma: float = 5.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track with bad_doppler: missing, too fast, too sharp a change (steps up to 5 s), or too uncertain."""
    w = ordered(by, t)
    dt = F.col(t) - F.lag(t).over(w)
    dv = F.sqrt((F.col("ve") - F.lag("ve").over(w)) ** 2 + (F.col("vn") - F.lag("vn").over(w)) ** 2)
    speed = F.sqrt(F.col("ve") ** 2 + F.col("vn") ** 2)
    missing = F.col("ve").isNull() | F.col("vn").isNull() | F.col("vu").isNull()
    sharp = (dt > 0) & (dt <= 5) & (dv / dt > max_accel)
    wide = F.greatest("sd_vn", "sd_ve", "sd_vu") > max_sigma if "sd_vn" in track.columns else F.lit(False)
    return track.withColumn("bad_doppler", missing | F.coalesce(speed > max_speed, F.lit(False)) | F.coalesce(sharp, F.lit(False)) | F.coalesce(wide, F.lit(False)))


def session_median(df: DataFrame, col: str, name: str, by: str = "session_id") -> DataFrame:
    """df with the session's exact median of col."""
    return df.withColumn(name, F.median(col).over(Window.partitionBy(by)))


def median_and_mad(df: DataFrame, col: str, by: str = "session_id") -> DataFrame:
    """df with col_med and col_mad (median absolute deviation from the median, unscaled)."""
    rows = session_median(df, col, f"{col}_med", by).withColumn("__dev", F.abs(F.col(col) - F.col(f"{col}_med")))
    return session_median(rows, "__dev", f"{col}_mad", by).drop("__dev")


def gradient(col: str, by: str = "session_id", t: str = "utc_s") -> Column:
    """Second-order derivative of col in unevenly spaced time, one-sided at the ends."""
    w = ordered(by, t)
    hd, hs = F.lead(t).over(w) - F.col(t), F.col(t) - F.lag(t).over(w)
    nxt, prv, here = F.lead(col).over(w), F.lag(col).over(w), F.col(col)
    inner = (hs * hs * nxt + (hd * hd - hs * hs) * here - hd * hd * prv) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (nxt - here) / hd).when(hd.isNull(), (here - prv) / hs).otherwise(inner)


def doppler_gate(enu: DataFrame, k: float = 5.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """enu with disagree_mps (position gradient against Doppler) and doppler_reject: above median + k * 1.4826 * MAD."""
    return doppler_gates(enu, {"doppler_reject": k}, by, t)


def doppler_gates(enu: DataFrame, gates: dict[str, float], by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """doppler_gate() for several k at once: enu with disagree_mps and a column for each entry name: k."""
    ge, gn = gradient("e_m", by, t), gradient("n_m", by, t)
    rows = enu.withColumn("disagree_mps", F.sqrt((ge - F.col("ve")) ** 2 + (gn - F.col("vn")) ** 2))
    rows = median_and_mad(rows, "disagree_mps", by)
    flag = lambda k: (F.col("disagree_mps_mad") >= 1e-9) & (F.col("disagree_mps") > F.col("disagree_mps_med") + k * 1.4826 * F.col("disagree_mps_mad"))
    return rows.withColumns({name: F.coalesce(flag(k), F.lit(False)) for name, k in gates.items()}).drop("disagree_mps_med", "disagree_mps_mad")


def plausibility(track: DataFrame, max_horiz: float = 40.0, max_vert: float = 10.0, below_m: float = 35.0, above_m: float = 50.0, k: float = 8.0, floor_m: float = 8.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track in local coordinates with reasons: altitude window, speeds and a MAD gate on steps."""
    rows = steps(with_enu(track, by, t), by, t)
    rows = median_and_mad(session_median(rows, "h_m", "__hmed", by), "step_m", by)
    limit = F.greatest(F.col("step_m_med") + k * F.col("step_m_mad"), F.lit(floor_m))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    reasons = F.array(
        F.when(F.col("h_m") > F.col("__hmed") + above_m, "alt_high"),
        F.when(F.col("h_m") < F.col("__hmed") - below_m, "alt_low"),
        F.when(F.col("climb_mps") > max_vert, "vert_speed"),
        F.when(F.col("speed_mps") > max_horiz, "horiz_speed"),
        F.when((n >= 3) & (F.col("step_m") > limit), "pos_jump"),
    )
    return rows.withColumn("reasons", F.array_compact(reasons)).drop("__hmed", "step_m_med", "step_m_mad")


def device_track_gate(interpolated: DataFrame, max_m: float = 10.0) -> DataFrame:
    """Epochs against the interpolated device track (d_lat, d_lon): far ones go, unknown ones stay."""
    north = (F.col("lat_deg") - F.col("d_lat")) * 111320.0
    east = (F.col("lon_deg") - F.col("d_lon")) * 111320.0 * F.cos(F.radians("lat_deg"))
    far = F.sqrt(north * north + east * east)
    return interpolated.withColumn("disagree_m", far).withColumn("keep", F.coalesce(far <= max_m, F.lit(True)))


def inertial_velocity(track: DataFrame, imu: DataFrame, max_sd: float = 0.1, least: int = 30, times: float = 3.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """track (ve, vn, sd_ve, sd_vn) with imu_score and imu_reject: changes of velocity that inertial samples don't explain.

    imu holds accelerations turned to east and north without gravity (a_e, a_n),
    of which steps of up to 0.1 s between two epochs are summed. Epochs with
    sure velocities (at least so many, with more than ten samples) give the
    session's bias and spread; without them, or with a spread of nothing, no
    epoch is rejected. Samples and epochs are put on one timeline: one shuffle.
    """
    w = ordered(by, t)
    marks = track.select(by, t, F.lit(1).alias("__epoch"), F.lit(None).cast("double").alias("a_e"), F.lit(None).cast("double").alias("a_n"))
    line = marks.unionByName(imu.select(by, t, F.lit(0).alias("__epoch"), "a_e", "a_n"))
    place = F.sum("__epoch").over(Window.partitionBy(by).orderBy(t, F.desc("__epoch")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    samples = line.withColumn("__k", place).where("__epoch = 0")
    inside = Window.partitionBy(by, "__k").orderBy(t)
    samples = samples.withColumn("__dt", F.lead(t).over(inside) - F.col(t))
    used = (F.col("__dt") > 0) & (F.col("__dt") <= 0.1)
    sums = samples.groupBy(by, "__k").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.when(used, F.col(f"a_{c}") * F.col("__dt")).otherwise(0.0)).alias(f"__i{c}") for c in "en"])
    rows = track.withColumn("__k", F.row_number().over(w).cast("long"))
    # What lies before the k-th epoch are the samples after the one before it.
    sums = sums.withColumn("__k", F.col("__k") + 1).where("__k > 1")
    rows = rows.join(sums, [by, "__k"], "left")
    known = F.coalesce(F.col("__n"), F.lit(0)) >= 2
    change = {f"__g{c}": F.coalesce(F.col(f"v{c}") - F.lag(f"v{c}").over(w), F.lit(0.0)) for c in "en"}
    rows = rows.withColumns(change).withColumns({f"__i{c}": F.when(known, F.col(f"__i{c}")).otherwise(0.0) for c in "en"})
    sure = F.coalesce((F.col("__n") > 10) & (F.sqrt(F.col("sd_ve") ** 2 + F.col("sd_vn") ** 2) < max_sd), F.lit(False))
    whole = Window.partitionBy(by)
    rows = rows.withColumn("__sure", sure)
    rows = rows.withColumns({f"__d{c}": F.col(f"__g{c}") - F.col(f"__i{c}") for c in "en"})
    rows = rows.withColumns({f"__b{c}": F.median(F.when(F.col("__sure"), F.col(f"__d{c}"))).over(whole) for c in "en"} | {f"__s{c}": F.stddev_pop(F.when(F.col("__sure"), F.col(f"__d{c}"))).over(whole) for c in "en"} | {"__sured": F.count_if("__sure").over(whole)})
    fit = (F.col("__sured") >= least) & (F.col("__se") >= 1e-6) & (F.col("__sn") >= 1e-6)
    judged = F.coalesce(fit & (F.col("__n") >= 5), F.lit(False))
    off = {c: F.abs(F.col(f"__d{c}") - F.col(f"__b{c}")) / F.col(f"__s{c}") for c in "en"}
    score = F.when(judged, F.sqrt(off["e"] ** 2 + off["n"] ** 2)).otherwise(0.0)
    reject = judged & ((off["e"] > times) | (off["n"] > times))
    return rows.withColumns({"imu_score": score, "imu_reject": F.coalesce(reject, F.lit(False))}).select(*track.columns, "imu_score", "imu_reject")
