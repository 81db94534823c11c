"""Per-epoch quality expressions: sigma models, floors, labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values by solution quality (1 fix, 2 float, 4 differential, 5 single).
FLOOR_M = {1: 0.20, 2: 1.00, 4: 2.00, 5: 3.00}
BIAS_M = {1: 0.3, 2: 2.0, 4: 5.0, 5: 10.0}
SCORE = {1: 1.0, 2: 0.5, 4: 0.2, 5: 0.05}


def by_quality(quality: Column, values: dict[int, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*values.items()))), quality.cast("int")), F.lit(default))


def quality_floor(quality: Column) -> Column:
    return by_quality(quality, FLOOR_M, 1.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigma_h_from_ns(ns: Column, lo: float = 0.10, hi: float = 6.06, k: float = 10.23, w: float = 4.18) -> Column:
    """Logistic in the number of satellites."""
    return lo + (hi - lo) / (1.0 + F.exp((ns - k) / w))


def sigma_v_from_ns(ns: Column) -> Column:
    return 2.5 * sigma_h_from_ns(ns)


def weights_from_ns(ns: Column) -> Column:
    """1 / sigma**2, 0 if the number is unknown."""
    return F.when(ns > 0, 1.0 / (sigma_h_from_ns(ns) * sigma_h_from_ns(ns))).otherwise(0.0)


def smoothing_samples_from_ns(ns: Column, rate_hz: Column, clean_s: float = 1.0, noisy_s: float = 2.0, ns_clean: float = 10.0, ns_noisy: float = 3.0) -> Column:
    """Bandwidth in samples, linear between the clean and the noisy end; unknown counts as clean."""
    share = clip((ns_clean - ns) / (ns_clean - ns_noisy), 0.0, 1.0)
    return F.when(ns > 0, clean_s + (noisy_s - clean_s) * share).otherwise(clean_s) * rate_hz


def ns_bucket(ns: Column) -> Column:
    return F.when(ns < 6, "lo").when(ns < 10, "mid").otherwise("hi")


def effective_sigma(sd: Column, resid: Column, alpha: float = 0.05, floor_m: float = 0.1, inflation: float = 1.0) -> Column:
    """inflation * sqrt(sd**2 + alpha * resid**2 + floor**2); a missing residual counts as 0."""
    r = F.coalesce(resid, F.lit(0.0))
    return inflation * F.sqrt(sd * sd + alpha * r * r + floor_m * floor_m)


def sd_h(sd_n: Column, sd_e: Column) -> Column:
    return F.sqrt(sd_n * sd_n + sd_e * sd_e)


def quality_score(quality: Column, ns: Column, ratio: Column, eff_sd: Column) -> Column:
    """0.4 quality + 0.4 sigma + 0.1 satellites + 0.1 ratio, each in [0, 1]; what is missing scores 0."""
    sd = F.coalesce(clip(1.0 - eff_sd / 5.0, 0.0, 1.0), F.lit(0.0))
    return by_quality(quality, SCORE, 0.0) * 0.4 + sd * 0.4 + clip(ns / 20.0, 0.0, 1.0) * 0.1 + F.coalesce(clip(ratio / 3.0, 0.0, 1.0), F.lit(0.0)) * 0.1


def trust_labels(pos_score: Column, vel_score: Column, pos_max: float = 0.5, vel_max: float = 0.5) -> Column:
    """Lower scores are better."""
    p, v = pos_score < pos_max, vel_score < vel_max
    return F.when(p & v, "high").when(p, "pos_only").when(v, "vel_only").otherwise("low")


def trust_v1(eff_sig: Column, disagree: Column) -> Column:
    return trust_labels(eff_sig, disagree, 0.85, 4.0)


def trust_v2(disagree: Column) -> Column:
    return F.when(disagree < 0.55, "high").when(disagree < 5.0, "pos_only").otherwise("low")


def velocity_disagreement(ce: Column, cn: Column, cu: Column, ve: Column, vn: Column, vu: Column) -> Column:
    """Length of the difference; vertical counts if both are known; null if the horizontal isn't."""
    up = F.when(cu.isNotNull() & vu.isNotNull(), (cu - vu) * (cu - vu)).otherwise(0.0)
    return F.sqrt((ce - ve) * (ce - ve) + (cn - vn) * (cn - vn) + up)


#: What a solution's quality costs as a signal.
Q_PENALTY = {1: 0.0, 2: 0.3, 4: 0.8, 5: 1.0}


def trust_signals(eff_sig: Column, disagree: Column, innovation: Column, two_way: Column, innovation_norm: Column, max_speed: float = 40.0) -> dict[str, Column]:
    """Ten signs of a bad epoch, higher is worse; of quality, ns, sd_n, sd_e, vn, ve, ratio and of what a smoother says.

    Missing sigmas, speeds and smoother values count as 0 (the effective sigma
    as 4, within 0.1 to 8), a missing ratio as 0.1.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    speed = F.sqrt(zero(F.col("vn")) ** 2 + zero(F.col("ve")) ** 2)
    return {
        "eff_sig": clip(F.coalesce(eff_sig, F.lit(4.0)), 0.1, 8.0),
        "disagree": zero(disagree),
        "innovation_h": zero(innovation),
        "fwd_bwd_h": zero(two_way),
        "innovation_norm": zero(innovation_norm),
        "q_penalty": by_quality(F.col("quality"), Q_PENALTY, 1.0),
        "ns_penalty": F.greatest(F.lit(0.0), 1.0 - F.col("ns") / 20.0),
        "sd_h": sd_h(zero(F.col("sd_n")), zero(F.col("sd_e"))),
        "slowness": 1.0 - F.least(speed / max_speed, F.lit(1.0)),
        "ratio_inv": 1.0 / F.greatest(F.coalesce(F.col("ratio"), F.lit(0.1)), F.lit(0.1)),
    }


def normalized(signals: dict[str, Column], bounds: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Each signal between its bounds as 0 to 1 (unknown bounds are 0 to 1; empty ones give 0)."""
    out = {}
    for name, signal in signals.items():
        lo, hi = bounds.get(name, (0.0, 1.0))
        out[name] = clip((signal - lo) / (hi - lo), 0.0, 1.0) if hi > lo else F.lit(0.0)
    return out


def composite(normed: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of signals from 0 to 1; 0 without weights."""
    used = {n: w for n, w in weights.items() if n in normed and w > 0}
    if not used:
        return F.lit(0.0)
    total = F.lit(0.0)
    for name, weight in used.items():
        total = total + normed[name] * weight
    return clip(total / sum(used.values()), 0.0, 1.0)


def noise_scale(quality: Column, fixed: float = 0.5, differential: float = 2.0, single: float = 3.0) -> Column:
    """What a solution's quality multiplies a variance by; null for what isn't a quality."""
    return F.when(quality == 1, fixed**2).when(quality == 2, 1.0).when(quality == 4, differential**2).when(quality.isin(0, 3, 5, 6, 7, 8), single**2)


def bounded_sigma(sigma: Column, floor: float, ceiling: float) -> Column:
    """sigma within bounds; a missing one is the least."""
    return clip(F.coalesce(sigma, F.lit(floor)), floor, ceiling)


def run_status(code: Column, size: Column, said: Column) -> Column:
    """Why a solver's run gave nothing (size null: no file), or null."""
    short = F.substring(F.coalesce(said, F.lit("")), 1, 200)
    return F.when(code != 0, F.format_string("failed rc=%d: %s", code, short)).when(F.coalesce(size, F.lit(0)) == 0, F.format_string("no output rc=%d: %s", code, short))


def mask_text(threshold: Column, bins: int = 9) -> Column:
    """A threshold for each elevation bin, as a solver's option reads it."""
    one = F.when(threshold == F.floor(threshold), threshold.cast("long").cast("string")).otherwise(threshold.cast("string"))
    return F.array_join(F.array_repeat(one, bins), ",")
