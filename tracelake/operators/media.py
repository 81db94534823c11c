"""Clocks of sound and camera: spectra, sync, pose alignment, visual velocity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import kernels


def spectrogram(blocks: DataFrame, window: int = 1024, hop: int = 512, bins: int = 64) -> DataFrame:
    """file, start, power_db array<double>: Hann spectra of blocks of samples (file, start, samples), pooled by maximum to so many bins.

    Spectra start at multiples of hop from the file's first sample, whatever the
    blocks: those that reach beyond a block take samples from the next, so each
    block but a file's last must have window - 1 samples or more.
    """
    hann = np.hanning(window)

    def run(batches):
        for batch in batches:
            out = []
            for file, start, size, samples in zip(batch["file"], batch["start"], batch["size"], batch["samples"], strict=True):
                x = np.asarray(samples)
                for k in range(-int(start) % hop, min(int(size), len(x) - window + 1), hop):
                    power = np.abs(np.fft.rfft(x[k : k + window] * hann))[:-1] ** 2
                    pooled = power.reshape(bins, -1).max(1)
                    out.append((file, int(start) + k, (10 * np.log10(pooled + 1e-12)).tolist()))
            yield pd.DataFrame(out, columns=["file", "start", "power_db"])

    after = F.lead("samples").over(Window.partitionBy("file").orderBy("start"))
    rows = blocks.withColumn("after", after).withColumn("size", F.size("samples"))
    rows = rows.select("file", "start", "size", F.concat("samples", F.coalesce(F.slice("after", 1, window - 1), F.array().cast("array<double>"))).alias("samples"))
    return rows.mapInPandas(run, f"file {dict(blocks.dtypes)['file']}, start long, power_db array<double>")


def discontinuities(pairs: DataFrame, fit: DataFrame, bar_ms: float = 50.0, by: str = "session_id") -> DataFrame:
    """Anchors (x, y in ns) whose residual jumps by more than the bar from the anchor before; fit has slope and intercept."""
    w = Window.partitionBy(by).orderBy("x")
    rows = pairs.join(fit, by).withColumn("residual_ms", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")) / 1e6)
    jump = F.col("residual_ms") - F.lag("residual_ms").over(w)
    return rows.withColumn("jump_ms", jump).where(F.abs("jump_ms") > bar_ms).select(by, "x", "residual_ms", "jump_ms")


def similarity_robust(src: np.ndarray, dst: np.ndarray, rounds: int = 3, times: float = 4.0, floor: float = 0.02) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Similarity with up to so many rounds that leave out residuals above max(times * median, floor); also the kept rows."""
    keep = np.ones(len(src), bool)
    for _ in range(rounds + 1):
        s, r, shift = kernels.similarity(src[keep], dst[keep])
        far = np.linalg.norm(s * src @ r.T + shift - dst, axis=1)
        new = far <= max(times * float(np.median(far[keep])), floor)
        if new.sum() < 3 or (new == keep).all():
            break
        keep = new
    return s, r, shift, keep


def reconstruction_frame(centers: np.ndarray, gps_enu: np.ndarray, as_llh_enu: np.ndarray, llh_m: float = 50.0, share: float = 0.2, local_m: float = 25.0) -> str:
    """llh if the centers, read as coordinates, lie near the track; local if they lie near its metres; else raw."""
    if len(centers) == 0:
        return "raw"
    if np.median(np.linalg.norm(as_llh_enu - gps_enu, axis=1)) <= llh_m:
        return "llh"
    extent = float(np.linalg.norm(np.ptp(gps_enu, axis=0)))
    return "local" if np.median(np.linalg.norm(centers - gps_enu, axis=1)) <= max(share * extent, local_m) else "raw"


def both_sided_steps(steps: DataFrame, least: float = 3.0, k: float = 5.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """Rejects epochs whose measured step differs from the visual one (step_e, step_n against vis_e, vis_n) on both sides.

    The bar is max(least, median + k * MAD, unscaled); first and last rows stay.
    """
    w = Window.partitionBy(by).orderBy(t)
    rows = steps.withColumn("mismatch", F.sqrt((F.col("step_e") - F.col("vis_e")) ** 2 + (F.col("step_n") - F.col("vis_n")) ** 2))
    rows = rows.withColumn("__m", F.median("mismatch").over(Window.partitionBy(by)))
    rows = rows.withColumn("__d", F.median(F.abs(F.col("mismatch") - F.col("__m"))).over(Window.partitionBy(by)))
    bar = F.greatest(F.lit(least), F.col("__m") + k * F.col("__d"))
    both = (F.col("mismatch") > bar) & (F.lead("mismatch").over(w) > bar)
    return rows.withColumn("rejected", F.coalesce(both, F.lit(False))).drop("__m", "__d")


def pick_anchors(t: np.ndarray, a: np.ndarray, b: np.ndarray, steps: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Of two candidates for each epoch, the nearer to what the visual steps predict from the last chosen one; returns their weighted place."""
    out = np.zeros_like(a)
    last = a[0]
    for k in range(len(t)):
        guess = last + (steps[k] if k else 0.0)
        known = [c for c in (a[k], b[k]) if np.isfinite(c).all()]
        if not known:
            last = guess
        else:
            w = np.array([np.exp(-0.5 * (np.linalg.norm(c - guess) / sigma) ** 2) for c in known])
            last = known[int(w.argmax())] if w.sum() < 1e-12 else (w[:, None] * np.array(known)).sum(0) / w.sum()
        out[k] = last
    return out


def anderson_darling(df: DataFrame, col: str, by: str) -> DataFrame:
    """Distance of standardised values from the normal law: a sum over ranks, for each group (0 spread gives null)."""
    up = Window.partitionBy(by).orderBy(col)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One sort of the two columns serves the group's figures and the ranks.
    rows = kernels.spread(df.where(F.col(col).isNotNull()).select(by, col), by)
    rows = rows.withColumns({"__m": F.avg(col).over(whole), "__s": F.stddev_samp(col).over(whole), "__n": F.count(F.lit(1)).over(whole), "__i": F.row_number().over(up)})
    z = (F.col(col) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    # Normal distribution function by Abramowitz and Stegun's 26.2.17, to about 1e-7.
    k = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.when(z >= 0, 1 - tail).otherwise(tail)))
    rows = rows.withColumn("__p", p)
    # Equal values have equal p, so that their order among each other doesn't count.
    i, mirrored = F.col("__i"), F.col("__n") + 1 - F.col("__i")
    term = (2 * i - 1) * F.log("__p") + (2 * mirrored - 1) * F.log(1 - F.col("__p"))
    rows = rows.withColumn("__t", term)
    return rows.groupBy(by).agg((-F.first("__n") - F.sum("__t") / F.first("__n")).alias("a2"))
