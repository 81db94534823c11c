"""Gaussian smoothing of ordered rows, as window aggregates over short frames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.motion import over_range
from tracelake.operators.stats import upper_median


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights, truncate sigmas to either side."""
    half = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_rows(df: DataFrame, cols: list[str], sigma: float, by: str = "session_id", t: str = "utc_s", weight: Column | None = None, truncate: float = 4.0, suffix: str = "_s") -> DataFrame:
    """df with each col smoothed over rows.

    Ends repeat the edge value. Nulls have no weight and stay null. With a
    weight, rows count by kernel times weight.
    """
    kernel = gaussian_kernel(sigma, truncate)
    half = len(kernel) // 2
    w = Window.partitionBy(by).orderBy(t)
    frame = w.rowsBetween(-half, half)
    whole = Window.partitionBy(by)
    rows = df.withColumns({"__ix": F.row_number().over(w), "__n": F.count(F.lit(1)).over(whole), "__w": (F.lit(1.0) if weight is None else weight)})
    edge = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.array(*[F.lit(float(k)) for k in kernel])
    out = {}
    for c in cols:
        near = F.collect_list(F.struct((F.col("__ix")).alias("i"), F.col(c).alias("x"), F.col("__w").alias("w"))).over(frame)
        first, last = F.first(F.struct(c, "__w")).over(edge), F.last(F.struct(c, "__w")).over(edge)
        rows = rows.withColumns({f"__near_{c}": near, f"__first_{c}": first, f"__last_{c}": last})
        # Kernel mass that falls before the first or after the last row goes to the edge value.
        mass = lambda k: F.coalesce(F.aggregate(k, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        lead = F.greatest(F.lit(0), half + 1 - F.col("__ix"))
        tail = F.greatest(F.lit(0), half - (F.col("__n") - F.col("__ix")))
        before = mass(F.slice(at, F.lit(1), lead.cast("int"))) if half else F.lit(0.0)
        after = mass(F.slice(at, (len(kernel) + 1 - tail).cast("int"), tail.cast("int"))) if half else F.lit(0.0)
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

        def add(acc: Column, s: Column) -> Column:
            k = F.element_at(at, (s["i"] - F.col("__ix") + half + 1).cast("int")) * s["w"]
            return F.struct((acc["a"] + F.coalesce(k * s["x"], F.lit(0.0))).alias("a"), (acc["b"] + F.when(s["x"].isNotNull(), k).otherwise(0.0)).alias("b"))

        inner = F.aggregate(F.col(f"__near_{c}"), zero, add)

        def end(e: Column, m: Column, c: str = c) -> tuple[Column, Column]:
            ok = e[c].isNotNull() & (m > 0)
            return F.when(ok, m * e["__w"] * e[c]).otherwise(0.0), F.when(ok, m * e["__w"]).otherwise(0.0)

        (fa, fb), (la, lb) = end(F.col(f"__first_{c}"), before), end(F.col(f"__last_{c}"), after)
        rows = rows.withColumn("__in", inner)
        total, share = F.col("__in.a") + fa + la, F.col("__in.b") + fb + lb
        rows = rows.withColumn(f"{c}{suffix}", F.when(F.col(c).isNotNull() & (share > 0), total / share)).drop("__in", f"__near_{c}", f"__first_{c}", f"__last_{c}")
    del out
    return rows.drop("__ix", "__n", "__w")


def gaussian_all(cuts: np.ndarray, x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """gaussian_rows() without weights, of the columns of x and many sessions (session s at rows cuts[s] to cuts[s + 1])."""
    kernel = np.array(gaussian_kernel(sigma, truncate))
    half, sizes = len(kernel) // 2, np.diff(cuts)
    # Every session with its ends repeated, so that none reaches into the next one.
    wide = np.concatenate([[0], np.cumsum(sizes + 2 * half)])
    rows = np.arange(wide[-1]) - np.repeat(wide[:-1] - cuts[:-1] + half, sizes + 2 * half)
    rows = np.clip(rows, np.repeat(cuts[:-1], sizes + 2 * half), np.repeat(cuts[1:] - 1, sizes + 2 * half))
    middle = np.arange(cuts[-1]) + np.repeat(wide[:-1] - cuts[:-1], sizes)
    known = ~np.isnan(x)
    out = np.empty(x.shape)
    for c in range(x.shape[1]):
        total, share = (np.convolve(v[rows, c], kernel, "valid")[middle] for v in (np.where(known, x, 0.0), known.astype(float)))
        out[:, c] = np.where(known[:, c] & (share > 0), total / np.where(share > 0, share, 1.0), np.nan)
    return out


def gaussian_circular(df: DataFrame, col: str, sigma: float, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """An angle in degrees smoothed by its sine and cosine, to [0, 360)."""
    rows = df.withColumns({"__sin": F.sin(F.radians(col)), "__cos": F.cos(F.radians(col))})
    rows = gaussian_rows(rows, ["__sin", "__cos"], sigma, by, t)
    return rows.withColumn(f"{col}_s", F.pmod(F.degrees(F.atan2("__sin_s", "__cos_s")), F.lit(360.0))).drop("__sin", "__cos", "__sin_s", "__cos_s")


def gaussian_time(df: DataFrame, col: str, sigma_s: float, by: list[str], t: str = "utc_s", reach: float = 4.0, name: str | None = None) -> DataFrame:
    """col weighted by exp(-dt**2 / 2 sigma**2) over +-reach sigmas of time within each group of by."""
    rows = df.withColumn("__near", over_range(f"collect_list(struct({t} AS t, {col} AS x))", reach * sigma_s, by=", ".join(by), t=t))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def add(acc: Column, s: Column) -> Column:
        w = F.when(s["x"].isNotNull(), F.exp(-0.5 * ((s["t"] - F.col(t)) / sigma_s) ** 2)).otherwise(0.0)
        return F.struct((acc["a"] + F.coalesce(w * s["x"], F.lit(0.0))).alias("a"), (acc["b"] + w).alias("b"))

    rows = rows.withColumn("__in", F.aggregate("__near", zero, add))
    return rows.withColumn(name or f"{col}_s", F.when(F.col("__in.b") > 0, F.col("__in.a") / F.col("__in.b"))).drop("__near", "__in")


def smooth_heights(track: DataFrame, sigma_s: float = 2.0, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """h_m smoothed in time, split at gaps longer than max(5 median steps, 2 sigma); segments below 3 rows stay."""
    w = Window.partitionBy(by).orderBy(t)
    rows = track.withColumn("__dt", F.col(t) - F.lag(t).over(w)).withColumn("__step", F.when(F.col("__dt") > 0, F.col("__dt")))
    # One row for each session with its usual step, joined back to the rows.
    usual = rows.groupBy(by).agg(upper_median("__step").alias("__upper"))
    rows = rows.join(usual, by).withColumn("__gap", F.greatest(5.0 * F.col("__upper"), F.lit(2.0 * sigma_s))).drop("__upper", "__step")
    rows = rows.withColumn("__seg", F.sum(F.coalesce((F.col("__dt") > F.col("__gap")).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = gaussian_time(rows, "h_m", sigma_s, [by, "__seg"], t, name="__h")
    n = F.count(F.lit(1)).over(Window.partitionBy(by, "__seg"))
    return rows.withColumn("h_smooth_m", F.when(n < 3, F.col("h_m")).otherwise(F.col("__h"))).drop("__dt", "__gap", "__seg", "__h")


def moving_average(col: str, k: int, by: str = "session_id", t: str = "utc_s") -> Column:
    """Centred mean of k rows (fewer at the ends)."""
    return F.avg(col).over(Window.partitionBy(by).orderBy(t).rowsBetween(-(k // 2), k // 2))


def gaussian_adaptive(df: DataFrame, col: str, sigma: Column, widest: float, by: str = "session_id", t: str = "utc_s", truncate: float = 3.0) -> DataFrame:
    """col smoothed over rows with each row's own sigma (in rows, at most widest), truncated at truncate sigmas, ends not padded; nulls have no weight."""
    half = math.ceil(truncate * widest)
    w = Window.partitionBy(by).orderBy(t)
    rows = df.withColumns({"__ix": F.row_number().over(w), "__sg": F.least(sigma, F.lit(widest))})
    rows = rows.withColumn("__near", F.collect_list(F.struct(F.col("__ix").alias("i"), F.col(col).alias("x"))).over(w.rowsBetween(-half, half)))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def add(acc: Column, s: Column) -> Column:
        d = s["i"] - F.col("__ix")
        k = F.when(s["x"].isNotNull() & (F.abs(d) <= F.ceil(truncate * F.col("__sg"))), F.exp(-0.5 * (d / F.col("__sg")) ** 2)).otherwise(0.0)
        return F.struct((acc["a"] + F.coalesce(k * s["x"], F.lit(0.0))).alias("a"), (acc["b"] + k).alias("b"))

    rows = rows.withColumn("__in", F.aggregate("__near", zero, add))
    return rows.withColumn(f"{col}_s", F.when(F.col("__in.b") > 0, F.col("__in.a") / F.col("__in.b"))).drop("__ix", "__sg", "__near", "__in")
