"""Per-satellite residual rows: epoch statistics, dilution of precision, sky view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def residual_rms(stat: DataFrame, valid_only: bool = True, by: str = "session_id") -> DataFrame:
    """RMS residual, count and mean SNR of each epoch (time to the millisecond), zero residuals left out."""
    rows = stat.where("res_p <> 0")
    rows = rows.where("valid = 1") if valid_only else rows
    return rows.groupBy(by, F.round("utc_s", 3).alias("t")).agg(F.sqrt(F.avg(F.col("res_p") ** 2)).alias("rms"), F.count(F.lit(1)).alias("n"), F.avg("snr").alias("snr"))


def _inverse_diagonal(m: dict[tuple[int, int], Column], size: int = 4) -> tuple[list[Column], Column]:
    """Diagonal cofactors and determinant of a symmetric matrix of Columns."""

    def det(rows: tuple[int, ...], cols: tuple[int, ...]) -> Column:
        if len(rows) == 1:
            return m[tuple(sorted((rows[0], cols[0])))]
        total = None
        for k, c in enumerate(cols):
            term = m[tuple(sorted((rows[0], c)))] * det(rows[1:], cols[:k] + cols[k + 1 :])
            term = -term if k % 2 else term
            total = term if total is None else total + term
        return total

    every = tuple(range(size))
    return [det(every[:i] + every[i + 1 :], every[:i] + every[i + 1 :]) for i in every], det(every, every)


def dops(stat: DataFrame, by: str = "session_id") -> DataFrame:
    """G, P, H, V and T dilution of precision of each epoch: ten sums and a closed-form inverse; null below four satellites or for a singular geometry."""
    el, az = F.radians("el"), F.radians("az")
    h = [F.cos(el) * F.sin(az), F.cos(el) * F.cos(az), F.sin(el), F.lit(1.0)]
    rows = stat.select(by, F.round("utc_s", 3).alias("t"), *[c.alias(f"h{i}") for i, c in enumerate(h)])
    sums = rows.groupBy(by, "t").agg(F.count(F.lit(1)).alias("sats"), *[F.sum(F.col(f"h{i}") * F.col(f"h{j}")).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)])
    cofactors, det = _inverse_diagonal({(i, j): F.col(f"m{i}{j}") for i in range(4) for j in range(i, 4)})
    v = sums.withColumn("__det", det)
    ok = (F.col("sats") >= 4) & (F.abs("__det") > 1e-9)
    v = v.withColumns({f"__q{i}": F.when(ok, c / F.col("__det")) for i, c in enumerate(cofactors)})
    root = lambda *i: F.sqrt(sum((F.col(f"__q{k}") for k in i[1:]), F.col(f"__q{i[0]}")))
    return v.select(by, "t", "sats", root(0, 1, 2, 3).alias("gdop"), root(0, 1, 2).alias("pdop"), root(0, 1).alias("hdop"), root(2).alias("vdop"), root(3).alias("tdop"))


def sky_grid(stat: DataFrame, az_deg: float = 5.0, el_deg: float = 5.0, by: str = "session_id") -> DataFrame:
    """Observations, solved ones, mean SNR and large residuals by cell of the sky."""
    return stat.groupBy(by, F.floor(F.col("az") / az_deg).alias("az_bin"), F.floor(F.col("el") / el_deg).alias("el_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("long")).alias("solved"), F.avg("snr").alias("snr"), F.count_if(F.abs("res_p") > 1.5).alias("multipath")
    )


def skyline(stat: DataFrame, az_deg: float = 5.0, by: str = "session_id") -> DataFrame:
    """Lowest solved elevation by azimuth bin, and its mean with both neighbours around the circle."""
    bins = int(360 / az_deg)
    low = stat.where("valid = 1").groupBy(by, F.floor(F.col("az") / az_deg).alias("az_bin")).agg(F.min("el").alias("lowest"))
    every = low.select(by).distinct().withColumn("az_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    grid = every.join(low, [by, "az_bin"], "left")
    w = Window.partitionBy(by)
    ends = grid.withColumns({"__first": F.max(F.when(F.col("az_bin") == 0, F.col("lowest"))).over(w), "__last": F.max(F.when(F.col("az_bin") == bins - 1, F.col("lowest"))).over(w)})
    o = w.orderBy("az_bin")
    prev = F.when(F.col("az_bin") == 0, F.col("__last")).otherwise(F.lag("lowest").over(o))
    nxt = F.when(F.col("az_bin") == bins - 1, F.col("__first")).otherwise(F.lead("lowest").over(o))
    near = F.array_compact(F.array(prev, F.col("lowest"), nxt))
    mean = F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near))
    return ends.select(by, "az_bin", "lowest", mean.alias("skyline"))


def multipath(stat: DataFrame, by: str = "session_id") -> DataFrame:
    """Median and 95th percentile of the absolute residual, and the mean over epochs of their mean SNR."""
    snr = stat.groupBy(by, "utc_s").agg(F.avg("snr").alias("snr")).groupBy(by).agg(F.avg("snr").alias("snr"))
    res = stat.where("valid = 1").groupBy(by).agg(F.median(F.abs("res_p")).alias("median_abs"), F.percentile(F.abs("res_p"), F.lit(0.95)).alias("p95_abs"))
    return res.join(snr, by)
