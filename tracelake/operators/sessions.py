"""Session profiles: sigma inflation, predicted accuracy, trust class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.quality import BIAS_M, by_quality, quality_floor, sd_h


def sigma_inflation(enu: DataFrame, rows: int = 10, by: str = "session_id", t: str = "utc_s") -> DataFrame:
    """inflation for each session: the median over epochs of the detrended scatter in a centred window over the reported sigma, within 1 to 100."""
    order = Window.partitionBy(by).orderBy(t)
    frame = order.rowsBetween(-(rows // 2), rows // 2 - 1)
    numbered = enu.withColumn("__ix", F.row_number().over(order))
    n = F.count(F.lit(1)).over(frame)

    def scatter(c: str) -> Column:
        syy, sxy, sxx = F.regr_syy(c, "__ix").over(frame), F.regr_sxy(c, "__ix").over(frame), F.regr_sxx(c, "__ix").over(frame)
        return F.sqrt(F.greatest((syy - sxy * sxy / sxx) / n, F.lit(0.0)))

    sd = sd_h(F.col("sd_n"), F.col("sd_e"))
    e, north = scatter("e_m"), scatter("n_m")
    both = numbered.withColumns({"__s": F.sqrt(e * e + north * north), "__n": n})
    ratio = F.when((F.col("__n") >= 3) & (sd > 0), F.col("__s") / sd)
    return both.groupBy(by).agg(F.least(F.greatest(F.median(ratio), F.lit(1.0)), F.lit(100.0)).alias("inflation"))


def profile(enu: DataFrame, by: str = "session_id") -> DataFrame:
    """Predicted horizontal sigma and trust class of each session, with what they follow from."""
    sd = sd_h(F.col("sd_n"), F.col("sd_e"))
    share = lambda q: F.avg((F.col("quality") == q).cast("double"))
    p = enu.groupBy(by).agg(
        F.median(sd).alias("raw_sd"), F.percentile(sd, F.lit(0.95)).alias("sd95"), F.median(F.col("ns").cast("double")).alias("ns_med"), F.coalesce(F.median("ratio"), F.lit(0.0)).alias("ratio_med"),
        *[share(q).alias(f"q{q}") for q in (1, 2, 4, 5)],
    )
    p = p.join(sigma_inflation(enu, by=by), by).withColumn("spread", F.col("sd95") / F.greatest("raw_sd", F.lit(1e-3)))
    most = F.greatest("q1", "q2", "q4", "q5")
    # Of equally common qualities the better one counts.
    common = F.when(F.col("q1") == most, 1).when(F.col("q2") == most, 2).when(F.col("q4") == most, 4).otherwise(5)
    p = p.withColumns({"spike": F.when(F.col("spread") > 5, 1.5).otherwise(0.0), "q_scale": F.when(F.col("q2") > 0.5, 1.3).otherwise(1.0), "floor_m": quality_floor(common)})
    ambiguity = 0.3 * F.col("q1") + 2.0 * F.col("q2") + 5.0 * F.col("q4") + 10.0 * F.col("q5")
    hidden = F.when((F.col("inflation") > 6) & (F.col("raw_sd") < 0.2), 4.0).otherwise(0.0)
    noise = F.col("raw_sd") * F.col("inflation")
    base = F.sqrt(noise * noise + ambiguity * ambiguity + F.col("spike") * F.col("spike") + hidden * hidden)
    trust = F.when((F.col("q1") > 0.5) | (F.col("ratio_med") > 3), "trustworthy").when((F.col("spread") > 5) & (F.col("raw_sd") < 0.5), "spike_risk").otherwise("tight")
    return p.withColumns({"smart_std_m": F.greatest("floor_m", base * F.col("q_scale")), "trust_class": trust})


def predicted_sigma(track: DataFrame, profiles: DataFrame, by: str = "session_id") -> DataFrame:
    """track with predicted_m; an unknown sigma takes the session's median."""
    keep = profiles.select(by, "inflation", "q_scale", F.col("spike").alias("__spike"), F.col("raw_sd").alias("__raw"))
    rows = track.join(keep, by)
    noise = F.coalesce(sd_h(F.col("sd_n"), F.col("sd_e")), F.col("__raw")) * F.col("inflation")
    bias = by_quality(F.col("quality"), BIAS_M, 10.0)
    base = F.sqrt(noise * noise + bias * bias + F.col("__spike") * F.col("__spike"))
    return rows.withColumn("predicted_m", F.greatest(quality_floor(F.col("quality")), base * F.col("q_scale"))).drop("inflation", "q_scale", "__spike", "__raw")
