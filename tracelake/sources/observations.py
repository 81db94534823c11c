"""Fixed-width observation files of version 3: headers with continuation lines, epochs, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources.text import field, lines, number

WIDTH = 16  # of an observation: 14 of value, 2 of flags


def signal_codes(spark: SparkSession, path: str) -> DataFrame:
    """file, system, codes (in order) from the header's type lines; continuation lines belong to the system before."""
    head = lines(spark, path).where(F.contains("value", F.lit("SYS / # / OBS TYPES")))
    w = Window.partitionBy("file").orderBy("line_no")
    rows = head.select("file", "line_no", F.nullif(F.trim(F.substring("value", 1, 1)), F.lit("")).alias("s"), F.array_remove(F.split(F.trim(F.substring("value", 7, 54)), r"\s+"), "").alias("codes"))
    rows = rows.withColumn("system", F.last("s", ignorenulls=True).over(w))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "codes"))), lambda x: x["codes"])
    return rows.groupBy("file", "system").agg(F.flatten(lists).alias("codes"))


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """All lines after the header with the number, time and flag of their epoch; a file's lines are folded in its own window."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines(spark, path).withColumn("is_epoch", F.col("value").startswith(">"))
    rows = rows.withColumn("epoch", F.sum(F.col("is_epoch").cast("int")).over(w)).where("epoch > 0")
    p = F.split(F.trim(F.substring("value", 2, 60)), r"\s+")
    whole = F.unix_seconds(F.try_to_timestamp(F.format_string("%s-%s-%s %s:%s:%s", field(p, 1), *[F.lpad(field(p, k), 2, "0") for k in (2, 3, 4, 5)], F.lpad(F.substring_index(field(p, 6), ".", 1), 2, "0"))))
    time = whole + (number(field(p, 6)) - F.floor(number(field(p, 6))))
    head = F.when(F.col("is_epoch"), F.struct(time.alias("t"), field(p, 7).try_cast("int").alias("flag")))
    rows = rows.withColumn("h", F.last(head, ignorenulls=True).over(w))
    return rows.select("file", "epoch", "is_epoch", "line_no", "value", F.col("h.t").alias("t"), F.col("h.flag").alias("flag"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """file, epoch, t, sat, code, value (null for blanks); event blocks (flag above 1) are left out."""
    rows = epochs(spark, path).where("NOT is_epoch AND coalesce(flag, 0) <= 1").withColumn("system", F.substring("value", 1, 1))
    wide = rows.join(signal_codes(spark, path), ["file", "system"]).select("file", "epoch", "t", F.trim(F.substring("value", 1, 3)).alias("sat"), "value", F.posexplode("codes").alias("slot", "code"))
    at = F.col("slot") * WIDTH + 4
    return wide.select("file", "epoch", "t", "sat", "code", number(F.substr("value", at, F.lit(14))).alias("value"))


def phase_check(spark: SparkSession, path: str, least: float = 0.01) -> DataFrame:
    """file, slots, nonzero, has_phase: whether the share of phase slots that hold a value reaches least."""
    rows = observations(spark, path).where(F.col("code").startswith("L"))
    out = rows.groupBy("file").agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("value") != 0).alias("nonzero"))
    return out.withColumn("has_phase", F.col("nonzero") >= least * F.col("slots"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """file, epochs, mean satellites, mean SNR and median interval."""
    rows = observations(spark, path)
    per = rows.groupBy("file", "epoch").agg(F.first("t").alias("t"), F.count_distinct("sat").alias("sats"), F.avg(F.when(F.col("code").startswith("S") & (F.col("value") > 0), F.col("value"))).alias("snr"))
    per = per.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy("file").orderBy("epoch")))
    return per.groupBy("file").agg(F.count(F.lit(1)).alias("epochs"), F.avg("sats").alias("mean_sats"), F.avg("snr").alias("mean_snr"), F.median("dt").alias("interval_s"))


def snr_by_system(spark: SparkSession, path: str) -> DataFrame:
    rows = observations(spark, path).where(F.col("code").startswith("S") & (F.col("value") > 0))
    return rows.groupBy("file", F.substring("sat", 1, 1).alias("system")).agg(F.avg("value").alias("snr"), F.count(F.lit(1)).alias("n"))


def approximate_position(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z of the header; null if it is the origin."""
    p = F.split(F.trim(F.substring("value", 1, 60)), r"\s+")
    rows = lines(spark, path).where(F.contains("value", F.lit("APPROX POSITION XYZ"))).select("file", *[number(field(p, k)).alias(n) for k, n in enumerate("xyz", 1)])
    some = (F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)
    return rows.select("file", *[F.when(some, F.col(n)).alias(n) for n in "xyz"])
