"""Solver output: position files and per-satellite residual files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import geo, timefn
from tracelake.sources.text import bad_records, field, lines, number, numbers

# Header labels by coordinate kind, and the columns of a record.
LABELS = {"llh": "latitude(deg)", "ecef": "x-ecef(m)", "enu": "e-baseline(m)"}
FIELDS = "sd_n sd_e sd_u sd_ne sd_eu sd_un age_s ratio vn ve vu sd_vn sd_ve sd_vu sd_vne sd_veu sd_vun"


def pos_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, format (llh, ecef, enu, unknown), time_system (GPST unless the label line says UTC) and explicit."""
    head = lines(spark, path).where(F.col("value").startswith("%"))
    kind = F.lit(None).cast("string")
    for name, label in LABELS.items():
        kind = F.when(F.contains("value", F.lit(label)), name).otherwise(kind)
    named = head.withColumn("kind", kind).withColumn("token", F.when(F.col("kind").isNotNull(), F.regexp_extract("value", r"^%\s*(\S+)", 1)))
    first = named.groupBy("file").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("line_no"))).alias("format"), F.min_by("token", F.when(F.col("kind").isNotNull(), F.col("line_no"))).alias("token"))
    known = F.coalesce(F.col("token").isin("UTC", "GPST"), F.lit(False))
    return first.select("file", F.coalesce("format", F.lit("unknown")).alias("format"), F.when(known, F.col("token")).otherwise("GPST").alias("time_system"), known.alias("explicit"))


def pos_config(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of the '% key : value' lines; of repeated keys the first counts."""
    pairs = lines(spark, path).where(F.col("value").startswith("%")).select("file", "line_no", F.trim(F.regexp_extract("value", r"^%\s*([^:]+?)\s*:\s*(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^%\s*([^:]+?)\s*:\s*(.*)$", 2)).alias("text"))
    return pairs.where("key <> ''").groupBy("file", "key").agg(F.min_by("text", "line_no").alias("value"))


def _clock(day: Column, time: Column) -> Column:
    """'yyyy/mm/dd' and 'hh:mm:ss.sss' to POSIX seconds with the fraction kept as a double."""
    whole = F.unix_seconds(F.try_to_timestamp(F.concat_ws(" ", day, F.substring(time, 1, 8)), F.lit("yyyy/MM/dd HH:mm:ss")))
    return whole + F.coalesce(number(F.concat(F.lit("0"), F.substring(time, 9, 12))), F.lit(0.0))


def _pos_records(spark: SparkSession, path: str) -> DataFrame:
    raw = lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    rows = raw.select("file", "line_no", _clock(field(parts, 1), field(parts, 2)).alias("t"), *[number(field(parts, k)).alias(f"c{k - 2}") for k in (3, 4, 5)], F.try_element_at(parts, F.lit(6)).try_cast("int").alias("quality"), F.coalesce(number(field(parts, 7)).cast("int"), F.lit(0)).alias("ns"), *[c.alias(n) for n, c in numbers(parts, FIELDS, 8).items()])
    return rows


def _complete() -> Column:
    return F.col("t").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull() & F.col("c3").isNotNull() & F.col("quality").isNotNull()


def read_pos(spark: SparkSession, path: str) -> DataFrame:
    """Epochs of position files: session_id (the file), utc_s, lat_deg, lon_deg, h_m, quality, ns and FIELDS.

    Earth-centred files are turned to geodetic; GPS time to UTC by the leap
    table. Records below six fields or with a broken number are left out (see
    pos_bad_records); missing trailing columns are null. Baseline files are
    refused: their rows raise when read.
    """
    rows = _pos_records(spark, path).where(_complete()).join(pos_headers(spark, path), "file", "left")
    llh = geo.ecef_to_llh_struct(F.col("c1"), F.col("c2"), F.col("c3"))
    rows = rows.withColumn("p", F.when(F.col("format") == "ecef", llh)).withColumn("format", F.when(F.col("format") == "enu", F.raise_error(F.lit("baseline coordinates have no position"))).otherwise(F.coalesce("format", F.lit("llh"))))
    utc = F.when(F.coalesce(F.col("time_system"), F.lit("GPST")) == "UTC", F.col("t")).otherwise(timefn.gpst_to_utc(F.col("t")))
    place = [F.when(F.col("format") == "ecef", F.col(f"p.{n}")).otherwise(F.col(f"c{k}")).alias(n) for k, n in enumerate(("lat_deg", "lon_deg", "h_m"), 1)]
    return rows.select(F.col("file").alias("session_id"), utc.alias("utc_s"), *place, "quality", "ns", *FIELDS.split())


def pos_bad_records(spark: SparkSession, path: str) -> DataFrame:
    return bad_records(_pos_records(spark, path), _complete())


STAT_FIELDS = "week tow prn freq az el res_p res_c valid snr fix"


def _stat_records(spark: SparkSession, path: str) -> DataFrame:
    raw = lines(spark, path).where(F.col("value").startswith("$SAT"))
    parts = F.split("value", ",")
    text = {3: "prn"}
    cols = [(field(parts, k + 2) if n == text.get(k + 1) else number(field(parts, k + 2))).alias(n) for k, n in enumerate(STAT_FIELDS.split())]
    return raw.select("file", F.size(parts).alias("n_fields"), *cols)


def _stat_complete() -> Column:
    return (F.col("n_fields") >= 12) & F.col("week").isNotNull() & F.col("tow").isNotNull() & F.col("prn").isNotNull() & F.col("az").isNotNull() & F.col("el").isNotNull()


def read_stat(spark: SparkSession, path: str) -> DataFrame:
    """Residual rows: session_id (the file), utc_s, prn, freq, az, el, res_p, res_c, snr (dB-Hz: a quarter of the field), valid, fix."""
    rows = _stat_records(spark, path).where(_stat_complete())
    return rows.select(
        F.col("file").alias("session_id"), timefn.week_tow_to_utc(F.col("week"), F.col("tow")).alias("utc_s"), "prn", F.col("freq").cast("int").alias("freq"), "az", "el", "res_p", "res_c",
        (F.col("snr") / 4.0).alias("snr"), F.col("valid").cast("int").alias("valid"), F.col("fix").cast("int").alias("fix"),
    )


def stat_bad_records(spark: SparkSession, path: str) -> DataFrame:
    return bad_records(_stat_records(spark, path), _stat_complete())


def filter_stat(stat: DataFrame, min_el: float = 0.0, valid_only: bool = False, nonzero_only: bool = False) -> DataFrame:
    rows = stat.where(F.col("el") >= min_el)
    rows = rows.where("valid = 1") if valid_only else rows
    return rows.where("res_p <> 0") if nonzero_only else rows
