"""Device logs: fixes, orientation, raw clock records, inertial samples, anchors, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import timefn
from tracelake.sources.text import field, lines, number


def _records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return lines(spark, path).where(F.col("value").startswith(f"{kind},")).withColumn("p", F.split("value", ","))


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """'Fix,' records of 13 fields or more: provider, place, speed, accuracy and bearing; blanks are null, rows without time or place are left out."""
    p = F.col("p")
    rows = _records(spark, path, "Fix").where(F.size(p) >= 13).select(
        F.col("file").alias("session_id"), (number(field(p, 9)) / 1000.0).alias("utc_s"), F.lower(F.trim(field(p, 2))).alias("provider"), number(field(p, 3)).alias("lat_deg"), number(field(p, 4)).alias("lon_deg"),
        number(field(p, 5)).alias("h_m"), number(field(p, 6)).alias("speed_mps"), number(field(p, 7)).alias("h_acc_m"), number(field(p, 8)).alias("bearing_deg"), number(field(p, 13)).alias("v_acc_m"),
    )
    return rows.where("utc_s IS NOT NULL AND lat_deg IS NOT NULL AND lon_deg IS NOT NULL")


def read_orientation(spark: SparkSession, path: str) -> DataFrame:
    """'OrientationDeg,' records: yaw in [0, 360), roll, pitch and calibration."""
    p = F.col("p")
    rows = _records(spark, path, "OrientationDeg").select(F.col("file").alias("session_id"), (number(field(p, 2)) / 1000.0).alias("utc_s"), F.pmod(number(field(p, 4)), F.lit(360.0)).alias("yaw_deg"), number(field(p, 5)).alias("roll_deg"), number(field(p, 6)).alias("pitch_deg"), number(field(p, 7)).cast("int").alias("cal"))
    return rows.where("utc_s IS NOT NULL AND yaw_deg IS NOT NULL AND roll_deg IS NOT NULL AND pitch_deg IS NOT NULL")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """'Raw,' records with the columns that the '# Raw,' line of their file names."""
    head = lines(spark, path).where(F.regexp_like("value", F.lit(r"^#\s*Raw,"))).groupBy("file").agg(F.min_by("value", "line_no").alias("head"))
    names = F.transform(F.split(F.regexp_replace("head", r"^#\s*", ""), ","), lambda x: F.trim(x))
    rows = _records(spark, path, "Raw").join(head.withColumn("names", names), "file")
    at = lambda n: F.try_element_at(F.col("p"), F.nullif(F.array_position("names", F.lit(n)), F.lit(0)).cast("int"))
    ns = T.DecimalType(38, 9)
    return rows.select("file", "line_no", *[at(n).try_cast(ns).alias(n) for n in ("TimeNanos", "FullBiasNanos", "BiasNanos", "HardwareClockDiscontinuityCount", "ChipsetElapsedRealtimeNanos")])


def read_clock_pairs(spark: SparkSession, path: str) -> DataFrame:
    """x_ns (boot clock) and y_s (UTC) of raw records; nanoseconds stay decimal until the last division. Rows without a boot time are left out."""
    gps_ns = F.col("TimeNanos") - F.col("FullBiasNanos") - F.coalesce("BiasNanos", F.lit(0))
    gpst = timefn.GPS_EPOCH + (gps_ns / 1000000000).cast("double")
    rows = _raw(spark, path).where("ChipsetElapsedRealtimeNanos > 0 AND FullBiasNanos IS NOT NULL")
    return rows.select(F.col("file").alias("session_id"), F.col("ChipsetElapsedRealtimeNanos").cast("long").alias("x_ns"), timefn.gpst_to_utc(gpst).alias("y_s"))


def read_clock_bias(spark: SparkSession, path: str) -> DataFrame:
    """The first raw record of each receiver time: bias in ms and the discontinuity counter."""
    w = Window.partitionBy("file", "TimeNanos").orderBy("line_no")
    rows = _raw(spark, path).where("TimeNanos IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    bias = (F.col("FullBiasNanos") + F.coalesce("BiasNanos", F.lit(0))) / 1000000
    return rows.select(F.col("file").alias("session_id"), F.col("TimeNanos").cast("long").alias("time_ns"), bias.cast("double").alias("bias_ms"), F.col("HardwareClockDiscontinuityCount").cast("long").alias("counter"))


def read_fix_pairs(spark: SparkSession, path: str) -> DataFrame:
    """x_ns and y_s of 'Fix,' records with both; if a session has two or more of provider gps, only those."""
    p = F.col("p")
    rows = _records(spark, path, "Fix").where(F.size(p) >= 12).select(F.col("file").alias("session_id"), F.lower(F.trim(field(p, 2))).alias("provider"), field(p, 12).try_cast("long").alias("x_ns"), (number(field(p, 9)) / 1000.0).alias("y_s"))
    rows = rows.where("x_ns > 0 AND y_s > 0").withColumn("gps", F.count_if(F.col("provider") == "gps").over(Window.partitionBy("session_id")))
    return rows.where("gps < 2 OR provider = 'gps'").select("session_id", "x_ns", "y_s")


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """Inertial samples: seven columns (time, rates, forces) or ten and more (forces in columns 8 to 10); GPS seconds to UTC."""
    raw = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("p", F.split("value", ","))
    p, wide = F.col("p"), F.size("p") >= 10
    force = [F.when(wide, number(field(p, 8 + k))).otherwise(number(field(p, 5 + k))).alias(n) for k, n in enumerate(("ax", "ay", "az"))]
    rows = raw.where(F.size("p") >= 7).select(F.col("file").alias("session_id"), timefn.gpst_to_utc(number(field(p, 1))).alias("utc_s"), *force, *[number(field(p, 2 + k)).alias(n) for k, n in enumerate(("gx", "gy", "gz"))])
    return rows.dropna()


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """'x_ns,time[,...]' lines, the time as seconds or ISO text; headers, comments and blanks are skipped."""
    p = F.split("value", ",")
    rows = lines(spark, path).where(~F.col("value").startswith("#")).select(F.col("file").alias("session_id"), F.trim(field(p, 1)).try_cast("long").alias("x_ns"), timefn.time_value(F.trim(field(p, 2))).alias("y_s"))
    return rows.where("x_ns IS NOT NULL AND y_s IS NOT NULL")


def read_frame_anchors(spark: SparkSession, path: str) -> DataFrame:
    """frame and boot_ns: the third column where there is one, else the second."""
    p = F.split("value", ",")
    rows = lines(spark, path).select(F.col("file").alias("session_id"), F.trim(field(p, 1)).try_cast("long").alias("frame"), F.trim(F.when(F.size(p) >= 3, field(p, 3)).otherwise(field(p, 2))).try_cast("long").alias("boot_ns"))
    return rows.where("frame IS NOT NULL AND boot_ns IS NOT NULL")


MANIFEST = "anchor_format string, video_t0_boottime_ns long, audio_t0_boottime_ns long, device string, names array<string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Session manifests; what doesn't fit its type is null."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("session_id", F.col("_metadata.file_path"))


CALIBRATION = "device_label string, date string, sample_rate_hz double, axes map<string, struct<random_walk: double, bias_instability: double, rate_random_walk: double>>"


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION).option("multiLine", True).json(path)


def find_calibration(calibrations: DataFrame, label: str) -> DataFrame:
    """The latest calibration of a device, whatever the label's case; unreadable ones have no label and drop out."""
    return calibrations.where(F.lower(F.trim("device_label")) == label.strip().lower()).orderBy(F.desc("date")).limit(1)


PROBE = (
    "streams array<struct<codec_type: string, width: string, height: string, avg_frame_rate: string, r_frame_rate: string, duration: string, tags: map<string, string>>>, "
    "format struct<duration: string, size: string, tags: map<string, string>>"
)
#: Tags that may hold a focal length, in the order in which they are tried. Fixed values.
FOCAL_TAGS = ("focal_length", "focallength", "focal_length_35mm", "focal_length_in_35mm_format", "focallengthin35mmfilm", "com.apple.quicktime.camera.focal_length_35mm_equivalent", "lens", "lensmodel")


def _focal(tags: Column) -> Column:
    """The first positive number among the tags, whatever their case."""
    lower = F.transform_keys(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    values = [number(F.try_element_at(lower, F.lit(k))) for k in FOCAL_TAGS]
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """file, width, height, fps, duration_s, size_bytes, focal_length of video probes in JSON; what is missing or no number is null.

    Size and rate are the first video stream's, the duration the container's,
    else the stream's; the focal length comes from the stream's tags, else the
    container's.
    """
    rows = spark.read.schema(PROBE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.withColumn("v", F.get(F.filter("streams", lambda s: s["codec_type"] == "video"), 0))
    fps = F.coalesce(timefn.fraction(F.col("v.avg_frame_rate")), timefn.fraction(F.col("v.r_frame_rate")))
    return rows.select(
        "file",
        number(F.col("v.width")).cast("int").alias("width"),
        number(F.col("v.height")).cast("int").alias("height"),
        fps.alias("fps"),
        F.coalesce(number(F.col("format.duration")), number(F.col("v.duration"))).alias("duration_s"),
        number(F.col("format.size")).cast("long").alias("size_bytes"),
        F.coalesce(_focal(F.col("v.tags")), _focal(F.col("format.tags"))).alias("focal_length"),
    )
