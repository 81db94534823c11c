"""Per-frame tables and camera poses; headers by alias, delimiters by sight."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import geo, timefn
from tracelake.functions.angles import camera_center
from tracelake.sources.text import field, lines, number, numbers

# Names under which a column may appear, in lower case.
ALIASES = {
    "image": ("image", "label", "name", "file", "filename", "frame"),
    "lat_deg": ("latitude", "lat", "lat_deg", "y/latitude"),
    "lon_deg": ("longitude", "lon", "lon_deg", "lng", "x/longitude"),
    "h_m": ("altitude", "alt", "height", "h", "h_m", "z/altitude"),
    "x": ("x", "ecef_x", "x_ecef"),
    "y": ("y", "ecef_y", "y_ecef"),
    "z": ("z", "ecef_z", "z_ecef"),
    "east": ("easting", "east", "e"),
    "north": ("northing", "north", "n"),
    "zone": ("zone", "utm_zone"),
    "t_video_s": ("t_video_s", "time_s", "pts_s", "t"),
    "utc_s": ("utc_s", "utc", "time_utc", "gpstime"),
    "yaw_deg": ("yaw", "heading", "yaw_deg"),
    "pitch_deg": ("pitch", "pitch_deg"),
    "roll_deg": ("roll", "roll_deg"),
}


def read_table(spark: SparkSession, path: str, wanted: tuple[str, ...]) -> DataFrame:
    """file, line_no and the wanted columns of delimited text with a header line, as strings (null where a file lacks one).

    The delimiter is the one of comma, semicolon and tab that the header has most of.
    """
    raw = lines(spark, path).where((F.trim("value") != "") & ~F.regexp_like("value", F.lit(r"^\s*#\s*$")))
    raw = raw.withColumn("value", F.regexp_replace("value", r"^#\s*", ""))
    head = raw.groupBy("file").agg(F.min_by("value", "line_no").alias("head"), F.min("line_no").alias("first"))
    counts = {d: F.regexp_count("head", F.lit(d)) for d in (",", ";", "\t")}
    most = F.greatest(*counts.values())
    sep = F.when(counts[";"] == most, ";").when(counts["\t"] == most, "\t").otherwise(",")
    sep = F.when(counts[","] == most, ",").otherwise(sep)
    head = head.withColumn("sep", sep).withColumn("names", F.transform(F.split("head", F.col("sep")), lambda x: F.lower(F.trim(x))))
    rows = raw.join(head, "file").where("line_no > first").withColumn("p", F.split("value", F.col("sep")))

    def pick(name: str) -> F.Column:
        at = F.coalesce(*[F.nullif(F.array_position("names", F.lit(a)), F.lit(0)) for a in ALIASES[name]])
        return F.nullif(F.trim(F.try_element_at("p", at.cast("int"))), F.lit(""))

    return rows.select("file", "line_no", *[pick(n).alias(n) for n in wanted])


def read_frame_times(spark: SparkSession, path: str) -> DataFrame:
    """stem and t_video_s of each frame."""
    rows = read_table(spark, path, ("image", "t_video_s"))
    return rows.select(F.col("file").alias("session_id"), timefn.image_key(F.col("image")).alias("stem"), number(F.col("t_video_s")).alias("t_video_s")).where("stem IS NOT NULL AND t_video_s IS NOT NULL")


def read_georef(spark: SparkSession, path: str) -> DataFrame:
    """stem, place and attitude; of repeated stems the last row counts."""
    rows = read_table(spark, path, ("image", "lat_deg", "lon_deg", "h_m", "yaw_deg", "pitch_deg", "roll_deg")).withColumn("stem", timefn.image_key(F.col("image")))
    cols = [number(F.col(c)).alias(c) for c in ("lat_deg", "lon_deg", "h_m", "yaw_deg", "pitch_deg", "roll_deg")]
    last = Window.partitionBy("file", "stem").orderBy(F.desc("line_no"))
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1 AND stem IS NOT NULL").select(F.col("file").alias("session_id"), "stem", *cols)


def read_external_coordinates(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """stem and place from earth-centred, geodetic or projected columns, in that order of preference."""
    names = ("image", "lat_deg", "lon_deg", "h_m", "x", "y", "z", "east", "north", "zone")
    rows = read_table(spark, path, names).withColumn("stem", timefn.image_key(F.col("image")))
    v = {n: number(F.col(n)) for n in names[1:9]}
    ecef = F.when(v["x"].isNotNull() & v["y"].isNotNull() & v["z"].isNotNull() & (F.abs(v["x"]) + F.abs(v["y"]) + F.abs(v["z"]) > 1e6), geo.ecef_to_llh_struct(v["x"], v["y"], v["z"]))
    named = F.coalesce("zone", F.lit(zone).cast("string"))
    epsg = geo.zone_epsg(named)
    lat, lon = geo.utm_inverse(v["east"], v["north"], (epsg % 100).cast("double"), epsg >= 32700)
    llh = F.when(v["lat_deg"].isNotNull() & v["lon_deg"].isNotNull(), F.struct(v["lat_deg"].alias("lat_deg"), v["lon_deg"].alias("lon_deg"), v["h_m"].alias("h_m")))
    utm = F.when(v["east"].isNotNull() & v["north"].isNotNull() & epsg.isNotNull(), F.struct(lat.alias("lat_deg"), lon.alias("lon_deg"), v["h_m"].alias("h_m")))
    return rows.withColumn("p", F.coalesce(ecef, llh, utm)).where("p IS NOT NULL AND stem IS NOT NULL").select("stem", "p.*")


def duplicate_stems(frames: DataFrame, key: str = "stem") -> DataFrame:
    return frames.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    rows = read_table(spark, path, ("utc_s", "lat_deg", "lon_deg"))
    return rows.select(*[number(F.col(c)).alias(c) for c in ("utc_s", "lat_deg", "lon_deg")]).dropna()


def read_poses_text(spark: SparkSession, path: str) -> DataFrame:
    """stem and camera centre from two-line text poses (the second line, of points, may be empty)."""
    head = lines(spark, path).withColumn("p", F.split(F.trim("value"), r"\s+"))
    pose = head.where(~F.col("value").startswith("#") & (F.size("p") == 10) & field(F.col("p"), 1).try_cast("long").isNotNull() & field(F.col("p"), 10).try_cast("double").isNull())
    n = numbers(F.col("p"), "qw qx qy qz tx ty tz", 2)
    rows = pose.select(timefn.image_key(field(F.col("p"), 10)).alias("stem"), F.array(n["qw"], n["qx"], n["qy"], n["qz"]).alias("q"), n["tx"].alias("tx"), n["ty"].alias("ty"), n["tz"].alias("tz"))
    return _centres(rows)


def _centres(rows: DataFrame) -> DataFrame:
    cx, cy, cz = camera_center(F.col("q"), (F.col("tx"), F.col("ty"), F.col("tz")))
    return rows.select("stem", cx.alias("cx"), cy.alias("cy"), cz.alias("cz"))


def read_poses_binary(spark: SparkSession, path: str) -> DataFrame:
    """stem and camera centre from little-endian binary poses; one file is one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                (count,), at, out = struct.unpack_from("<Q", raw), 8, []
                for _ in range(count):
                    pose = struct.unpack_from("<i7di", raw, at)
                    end = raw.index(b"\x00", at + 64)
                    name = raw[at + 64 : end].decode("utf-8", "replace")
                    (points,) = struct.unpack_from("<Q", raw, end + 1)
                    at = end + 9 + 24 * points
                    out.append((name, list(pose[1:5]), *pose[5:8]))
                yield pd.DataFrame(out, columns=["name", "q", "tx", "ty", "tz"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, q array<double>, tx double, ty double, tz double")
    return _centres(rows.withColumn("stem", timefn.image_key(F.col("name"))))


def read_wav(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """file, rate, start (sample number), samples array<double> in [-1, 1], mono: PCM of 8, 16, 24 or 32 bits, in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                at, form, data = 12, None, b""
                while at + 8 <= len(raw):
                    kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
                    if kind == b"fmt ":
                        form = struct.unpack_from("<HHIIHH", raw, at + 8)
                    elif kind == b"data":
                        data = raw[at + 8 : at + 8 + size]
                    at += 8 + size + size % 2
                if form is None:
                    continue
                _, channels, rate, _, _, bits = form
                width = bits // 8
                whole = np.frombuffer(data[: len(data) // (width * channels) * width * channels], np.uint8).reshape(-1, width)
                if bits == 8:
                    x = whole[:, 0].astype(float) / 128 - 1
                else:
                    wide = np.zeros((len(whole), 4), np.uint8)
                    wide[:, 4 - width :] = whole
                    x = wide.view("<i4")[:, 0] / 2.0**31
                x = x.reshape(-1, channels).mean(1)
                for k in range(0, len(x), block):
                    yield pd.DataFrame({"file": [name], "rate": [rate], "start": [k], "samples": [x[k : k + block].tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, rate long, start long, samples array<double>")
