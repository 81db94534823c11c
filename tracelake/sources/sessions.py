"""Sessions from folders of recorded files: which file is which, old or new format, and cut clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files by name; the first that fits counts. Fixed values of the recording format.
KINDS = {
    "clip_meta": r"\.chop_meta\.json$",
    "clip_video": r"^chop_.*\.mp4$",
    "clip_anchor": r"^chop_.*\.video_anchor\.txt$",
    "video_anchor": r"^recording_.*\.video_anchor\.txt$",
    "measurements": r"^measurements_.*\.txt$",
    "recording": r"^recording_.*\.txt$",
    "sensors": r"^sensors_.*\.txt$",
    "manifest": r"^capture_meta\.json$",
    "audio_anchor": r"^audio_anchor_.*\.txt$",
    "audio": r"^audio_.*\.wav$",
    "video": r"^recording_.*\.mp4$",
    "other_video": r"\.mp4$",
}
REQUIRED = ("measurements", "recording", "sensors")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file of every file below path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))


def kind_of(name: Column) -> Column:
    """The kind of a file by its name, or null."""
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(KINDS.items()):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    return kind


def resolve(files: DataFrame) -> DataFrame:
    """One row for each session folder of files (file): its files by kind, format, clip folder and problem.

    Of several files of an optional kind the first by name counts. problem says
    what is missing or ambiguous among the required ones, or is null. A session
    has format new if it has a manifest or a frame anchor. A folder whose name
    begins with chop_ and that holds a clip's description, video and anchor is a
    clip of the folder above: if a session has exactly one, video and
    video_anchor are the clip's, and clip names it.
    """
    parts = F.split("file", "/")
    named = files.select("file", F.element_at(parts, -1).alias("name"), F.regexp_replace("file", "/[^/]*$", "").alias("folder")).withColumn("kind", kind_of(F.col("name"))).where("kind IS NOT NULL")
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("file"))).alias(k)
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    folders = named.groupBy("folder").agg(*map(first, KINDS), *map(count, REQUIRED))
    is_clip = F.element_at(F.split("folder", "/"), -1).startswith("chop_") & (F.col("n_measurements") == 0) & F.col("clip_meta").isNotNull() & F.col("clip_video").isNotNull() & F.col("clip_anchor").isNotNull()
    folders = folders.withColumn("is_clip", is_clip)
    clips = folders.where("is_clip").withColumn("session", F.regexp_replace("folder", "/[^/]*$", "")).groupBy("session")
    clips = clips.agg(F.count(F.lit(1)).alias("clips"), F.min("folder").alias("clip"), F.min("clip_video").alias("__video"), F.min("clip_anchor").alias("__anchor"))
    rows = folders.where(~F.col("is_clip")).withColumnRenamed("folder", "session").join(clips, "session", "left")
    one = F.coalesce(F.col("clips") == 1, F.lit(False))
    said = [F.when(F.col(f"n_{k}") == 0, f"no {k} file").when(F.col(f"n_{k}") > 1, f"several {k} files") for k in REQUIRED]
    return rows.select(
        "session",
        *REQUIRED,
        "manifest",
        "audio_anchor",
        "audio",
        F.when(one, F.col("__video")).otherwise(F.coalesce("video", "other_video")).alias("video"),
        F.when(one, F.col("__anchor")).otherwise(F.col("video_anchor")).alias("video_anchor"),
        F.when(one, F.col("clip")).alias("clip"),
        F.when(F.col("manifest").isNotNull() | F.col("video_anchor").isNotNull(), "new").otherwise("old").alias("format"),
        F.nullif(F.concat_ws("; ", *said), F.lit("")).alias("problem"),
    )
