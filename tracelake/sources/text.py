"""Lines of text files with their file and order, the base of all record readers.

Readers are lazy projections: bad records become null fields and are filtered,
never exceptions, and bad_records() counts them file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line_no (rising within a file, not gapless)."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"))


def number(part: Column) -> Column:
    """A finite double or null (blank, words, nan and inf)."""
    x = F.nullif(F.trim(part), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("1e308")), x)


def field(parts: Column, k: int) -> Column:
    """The k-th part from 1, or null."""
    return F.try_element_at(parts, F.lit(k))


def numbers(parts: Column, names: str, start: int = 1) -> dict[str, Column]:
    """Consecutive parts as doubles by name."""
    return {n: number(field(parts, start + k)) for k, n in enumerate(names.split())}


def bad_records(records: DataFrame, good: Column) -> DataFrame:
    """file, good and bad records of each file."""
    return records.groupBy("file").agg(F.count_if(good).alias("good"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
