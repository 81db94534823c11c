"""What the corpus operators share: reading, shared scratch tables, text to numpy."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six bytes (space, tab to carriage return).
WORD_BREAK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def n_words(text: Column) -> Column:
    """Number of words; null counts as no words."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WORD_BREAK}|{WORD_BREAK}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_BREAK))).cast("long")


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the decimal id; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def scratch(spark: SparkSession) -> str:
    """A new folder of this application under spark.checkpoint.dir, which every executor can reach.

    Only a local session may go without that setting; it gets a temporary folder.
    All folders of an application lie in one, to be deleted when its results are written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tracelake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    Cuts lineage: the rows survive the loss of any executor, and later stages
    read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A string column without nulls (null counts as empty)."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string array into runs of whole texts of about limit bytes.

    Yields first row, last row (excluded), the bytes, and the texts' offsets in
    them. A text above the limit is a run of its own.
    """
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# -- hashing of byte ranges ---------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[65:91] = BYTE_CODE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(buf: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Prefix sums (with a leading 0) from which range_hash takes any byte range."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(code[buf] * powers(len(buf))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end): equal bytes give equal values."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = BYTE_CODE, piece: int = 1 << 20) -> np.ndarray:
    """range_hash of byte ranges in order of start, a piece of the bytes at a time: long texts need no long arrays of powers."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + piece, "right")))
        lo, hi = int(start[i]), int(end[i:j].max())
        out[i:j] = range_hash(prefix_hash(buf[lo:hi], code), start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    n = len(buf)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~SPACE[buf]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(offsets, s, "right") - 1


def word_grams(word_hash: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within one text, and the number of its first word."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(text[:m] == text[n - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        total += word_hash[first + k] * STEPS[k]
    return mix(total), first
