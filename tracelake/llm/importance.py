"""Quality by importance resampling: hashed n-gram models and Gumbel top-k.

Two generative models, each a distribution over hashed token uni- and bigrams,
are counted on Spark: one over all text, one over target text. A document's log
importance weight is the sum of the log ratios of its n-grams; adding Gumbel
noise and keeping the largest k keys samples k documents without replacement in
proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common as C
from tracelake.llm.sharding import global_prefix

BUCKETS = 1 << 14
#: Most labelled rows that the target model is fitted on: the bound of the broadcast id table.
TARGET_ROWS = 20_000
#: Share of all documents that the sample keeps.
KEEP = 0.85
_KIND = np.full(256, 2, np.uint8)  # punctuation
_KIND[C.SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters, digits


def _buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and the text of each: runs of letters and digits, runs of punctuation, and pairs of both."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[buf]
    edge = np.ones(len(buf), bool)
    edge[1:] = kind[1:] != kind[:-1]
    cuts = offsets[:-1]
    edge[cuts[cuts < len(buf)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(buf))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    doc = np.searchsorted(offsets, starts, "right") - 1
    one = C.hash_ranges(buf, starts, ends, C.BYTE_CODE_LOWER)
    two, first = C.word_grams(one, doc, 2)
    return (np.concatenate([one, two]) >> np.uint64(64 - 14)).astype(np.int64), np.concatenate([doc, doc[first]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        wanted = np.asarray(batch.column("target").to_pylist(), bool)
        for lo, _, buf, offsets in C.slices(C.rows_of(batch, "text")):
            grams, doc = _buckets(buf, offsets)
            raw += np.bincount(grams, minlength=BUCKETS)
            target += np.bincount(grams[wanted[lo + doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in C.slices(C.rows_of(batch, "text")):
                grams, doc = _buckets(buf, offsets)
                total = np.bincount(doc, ratio[grams], minlength=hi - lo).astype(float)  # integers if there is nothing to add
                count = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(count), pa.array(total)], ["doc_id", "n_grams", "log_weight"])

    return run


def fit_ratio(docs: DataFrame, target_ids: DataFrame, rows: int = TARGET_ROWS) -> np.ndarray:
    """log target over raw probability of each hashed n-gram (add-one smoothing).

    The raw model counts every document; the target model those whose doc_id is
    in target_ids, of which the rows with the smallest hashes count if there are
    more than that. BUCKETS numbers come to the driver.
    """
    chosen = target_ids.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.lit(True).alias("target"))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, t in counts:
        raw[bucket] += r
        target[bucket] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importance_sample(docs: DataFrame, target_ids: DataFrame, keep: float = KEEP, rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept for every row of docs (doc_id, text).

    kept marks the round(keep * n) largest keys of all n rows; ties go to the
    smaller doc_id (null last). The noise follows from doc_id alone (null: the
    empty string), so reruns agree. Null and empty texts have no n-grams and log
    weight 0. Without target rows all weights are 0 plus smoothing, and the
    sample is uniform for equal texts. An empty table gives no rows.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_weigh(fit_ratio(docs, target_ids, rows)), "doc_id long, n_grams long, log_weight double")
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    uniform = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))).withColumn("__tl_one", F.lit(1).cast("long"))
    keyed = C.materialize(keyed)  # the range sort reads it twice
    ranked = C.materialize(global_prefix(keyed, [F.desc("gumbel_key"), F.asc_nulls_last("doc_id")], "__tl_one"))
    k = round(keep * ranked.count())
    return ranked.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("position") < k).alias("kept"))
