"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of all digests name the few that may be frequent; exact
counts verify them, and the verified winners, a table of bounded size, are
broadcast, so that copies of frequent texts go on the map side and never
shuffle. All other digests, each of bounded frequency, use an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import lower_az, materialize

#: Counters of each summary, and so the most rows that the broadcast table can have.
COUNTERS = 1024


def digest(text: F.Column) -> F.Column:
    """SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    return F.sha2(lower_az(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for key, n in Counter(batch.column(0).to_pylist()).items():
                held[key] = held.get(key, 0) + n
            if len(held) > counters:
                # Taking the next largest count from all is a round of Misra-Gries for every
                # distinct key beyond the counters.
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: n - cut for k, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return run


def frequent_digests(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most counters digests; every one with more than 1 / (counters + 1) of the rows is there."""
    parts = keyed.select("digest").mapInArrow(_summaries(counters), "digest string, n long")
    merged = parts.groupBy("digest").agg(F.sum("n").alias("n"))
    # Merged summaries keep their error bound if cut back to the largest counters.
    return merged.orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def heavy_winners(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, keep_id and group_size of the frequent digests, verified by an exact count (two copies at least)."""
    found = keyed.join(F.broadcast(frequent_digests(keyed, counters)), "digest", "left_semi")
    return found.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Of texts that are equal after lower-casing A-Z, the row with the largest id
    stays. Null text counts as empty text. A null id is below every other id; if
    all ids of a group are null, keep_id is null and its rows are kept. Rows
    that repeat the winning id all have kept = true (keep_rows leaves one of
    them). An empty table gives no rows; other columns are not looked at.
    """
    keyed = materialize(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")))
    heavy = materialize(heavy_winners(keyed, counters))
    by_heavy = keyed.join(F.broadcast(heavy), "digest", "left")
    light = by_heavy.where("group_size IS NULL").select("doc_id", "digest")
    sizes = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = by_heavy.where("group_size IS NOT NULL").unionByName(light.join(sizes, "digest"))
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("digest").alias("text_sha256"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: exactly one for each text.

    Copies of frequent texts are filtered out where they are read; the rest
    shuffles once by digest. Ties (rows that repeat an id, or have none) go to
    one of the tied rows, which differ in letter case or in other columns only.
    """
    key, win = "__tl_digest", "__tl_winner"
    keyed = docs.withColumn(key, digest(F.col(text_col)))
    heavy = materialize(heavy_winners(materialize(keyed.select(F.col(id_col).alias("doc_id"), F.col(key).alias("digest"))), counters))
    names = heavy.select(F.col("digest").alias(key), F.col("keep_id").alias(win), F.lit(True).alias("__tl_heavy"))
    left = keyed.join(F.broadcast(names), key, "left").where(F.col("__tl_heavy").isNull() | F.col(id_col).eqNullSafe(F.col(win)))
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(id_col), F.xxhash64(text_col))
    return left.withColumn("__tl_rank", F.row_number().over(order)).where("__tl_rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
