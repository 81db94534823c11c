"""A corpus from raw documents to tokens: toxicity, copies, near copies, mix, encoding.

Each stage works on all that the stage before it kept. run() writes each
stage's rows as Parquet to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import common as C
from tracelake.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from tracelake.llm.queries import model_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity score doesn't reject. Null and empty texts stay; without labels or rows nothing is rejected."""
    return toxicity.keep_rows(docs, C.labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text (A-Z lower-cased, null is empty): that with the largest doc_id, also where rows repeat it or have none."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each component of texts that share 80 % of their five-word shingles: that with the smallest doc_id. Texts without words are alone."""
    return near_dedup.keep_rows(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources (null is one): each row as often as its source's target takes it, rows without words as often as all of it is taken."""
    return mixing.mix_rows(docs, C.labels(spark, sf_dir))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids for every row of the mix; null text has no ids, repeated rows have equal ones."""
    from pyspark.sql import functions as F

    path = model_path()
    tokens = sentencepiece_codec.encode(docs, path, keep=("doc_id", "source"))
    return tokens.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: The toxicity score and the library's encoding have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir))
    return docs
