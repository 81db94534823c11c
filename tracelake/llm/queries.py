"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import common as C
from tracelake.llm import compression_rules, exact_dedup, importance, language_id, mixing, near_dedup, packing, periodic_runs, repeats, sentencepiece_codec, sharding, toxicity, vector_codes

MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(C.documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(C.documents(spark, sf_dir), width=4, percent=80)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(C.documents(spark, sf_dir), C.labels(spark, sf_dir).where("quality = 1"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = model_path()
    return sentencepiece_codec.digests(sentencepiece_codec.decode(sentencepiece_codec.encode(C.documents(spark, sf_dir), path), path))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    rows = compression_rules.quality_rules(docs, compression_rules.fit_limits(docs, C.labels(spark, sf_dir).where("quality = 1")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_outside")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(C.documents(spark, sf_dir), C.labels(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(C.documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(C.documents(spark, sf_dir)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(C.documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(C.documents(spark, sf_dir), C.labels(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_table(C.documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(C.documents(spark, sf_dir), public_tokenizers.path(BYTE_MODEL))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)"""

#: Exact links by counting shared shingles, then the smallest id that they reach.
NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) END AS grams FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(grams) AS grams FROM g GROUP BY list_sort(grams)),
s AS (SELECT rep, hash(x) AS h, len(grams) AS n FROM c, unnest(grams) AS u(x)),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM s a JOIN s b ON a.h = b.h AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT rep AS node, rep AS r FROM c WHERE len(grams) > 0 UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.node),
best AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT g.doc_id, CAST(len(g.grams) AS BIGINT) AS n_shingles, coalesce(best.component_id, g.doc_id) AS component_id,
       g.doc_id = coalesce(best.component_id, g.doc_id) AS kept
FROM g LEFT JOIN c ON c.grams = list_sort(g.grams) AND len(c.grams) > 0 LEFT JOIN best ON best.node = c.rep"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup,
        op2_minhash_near_dedup,
        op3_importance_resampling,
        op4_sentencepiece,
        op5_quality_rules,
        op6_source_mixing,
        op7_language_id,
        op8_suffix_array_dedup,
        op9_sharding,
        op10_toxicity,
        op11_vector_codes,
        op12_periodic_runs,
        op13_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT_SQL, "op2_minhash_near_dedup": NEAR_SQL, "op6_source_mixing": mixing.PLAN_SQL, "op11_vector_codes": vector_codes.code_sql(), "op12_periodic_runs": periodic_runs.RUNS_SQL}
