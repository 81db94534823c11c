"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is a number of words. Whole epochs of the source come
first; the rest is a weighted sample without replacement: documents in the order
of exponential keys scaled by their quality weight, taken while the global
prefix sum of their sizes stays within the rest of the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, n_words
from tracelake.llm.sharding import global_prefix

SHARE = 1.5  # of all sizes, to take in all
MOST = 2  # times its size, the most that a source gives
WEIGHTS = (3, 1, 2)  # of the sources in the order of their names, repeating
#: Sampling weight by label: good, bad, not labelled.
GOOD, BAD, PLAIN = 1.0, 0.25, 0.75


def source_targets(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row for each source (null is one, and the last).

    Fills all sources at one level (words for each unit of weight); a source
    that reaches MOST times its size stops there. With the sources in the order
    in which they stop, the level is the largest of the levels that follow if
    the first 0, 1, 2, ... have stopped. The windows run over the table of
    sources, one row each.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_stop = Window.orderBy(MOST * F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    stopped = F.coalesce(F.sum("source_size").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * MOST
    open_weight = F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - stopped) / open_weight)
    target = F.least(F.max("level").over(everything) * F.col("weight"), (MOST * F.col("source_size")).cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def _uniform(doc_id: F.Column) -> F.Column:
    """A number in (0, 1) that the id fixes."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix_plan(docs: DataFrame, quality: DataFrame | None = None, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    size is the number of words, 0 for null or empty text. quality (doc_id,
    quality 0 or 1) sets the sampling weight; of several rows for an id the
    largest counts, and no row or null means PLAIN. A null doc_id has the draw
    of the empty string. Ties of the key (repeated ids) go by id, then size.
    taken = size * copies and copies is at most MOST; the document whose middle
    passes the budget is left out, so that a source's taken words miss its
    target by at most half of one document. Sources without words take none. An
    empty table gives no rows; only the columns named are read, others may have
    any name.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    if quality is not None:
        best = quality.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("__tl_q"))
        sized = sized.join(best, "doc_id", "left")
    else:
        sized = sized.withColumn("__tl_q", F.lit(None).cast("int"))
    weight = F.when(F.col("__tl_q") == 1, GOOD).when(F.col("__tl_q") == 0, BAD).otherwise(PLAIN)
    keyed = materialize(sized.select("doc_id", "source", "size", (-F.log(_uniform(F.col("doc_id"))) / weight).alias("key")))
    targets = materialize(source_targets(keyed, share, weights))
    order = [F.asc_nulls_last("source"), F.asc("key"), F.asc_nulls_last("doc_id"), F.asc("size")]
    rows = global_prefix(keyed, order, "size", "source", targets)
    epochs = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    more = ((F.col("before") + F.col("size") / 2 <= rest) & (F.col("size") > 0)).cast("long")
    copies = (epochs + more).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix_rows(docs: DataFrame, quality: DataFrame | None = None, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as the plan takes it.

    Rows that repeat a doc_id with texts of one size share one decision (the
    fewest copies of theirs). An empty table gives no rows; further columns of
    docs pass through under any name but those that begin with __tl_.
    """
    plan = mix_plan(docs, quality, share, weights)
    copies = plan.groupBy(F.col("doc_id").alias("__tl_id"), F.col("size").alias("__tl_size")).agg(F.min("copies").alias("__tl_copies")).where("__tl_copies > 0")
    sized = docs.withColumn("__tl_n", n_words(F.col("text")))
    taken = sized.join(copies, F.col("doc_id").eqNullSafe(F.col("__tl_id")) & (F.col("__tl_n") == F.col("__tl_size")))
    return taken.withColumn("__tl_copy", F.explode(F.sequence(F.lit(1), F.col("__tl_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


MIX_SQL = r"""
WITH best AS (
  SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, b.q,
         (CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5E0) / 281474976710656.0E0 AS u
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
keyed AS (
  SELECT doc_id, source, size, -ln(u) / CASE WHEN q = 1 THEN 1.0E0 WHEN q = 0 THEN 0.25E0 ELSE 0.75E0 END AS key FROM sized),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM named),
levels AS (
  SELECT *, (1.5E0 * sum(source_size) OVER ()
             - 2 * coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(max(level) OVER () * weight, CAST(2 * source_size AS DOUBLE)) AS target FROM levels),
placed AS (
  SELECT k.doc_id, k.source, k.size, t.source_size, t.target,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
"""

PLAN_SQL = (
    MIX_SQL
    + """SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0E0 <= target - epochs * source_size AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed"""
)
