"""The same operators at the volume of the order tables: robust statistics, band joins, ranking, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import stats
from tracelake.plans.tracks import rounded, table
from tracelake.registry import query


@query("""WITH s AS (SELECT l_suppkey, l_extendedprice - 30000 AS x FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(avg(x), 3) + 0.0E0 AS mean, round(avg(abs(x)), 3) AS mean_abs, round(stddev_pop(x), 3) AS std, round(sqrt(avg(x * x)), 3) AS rms, round(quantile_cont(abs(x), 0.6827), 3) AS p68,
  round(quantile_cont(abs(x), 0.9545), 3) AS p95, round(quantile_cont(abs(x), 0.9973), 3) AS p997, round(max(abs(x)), 3) AS max_abs FROM s GROUP BY l_suppkey""")
def volume_sigma_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_extendedprice") - 30000).alias("x"))
    return rounded(stats.sigma_bands(rows, "x", ["l_suppkey"]), 3)


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem), o AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders)
SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM o JOIN e ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey""")
def volume_band_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines shipped within sixty days of their order: equality first, the band as a residual."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    near = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return o.join(li, (o.o_orderkey == li.l_orderkey) & near).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""")
def volume_top_three(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report: the three largest lines of each supplier."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").withColumn("place", F.row_number().over(w)).where("place <= 3")
    return rows.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, median(l_quantity) AS med, quantile_cont(l_extendedprice, [0.5, 0.95]) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, med, round(p[1], 4) AS p50, round(p[2], 4) AS p95 FROM m""")
def volume_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    li, by = table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]
    quantity = stats.quantiles(li, "l_quantity", {"med": 0.5}, by).drop("n")
    price = stats.quantiles(li, "l_extendedprice", {"p50": 0.5, "p95": 0.95}, by).drop("n")
    return quantity.join(price, by).select(*by, "med", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("""WITH s AS (SELECT c_custkey, c_acctbal, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q, cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS cd FROM customer)
SELECT c_custkey, CAST(q AS BIGINT) AS quartile, round(cd, 6) AS cume FROM s""")
def volume_ranks(spark: SparkSession, sf: str) -> DataFrame:
    r = stats.ranks(table(spark, sf, "customer"), "c_acctbal", ["c_custkey"], ["c_nationkey"])
    # The first n % 4 quartiles have one row more.
    size, more, at = F.floor(F.col("n") / 4), F.col("n") % 4, F.col("rank") - 1
    quartile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return r.select("c_custkey", quartile.cast("long").alias("quartile"), F.round(F.col("up_to") / F.col("n"), 6).alias("cume"))


@query("""SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 4) AS norm, min(len(embedding)) AS width FROM embeddings GROUP BY label""")
def volume_vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Norms of array rows by higher-order functions."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 4).alias("norm"), F.min(F.size("embedding")).alias("width"))


@query("""WITH g AS (SELECT e, s FROM range(0, 6) a(e), range(0, 4) b(s)), p AS (SELECT l_suppkey % 6 AS e, l_partkey % 4 AS s, avg(l_tax) AS v FROM lineitem GROUP BY 1, 2)
SELECT CAST(g.e * 5 AS BIGINT) AS elmask, CAST(20 + g.s * 5 AS BIGINT) AS snr, round(coalesce(p.v, -1), 6) AS score FROM g LEFT JOIN p ON g.e = p.e AND g.s = p.s""")
def volume_option_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of two option lists (made by one sequence, no cross join), with the scores that there are."""
    grid = spark.range(24).select((F.col("id") / 4).cast("long").alias("e"), (F.col("id") % 4).alias("s"))
    li = table(spark, sf, "lineitem")
    scores = li.groupBy((F.col("l_suppkey") % 6).alias("e"), (F.col("l_partkey") % 4).alias("s")).agg(F.avg("l_tax").alias("v"))
    return grid.join(scores, ["e", "s"], "left").select((F.col("e") * 5).alias("elmask"), (F.col("s") * 5 + 20).alias("snr"), F.round(F.coalesce("v", F.lit(-1.0)), 6).alias("score"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def volume_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FO")
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "first only")).unionByName(count(a.unionByName(b).distinct(), "either"))
