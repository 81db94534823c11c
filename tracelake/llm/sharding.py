"""Contiguous shards of near equal bytes, from global prefix sums.

A range sort puts the rows in order; each partition's totals, one row for each
partition, give the offset at which its own running sums go on. Cutting the
global sums at equal targets gives contiguous balanced shards, with no window
over a whole shard and no row collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialize


def global_prefix(df: DataFrame, order: list[Column], value: str, group: str | None = None, info: DataFrame | None = None) -> DataFrame:
    """df with before (sum of value over all earlier rows) and position (their number).

    With group, both count within each value of that column; order must then
    begin with it, and info may hold one row of further columns for each group.
    Offsets are joined on the partition number (and group): there is one for each
    partition and group that it holds, and a group of any size is dealt over many.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = materialize(ordered.withColumn("__tl_part", F.spark_partition_id()))
    keys = ["__tl_part"] + ([group] if group else [])
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("__tl_sum"), F.count(F.lit(1)).alias("__tl_n"))
    earlier = Window.partitionBy(*keys[1:]).orderBy("__tl_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__tl_sum", "__tl_n")])
    extra = []
    if group:
        offsets = offsets.withColumnRenamed(group, "__tl_group").withColumnRenamed("__tl_part", "__tl_p")
        if info is not None:
            extra = [c for c in info.columns if c != group]
            named = info.withColumnRenamed(group, "__tl_name")
            offsets = offsets.join(named, F.col("__tl_group").eqNullSafe(F.col("__tl_name"))).drop("__tl_name")
        joined = rows.join(offsets, (F.col("__tl_part") == F.col("__tl_p")) & F.col(group).eqNullSafe(F.col("__tl_group")))
    else:
        joined = rows.join(offsets, "__tl_part")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(value).over(within) - F.col(value) + F.col("__tl_sum_before")
    position = F.row_number().over(within) - 1 + F.col("__tl_n_before")
    return joined.select(*df.columns, *extra, before.cast("long").alias("before"), position.cast("long").alias("position"))


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size is the text's UTF-8 bytes plus 1 (null text: 1; its crc32 is that of
    the empty string). Rows are taken in the order of doc_id, null first, ties
    by crc32 and size; a row goes to the shard in whose equal range of the global sum
    its middle byte falls. slot counts from 0 without gaps in each shard.
    With fewer rows than shards some shards stay empty. Repeated rows are
    rows of their own; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = global_prefix(materialize(sized), [F.asc_nulls_first("doc_id"), F.asc("text_crc32"), F.asc("size")], "size")
    rows = materialize(rows)
    total = rows.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    placed = rows.withColumn("shard", F.expr(f"CAST(((2 * before + size) * {shards}) DIV {2 * total} AS INT)"))
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
