"""Deterministic orders and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, order: list[Column], parts: int = 64) -> DataFrame:
    """``rows`` with ``pos`` from 0 in the given total order, without gathering them in one task.

    Rows are range-partitioned by the order and counted per range; a range's offset is the sum of those before it.
    """
    from tesserae.operators.tables import stored

    ranged = stored(rows.withColumn("_o", F.struct(*order)).repartitionByRange(parts, "_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before")  # one row per range
    local = F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1
    return ranged.withColumn("_at", local).join(F.broadcast(counts.select("_p", before)), "_p").withColumn("pos", F.col("_before") + F.col("_at")).drop("_o", "_p", "_at", "_before")


def epoch_order(rows: DataFrame, key: Column, batch: int, world: int, parts: int = 64) -> DataFrame:
    """``pos`` by a key that varies with the epoch, cut to whole batches over all ranks."""
    out = positions(rows, [key, F.col(rows.columns[0])], parts)
    whole = F.floor(F.lit(rows.count()) / (batch * world)) * (batch * world)
    return out.filter(F.col("pos") < whole)


def resume(ordered: DataFrame, consumed: int) -> DataFrame:
    return ordered.filter(F.col("pos") >= consumed)


def rank_stride(ordered: DataFrame, rank: int, world: int) -> DataFrame:
    return ordered.filter(F.pmod("pos", F.lit(world)) == rank)


def contiguous_shard(ordered: DataFrame, total: int, shards: int) -> DataFrame:
    """``shard`` of equal contiguous parts; the first ones are one longer where it doesn't divide."""
    size, longer = divmod(total, shards)
    edge = longer * (size + 1)
    return ordered.withColumn("shard", F.when(F.col("pos") < edge, F.floor(F.col("pos") / (size + 1))).otherwise(F.lit(longer) + F.floor((F.col("pos") - edge) / max(1, size))))


def one_positive(values: Column, draw: Column) -> Column:
    return F.element_at(values, (F.pmod(draw, F.size(values)) + 1).cast("int"))


def some_negatives(values: Column, count: int, draw: Column) -> Column:
    """``count`` different elements; too few is an error."""
    ordered = F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(F.xxhash64(draw, i).alias("h"), i.alias("i"), v.alias("v")))), lambda x: x["v"])
    return F.when(F.size(values) >= count, F.slice(ordered, 1, count)).otherwise(F.raise_error(F.lit(f"fewer than {count} negatives")))
