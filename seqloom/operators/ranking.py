"""Ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 0-based position of every row in a total order.

    Rows are range-partitioned and sorted; the position within a partition plus the sizes of the partitions before give the rank, so no task
    sees more than its range. The table is written once, as sampled ranges may differ when computed again.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = d.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    d, _ = materialize(d, "ranked")
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def entity_rank(df: DataFrame, entity: list[str], pos: str, ties: list[str], name: str = "rank", width: int = 4096) -> DataFrame:
    """Adds the 0-based position of every row among those of its entity, by ``pos`` then ``ties``; ``{name}_n`` is the entity's rows.

    ``pos`` is an integer; windows cover ``width`` positions, so that an entity with most rows is spread over many tasks.
    """
    d = df.withColumn("_b", F.floor(F.col(pos) / F.lit(width)))
    sizes = d.groupBy(*entity, "_b").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*entity).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*entity, "_b", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*entity)).alias(f"{name}_n"))
    inner = Window.partitionBy(*entity, "_b").orderBy(pos, *ties)
    d = d.withColumn("_i", F.row_number().over(inner) - 1)
    return d.join(before, [*entity, "_b"]).withColumn(name, F.col("_i") + F.col("_before")).drop("_b", "_i", "_before")


def running_before(df: DataFrame, entity: list[str], pos: str, value: str, name: str = "before", width: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the entity at smaller positions (distinct within an entity)."""
    d = df.withColumn("_b", F.floor(F.col(pos) / F.lit(width)))
    sums = d.groupBy(*entity, "_b").agg(F.sum(value).alias("_s"))
    up = Window.partitionBy(*entity).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*entity, "_b", F.coalesce(F.sum("_s").over(up), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*entity, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_i", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return d.join(before, [*entity, "_b"]).withColumn(name, F.col("_i") + F.col("_before")).drop("_b", "_i", "_before")
