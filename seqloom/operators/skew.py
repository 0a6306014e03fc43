"""Per-key results over skewed keys: eager aggregation through joins.

Both inputs are reduced to one compact state per key before they meet. Map-side partial aggregation shrinks a key
that holds a third of all rows to one state per map task, so no shuffle partition and no task sees its rows; the join
moves states only, and counts and sums of the joined rows follow from the states algebraically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop, materialize


def key_state(df: DataFrame, key: str, value: str | None = None, prefix: str = "") -> DataFrame:
    """One row per value of ``key`` (null included): ``{prefix}n`` rows, ``{prefix}n_value`` non-null values, ``{prefix}sum`` of ``value``."""
    v = F.col(value).cast("bigint") if value else F.lit(None).cast("bigint")
    return (
        df.select(F.col(key).alias("key"), v.alias("value"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias(f"{prefix}n"), F.count("value").alias(f"{prefix}n_value"), F.sum("value").alias(f"{prefix}sum"))
    )


def present(key: Column) -> Column:
    return key.isNotNull() & (key != "")


def join_states(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_value: str | None = None, right_value: str | None = None) -> DataFrame:
    """Full outer join of the key states of two inputs, one row per present key.

    Columns: ``key``; ``left_n``, ``left_sum``, ``right_n``, ``right_sum`` (0 where the key is missing on a side, null
    values count as 0 in sums); ``joined_n``, the rows that joining the two inputs on the key would give
    (``left_n * right_n``); ``joined_sum``, the sum of ``left_value + right_value`` over those rows
    (``left_sum * right_n + right_sum * left_n``). Null and empty keys join nothing and are left out. Empty inputs give no row.
    """
    a = key_state(left.where(present(F.col(left_key))), left_key, left_value, "left_")
    b = key_state(right.where(present(F.col(right_key))), right_key, right_value, "right_")
    j = a.join(b, "key", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    j = j.select("key", *[zero(c).alias(c) for c in ("left_n", "left_sum", "right_n", "right_sum")])
    return j.withColumns({
        "joined_n": F.col("left_n") * F.col("right_n"),
        "joined_sum": F.col("left_sum") * F.col("right_n") + F.col("right_sum") * F.col("left_n"),
    })


def hot_keys(df: DataFrame, left_key: str, right_key: str, share_num: int, share_den: int, left_name: str, right_name: str) -> DataFrame:
    """Keys that stand in ``left_key`` (or ``right_key``) of at least ``share_num/share_den`` of all rows of ``df``.

    Columns ``side`` (``left_name`` or ``right_name``) and ``node``. The keys come from :func:`join_states`; the total
    counts every row, those with null or empty keys too. An empty table gives no row.
    """
    states = join_states(df, df, left_key, right_key)
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    sides = F.array(
        F.struct(F.lit(left_name).alias("side"), F.col("left_n").alias("n")),
        F.struct(F.lit(right_name).alias("side"), F.col("right_n").alias("n")),
    )
    return (
        states.select(F.col("key").alias("node"), F.explode(sides).alias("s"))
        .where((F.col("s.n") > 0) & (F.col("s.n") * share_den >= total * share_num))
        .select("s.side", "node")
    )


def blocked_join(left: DataFrame, right: DataFrame, key: str, block: int) -> DataFrame:
    """``left`` and ``right`` joined on ``key``; rows of keys that ``right`` holds more than ``block`` times meet in blocks of about as many of them, so that no task gets all pairs of a key."""
    sizes = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    hot, path = materialize(sizes, "hot")
    if hot.isEmpty():
        drop(left.sparkSession, path)
        return left.join(right, key)
    a = left.join(hot, key).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    b = right.join(hot, key).withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.col("_blocks").cast("bigint")).cast("int")).drop("_blocks")
    return left.join(hot, key, "left_anti").join(right, key).unionByName(a.join(b, [key, "_block"]).drop("_block"))


def two_step_walks(edges: DataFrame, source: str = "source", target: str = "target", weight: str = "weight", block: int = 1_000_000) -> DataFrame:
    """Per start node: walks of two edges that begin there, and the sum of the weights of both edges over them.

    Joining edges on ``target = source`` would give the product of in- and out-degrees of each hot middle node. Here
    the first edges are pre-aggregated by (start, middle) and the second ones by middle; the compact states are
    joined, the many starts of a hot middle in blocks of about ``block``, multiplied, and rolled up to the start. Edges without both ends are left out, a null weight counts as 0.
    Columns: ``node``, ``walks``, ``walk_weight``.
    """
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"), F.coalesce(F.col(weight).cast("bigint"), F.lit(0)).alias("w"))
    e = e.where(present(F.col("s")) & present(F.col("t")))
    first = e.groupBy("s", "t").agg(F.count(F.lit(1)).alias("n1"), F.sum("w").alias("w1"))
    second = e.groupBy(F.col("s").alias("t")).agg(F.count(F.lit(1)).alias("n2"), F.sum("w").alias("w2"))
    first, _ = materialize(first, "firsts")
    return (
        blocked_join(second, first, "t", block)
        .groupBy(F.col("s").alias("node"))
        .agg(F.sum(F.col("n1") * F.col("n2")).alias("walks"), F.sum(F.col("w1") * F.col("n2") + F.col("w2") * F.col("n1")).alias("walk_weight"))
    )
