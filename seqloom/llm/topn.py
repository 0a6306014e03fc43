"""The N best rows of every group, exactly, without moving the rows of a hot group.

Per-group score histograms give each group a threshold that at least N different rows reach; rows below it are
filtered, then the survivors are ranked exactly with all tie keys. A bin of the histogram holds bit maps of row
hashes instead of a count: their population never exceeds the number of different rows, so repeated rows
can't lift the threshold too far. The thresholds of the largest groups are broadcast and filter in the scan; those of
the others meet their rows in the shuffle that ranking needs anyway. Ranking keeps N rows per group and map task
before its shuffle, so even a group whose rows all tie at the threshold is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def score_bin(score: Column) -> Column:
    """A bin number that never falls as the score rises: eight bins for each doubling of its magnitude."""
    s = score.cast("double")
    return (F.signum(s) * F.floor(F.log2(F.abs(s) + 1) * 8)).cast("int")


def thresholds(df: DataFrame, group: list[str], score: str, row_hash: Column, n: int) -> DataFrame:
    """For each group of more than ``n`` rows, the lowest bin that must be kept: ``group`` columns, ``keep_bin`` and ``group_rows``.

    Groups are compared null-safe. Groups whose maps can't prove ``n`` different rows get no threshold; there are at least four slots for each of the ``n`` rows.
    """
    maps = -(-n // 16)
    slot = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(row_hash, F.lit(64)).cast("int"))
    rows = df.select(*group, score_bin(F.col(score)).alias("bin"), F.pmod(F.shiftright(row_hash, 6), F.lit(maps)).cast("int").alias("map"), slot.alias("slot"))
    hist = rows.groupBy(*group, "bin", "map").agg(F.count(F.lit(1)).alias("rows"), F.bit_or("slot").alias("slots"))
    down = Window.partitionBy(*group).orderBy(F.desc("bin")).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    reached = hist.select(*group, "bin", F.sum(F.bit_count("slots").cast("bigint")).over(down).alias("least"), F.sum("rows").over(whole).alias("group_rows"))
    return reached.where((F.col("group_rows") > n) & (F.col("least") >= n)).groupBy(*group).agg(F.max("bin").alias("keep_bin"), F.first("group_rows").alias("group_rows"))


def top_n(df: DataFrame, group: list[str], score: str, ties: list[Column], n: int, identity: list[str] | None = None, broadcast_rows: int = 16_384) -> DataFrame:
    """The first ``n`` rows of each group by ``score`` descending, then by the orderings ``ties``; adds ``rank``.

    Rows with a null score are left out. Rows equal in all columns ``identity`` (default: all columns) count once;
    those that ``ties`` leave equal are ordered by the remaining identity columns, so the result doesn't depend on the
    input's order. An empty input gives no row. A group column may hold null, which is a group of its own. The thresholds of at most
    ``broadcast_rows`` groups, the largest, are broadcast; any other group thus has less than one in ``broadcast_rows`` of all rows, and its
    threshold is joined by a shuffle on the group, whose partitioning the ranking uses again.
    """
    identity = identity or df.columns
    d = df.select(*identity).where(F.col(score).isNotNull())
    row_hash = F.xxhash64(*identity)
    names = [f"_g{i}" for i in range(len(group))]
    slim = d.select(*[F.col(g).alias(x) for g, x in zip(group, names)], F.col(score).alias("_score"), row_hash.alias("_hash"))
    low = thresholds(slim, names, "_score", F.col("_hash"), n).withColumnsRenamed({"keep_bin": "_keep_bin", "group_rows": "_group_rows"})
    low, _ = materialize(low, "thresholds")
    sizes = low.groupBy((F.length(F.bin("_group_rows")) - 1).alias("size")).count().collect()  # at most 64 rows
    cut, taken = 0, 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        taken += r["count"]
        if taken > broadcast_rows:
            cut = 1 << r["size"] + 1
            break
    same = [F.col(g).eqNullSafe(F.col(x)) for g, x in zip(group, names)]
    first = F.col("_group_rows") >= cut
    alike = lambda g, x: F.col(g).eqNullSafe(F.col(x))
    if len(group) == 1:  # the group named null is broadcast as well, so that the rest meet in a plain join, whose partitioning serves the ranking
        first = first | F.col(names[0]).isNull()
        alike = lambda g, x: F.col(g) == F.col(x)
    above = F.col("_keep_bin").isNull() | (score_bin(F.col(score)) >= F.col("_keep_bin"))
    kept = d.join(F.broadcast(low.where(first)), same, "left").where(above).select(*identity)
    if cut:
        kept = kept.join(low.where(~first).hint("merge"), [alike(g, x) for g, x in zip(group, names)], "left").where(above).select(*identity)
    order = [F.col(score).desc(), *ties, *[F.col(c).asc_nulls_first() for c in identity]]
    return kept.dropDuplicates(identity).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
