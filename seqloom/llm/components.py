"""Groups of linked records: connected components by alternating star rewrites.

Edges point from the larger id to the smaller. The large-star step links every neighbour larger than a node to the
smallest neighbour of that node, the small-star step does so for the smaller ones; both keep the components, and at
the fixed point every record is linked to the smallest of its component. Each step is a grouped minimum (combined
before the shuffle) and an equi-join whose hot side adaptive execution splits; tables between rounds are written to
the shared folder, and only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, materialize


def links_from(df: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected links (``big`` > ``small``) from two id columns; rows with a null, empty or equal pair are left out."""
    p = df.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
    p = p.where((F.col("x") != "") & (F.col("y") != "") & (F.col("x") != F.col("y")))
    return p.select(F.greatest("x", "y").alias("big"), F.least("x", "y").alias("small"))


def _large_star(e: DataFrame) -> DataFrame:
    low = e.groupBy(F.col("big").alias("small")).agg(F.min("small").alias("low"))  # the smallest of the smaller neighbours
    return e.join(low, "small", "left").select("big", F.coalesce("low", "small").alias("small")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("big").agg(F.min("small").alias("low"))
    j = e.join(low, "big")
    chained = j.where(F.col("small") != F.col("low")).select(F.col("small").alias("big"), F.col("low").alias("small"))
    return low.select("big", F.col("low").alias("small")).unionByName(chained).distinct()


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Every linked record with the smallest id of its component: ``group_id``, ``read_id``.

    ``links`` has ``big`` and ``small`` as made by :func:`links_from`; repeated links change nothing, no links give no
    row. Raises if ``max_rounds`` rounds don't reach the fixed point (rounds grow with the logarithm of the longest chain).
    """
    spark = links.sparkSession
    e, path = materialize(links.distinct(), "links")
    seen: tuple | None = None
    for _ in range(max_rounds):
        new, new_path = materialize(_small_star(_large_star(e)), "links")
        drop(spark, path)
        e, path = new, new_path
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(20,0)"))).first())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("small").alias("group_id"), F.col("small").alias("read_id")).distinct()
    return e.select(F.col("small").alias("group_id"), F.col("big").alias("read_id")).unionByName(roots)
