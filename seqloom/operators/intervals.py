"""Continuous periods and gaps of overlapping intervals per entity.

Starts and ends are sorted independently. With the starts s1 <= s2 <= ... and the ends e1 <= e2 <= ... of an entity,
there is a gap behind rank i exactly where s(i+1) > e(i); the gaps, with the first start and the last end, are the
boundaries of the periods, paired by rank: what follows the k-th gap begins period k + 1 and what precedes it ends period k.

Ranks are distributed: equal positions are counted before the shuffle, starts and ends together, positions fall into buckets of ``width``
positions, so a bucket has at most ``width`` rows however many intervals an entity has; the ranks within buckets are
shifted by the counts of the buckets before, a table of one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, materialize


def _ranked(points: DataFrame, counts: list[str], width: int) -> DataFrame:
    """Adds to ``points`` (entity, pos, distinct, and columns of counts) ``before_`` and the name of each count: its sum over smaller positions of the entity."""
    p = points.withColumn("bucket", F.floor(F.col("pos") / F.lit(width)).cast("bigint"))
    sums = p.groupBy("entity", "bucket").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    w = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("entity", "bucket", *[F.coalesce(F.sum(f"_{c}").over(w), F.lit(0)).alias(f"_{c}") for c in counts])
    inner = Window.partitionBy("entity", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = p.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in counts}).join(offsets, ["entity", "bucket"])
    return inside.select(*points.columns, *[(F.col(f"before_{c}") + F.col(f"_{c}")).alias(f"before_{c}") for c in counts])


def periods_and_gaps(df: DataFrame, width: int = 4096) -> DataFrame:
    """Continuous periods and the gaps between them, from rows ``entity`` (any type), ``start``, ``end`` (half-open).

    Intervals that overlap or touch make one period. Rows with a null entity, start or end, or with start >= end, are
    left out; repeated rows change nothing; an empty input gives no row; other columns are not read.
    Columns: ``entity``, ``kind`` (``covered`` or ``gap``), ``pos_start``, ``pos_end``.
    """
    spark = df.sparkSession
    d = df.select("entity", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    d = d.where(F.col("entity").isNotNull() & (F.col("start") < F.col("end")))
    point = lambda pos, s, e: F.struct(F.col(pos).alias("pos"), F.lit(s).cast("bigint").alias("s"), F.lit(e).cast("bigint").alias("e"))
    points = d.select("entity", F.explode(F.array(point("start", 1, 0), point("end", 0, 1))).alias("p")).groupBy("entity", "p.pos").agg(F.sum("p.s").alias("s"), F.sum("p.e").alias("e"))
    points, points_path = materialize(points, "points")
    ranked, ranked_path = materialize(_ranked(points, ["s", "e"], width), "ranked")
    starts = ranked.where("s > 0").select("entity", F.col("before_s").alias("rank"), F.col("pos").alias("pos_end"))
    ends = ranked.where("e > 0").select("entity", (F.col("before_e") + F.col("e")).alias("rank"), F.col("pos").alias("pos"))
    gaps, gaps_path = materialize(ends.join(starts, ["entity", "rank"]).where("pos_end > pos").select("entity", "pos", "pos_end", F.lit(1).cast("bigint").alias("n")), "gaps")
    numbered, _ = materialize(_ranked(gaps, ["n"], width), "numbered")
    last = gaps.groupBy("entity").agg(F.count(F.lit(1)).alias("last"))
    span = points.groupBy("entity").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).join(last, "entity", "left")
    span, _ = materialize(span.select("entity", "lo", "hi", F.coalesce("last", F.lit(0).cast("bigint")).alias("last")), "spans")
    for path in (points_path, ranked_path, gaps_path):
        drop(spark, path)
    first = F.lit(0).cast("bigint").alias("k")
    opens = numbered.select("entity", (F.col("before_n") + 1).alias("k"), F.col("pos_end").alias("pos_start")).unionByName(span.select("entity", first, F.col("lo").alias("pos_start")))
    closes = numbered.select("entity", F.col("before_n").alias("k"), F.col("pos").alias("pos_end")).unionByName(span.select("entity", F.col("last").alias("k"), F.col("hi").alias("pos_end")))
    periods = opens.join(closes, ["entity", "k"]).select("entity", F.lit("covered").alias("kind"), "pos_start", "pos_end")
    return periods.unionByName(numbered.select("entity", F.lit("gap").alias("kind"), F.col("pos").alias("pos_start"), "pos_end"))


def unwrap_circular(df: DataFrame, lengths: DataFrame, salts: int = 8) -> DataFrame:
    """Cut intervals of circular entities at the origin: ``df`` has entity, start, end; ``lengths`` has entity, length for the circular ones.

    The piece beyond the length continues at 0; an interval that goes round at least once covers the whole circle; a
    start beyond the length is taken modulo it. Entities not in ``lengths``, or with a length that isn't positive, stay as
    they are. The join is salted by the interval, so that one entity with most intervals is spread over ``salts`` tasks.
    """
    left = df.withColumn("salt", F.pmod(F.xxhash64("start", "end"), F.lit(salts)).cast("int"))
    right = lengths.where(F.col("length") > 0).select("entity", "length", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
    j = left.join(right, ["entity", "salt"], "left")
    n, s = F.col("length"), F.pmod(F.col("start"), F.col("length"))
    e = s + F.col("end") - F.col("start")
    piece = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    zero = F.lit(0).cast("bigint")
    pieces = (
        F.when(n.isNull(), F.array(piece(F.col("start"), F.col("end"))))
        .when(F.col("end") - F.col("start") >= n, F.array(piece(zero, n)))
        .when(e > n, F.array(piece(s, n), piece(zero, e - n)))
        .otherwise(F.array(piece(s, e)))
    )
    return j.select("entity", F.explode(pieces).alias("p")).select("entity", "p.start", "p.end")
