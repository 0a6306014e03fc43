"""Scores of overlap edges: mutual information, composition, rewards, the best edge of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..functions.seq import clamp_slice, gc_count, gc_fraction, non_gap_length, reward


def mutual_information(pairs: DataFrame, key: list[str], left: str = "aligned_left", right: str = "aligned_right", include_gap: bool = True) -> DataFrame:
    """``mi``, ``nmi``, ``mi_distance``, ``h_left``, ``h_right`` and ``columns`` per alignment, in bits.

    Alignment columns are counted per pair of letters, marginals and sums follow by aggregation; an alignment without columns (or null) has 0, 0, 1, 0, 0, 0.
    """
    letters = F.arrays_zip(F.split(F.col(left), "").alias("x"), F.split(F.col(right), "").alias("y"))
    d = pairs.select(*key, F.explode_outer(letters).alias("c")).select(*key, F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    counted = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != "") & (F.col("y") != "")
    if not include_gap:
        counted = counted & (F.col("x") != "-") & (F.col("y") != "-")
    joint = d.groupBy(*key, "x", "y").agg(F.sum(counted.cast("bigint")).alias("n"))  # at most alphabet^2 rows an alignment
    whole, by_x, by_y = Window.partitionBy(*key), Window.partitionBy(*key, "x"), Window.partitionBy(*key, "y")
    s = joint.withColumns({"t": F.sum("n").over(whole), "nx": F.sum("n").over(by_x), "ny": F.sum("n").over(by_y)})
    p = F.col("n") / F.col("t")
    some = F.col("n") > 0
    s = s.withColumns({
        "mi": F.when(some, p * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).otherwise(0.0),
        "hx": F.when(some, -p * F.log2(F.col("nx") / F.col("t"))).otherwise(0.0), "hy": F.when(some, -p * F.log2(F.col("ny") / F.col("t"))).otherwise(0.0),
    })
    g = s.groupBy(*key).agg(F.sum("mi").alias("mi"), F.sum("hx").alias("h_left"), F.sum("hy").alias("h_right"), F.max("t").alias("columns"))
    total = F.col("h_left") + F.col("h_right")
    g = g.withColumn("nmi", F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col("mi") / total))).otherwise(0.0))
    return g.withColumn("mi_distance", 1 - F.col("nmi"))


def overlap_composition(edges: DataFrame, reads: DataFrame, method: str = "average", aligned: bool = False) -> DataFrame:
    """Adds ``gc_length``, ``gc``, ``gc_share`` and ``gc_source`` of the overlap of each edge.

    With ``aligned`` the columns ``aligned_left`` and ``aligned_right`` come first; then the slices by coordinates; then the mean share of the reads over
    ``overlap_len``. ``method``: ``average`` of both sides, ``left`` or ``right``.
    """
    if method not in ("average", "left", "right"):
        raise ValueError(f"unknown method {method!r}")
    a, b = reads.select(F.col("rid").alias("left_id"), F.col("seq").alias("_x")), reads.select(F.col("rid").alias("right_id"), F.col("seq").alias("_y"))
    d = edges.join(a, "left_id", "left").join(b, "right_id", "left")
    empty = lambda c: F.when(c != "", c)
    sx, sy = empty(clamp_slice("_x", "left_start", "left_end")), empty(clamp_slice("_y", "right_start", "right_end"))
    kinds = []
    if aligned:
        kinds.append(("alignment", empty(F.translate("aligned_left", "-", "")), empty(F.translate("aligned_right", "-", ""))))
    kinds.append(("coordinates", sx, sy))
    length = share = source = count = None

    def chosen(l: Column, r: Column, f) -> Column:
        if method == "left":
            return f(l)
        if method == "right":
            return f(r)
        return F.when(l.isNull(), f(r)).when(r.isNull(), f(l)).otherwise((f(l) + f(r)) / 2)

    fallback = (F.coalesce(gc_fraction("_x"), F.lit(0.0)) + F.coalesce(gc_fraction("_y"), F.lit(0.0))) / F.greatest(F.lit(1), (F.length("_x") > 0).cast("int") + (F.length("_y") > 0).cast("int"))
    fallback = F.coalesce(fallback, F.lit(0.0))
    over = F.greatest(F.lit(0.0), F.col("overlap_len").cast("double"))
    for name, l, r in kinds:
        has = l.isNotNull() if method == "left" else r.isNotNull() if method == "right" else l.isNotNull() | r.isNotNull()
        n, g = chosen(l, r, lambda c: non_gap_length(c).cast("double")), chosen(l, r, lambda c: gc_count(c).cast("double"))
        length = F.when(has, n) if length is None else length.when(has, n)
        count = F.when(has, g) if count is None else count.when(has, g)
        share = F.when(has, g / n) if share is None else share.when(has, g / n)
        source = F.when(has, name) if source is None else source.when(has, name)
    return d.withColumns({
        "gc_length": length.otherwise(over), "gc": count.otherwise(fallback * over), "gc_share": share.otherwise(fallback), "gc_source": source.otherwise("read_average_fallback"),
    }).drop("_x", "_y")


def best_edges(edges: DataFrame, ordinal: str) -> DataFrame:
    """One edge per oriented pair: the highest ``weight_dp`` (else ``dp_score``), of equal ones the first by ``ordinal``."""
    first = Window.partitionBy("left_id", "right_id", "left_orientation", "right_orientation").orderBy(F.desc(F.coalesce("weight_dp", "dp_score")), ordinal)
    return edges.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def pair_rewards(edges: DataFrame, mode: str | Column, normalize: bool = True, denominator: float | None = None, least: float = 0.0) -> DataFrame:
    """``left_id``, ``right_id``, ``reward``: the best reward of each pair of different reads that reaches ``least``, over the largest (or ``denominator``), all 0 where that isn't positive."""
    best = edges.where("left_id <> right_id").select("left_id", "right_id", reward(mode).alias("reward")).where(F.col("reward") >= least).groupBy("left_id", "right_id").agg(F.max("reward").alias("reward"))
    if not normalize:
        return best
    top = F.lit(denominator) if denominator is not None else best.agg(F.max("reward").alias("m")).scalar()
    return best.select("left_id", "right_id", F.when(top > 0, F.col("reward") / top).otherwise(F.lit(0.0)).alias("reward"))


def all_pair_rewards(edges: DataFrame, modes: list[str]) -> DataFrame:
    """:func:`pair_rewards` of several modes from one aggregation: ``mode``, ``left_id``, ``right_id``, ``reward``."""
    best = edges.where("left_id <> right_id").groupBy("left_id", "right_id").agg(*[F.max(F.when(reward(m) >= 0, reward(m))).alias(f"r{i}") for i, m in enumerate(modes)])
    best, _ = materialize(best, "rewards")
    tops = best.agg(*[F.max(f"r{i}").alias(f"t{i}") for i in range(len(modes))])  # one row
    each = [F.struct(F.lit(m).alias("mode"), F.col(f"r{i}").alias("r"), F.col(f"t{i}").alias("t")) for i, m in enumerate(modes)]
    d = best.crossJoin(F.broadcast(tops)).select("left_id", "right_id", F.explode(F.array(*each)).alias("x")).where("x.r is not null")
    return d.select("x.mode", "left_id", "right_id", F.when(F.col("x.t") > 0, F.col("x.r") / F.col("x.t")).otherwise(F.lit(0.0)).alias("reward"))


def extension_costs(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """``left_id``, ``right_id``, ``cost``: the fewest bases that the right read adds behind the left one."""
    right = reads.select(F.col("rid").alias("right_id"), F.length("seq").cast("bigint").alias("n"))
    d = edges.where("left_id <> right_id").join(right, "right_id")
    return d.groupBy("left_id", "right_id").agg(F.min(F.greatest(F.lit(0), F.col("n") - F.col("overlap_len"))).alias("cost"))


def port_score() -> Column:
    """Rank of parallel edges: identity first, then overlap, coverage and cost."""
    return F.col("identity") * 1000 + F.col("overlap_len") + F.coalesce(F.col("coverage"), F.lit(0.0)) * 0.1 - F.coalesce(F.col("cost"), F.lit(0.0)) * 0.01


def top_per_node(edges: DataFrame, k: int, score: Column, source: str = "source", target: str = "target", ordinal: str = "paf_line") -> DataFrame:
    """Edges among the best ``k`` of their source, and of those the best ``k`` of their target.

    ``row_number`` with a limit is applied per map task before the shuffle, so a hot node sends at most k rows from each.
    """
    d = edges.withColumn("_s", score)
    for side in (source, target):
        best = Window.partitionBy(side).orderBy(F.desc("_s"), source, target, ordinal)
        d = d.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")
    return d.drop("_s")
