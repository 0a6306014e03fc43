"""Overlap graphs: components, orientation, cleanup, reduction, chains, cycles.

Graphs are edge tables (``source``, ``target`` and further columns). Iterations write their tables to the shared folder; only counts come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import reward
from ..session import drop, materialize


def _fixpoint_sign(df: DataFrame, *cols: str) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(20,0)"))).first())


def weak_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 200) -> DataFrame:
    """``node`` and ``component`` (its smallest node), over edges in either direction.

    Every node points to a smaller one. In each round it takes the smallest of the labels' labels around it, and hands it to the node that it pointed to, so whole trees are hooked to smaller
    ones at once and rounds grow with the logarithm of the number of nodes. Minima are taken before the shuffle and hot nodes' joins are split by adaptive execution. Nodes without edges are given by ``nodes`` (column ``node``); null ends are left out.
    """
    ends = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))
    both, both_path = materialize(edges.where("source is not null and target is not null").select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct(), "links")
    start = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component"))
    if nodes is not None:
        lone = nodes.select("node").where("node is not null").distinct().join(start, "node", "left_anti")
        start = start.unionByName(lone.select("node", F.col("node").alias("component")))
    labels, path = materialize(start, "labels")
    sign = None
    for _ in range(rounds):
        top = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        far = labels.join(top, "component").select("node", "component", "up")
        least = both.join(far.select(F.col("node").alias("b"), "up"), "b").groupBy(F.col("a").alias("node")).agg(F.min("up").alias("low"))
        j, j_path = materialize(far.join(least, "node", "left"), "around")
        own = j.select("node", F.least("up", "low").alias("component"))
        hooks = j.where("low < component").groupBy(F.col("component").alias("node")).agg(F.min("low").alias("component"))
        new, new_path = materialize(own.unionByName(hooks).groupBy("node").agg(F.min("component").alias("component")), "labels")
        for old in (path, j_path):
            drop(labels.sparkSession, old)
        labels, path = new, new_path
        now = _fixpoint_sign(labels, "node", "component")
        if now == sign:
            drop(labels.sparkSession, both_path)
            return labels
        sign = now
    raise RuntimeError(f"labels still change after {rounds} rounds")


def cyclic_core(edges: DataFrame) -> tuple[DataFrame, str, int]:
    """Edges (``source``, ``target``) left when those at nodes without an edge in or out are taken off until there are none; their table's path and number. A graph is acyclic if none is left."""
    e, path = materialize(edges.select("source", "target").distinct(), "edges")
    n, before = e.count(), -1
    while n and n != before:
        keep = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        e, path, old = *materialize(keep.select("source", "target"), "edges"), path
        drop(edges.sparkSession, old)
        n, before = e.count(), n
    return e, path, n


def spread_labels(labels: DataFrame, edges: DataFrame, rounds: int, jump: bool = True) -> tuple[DataFrame, str]:
    """Smallest label that reaches each node along the edges, start included: ``node``, ``label``; and the table's path. Only labels that changed are sent on.

    With ``jump`` labels name nodes that reach whatever bears them; then what such a node is labelled with reaches it too, and is taken over at once, so labels travel twice as far in every round.
    """
    spark = labels.sparkSession
    state, path = materialize(labels.withColumn("fresh", F.col("label").isNotNull()), "spread")
    for _ in range(rounds):
        come = state.where("fresh").select(F.col("node").alias("source"), "label").join(edges, "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("c"))
        new = state.join(come, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "c").alias("label"))
        if jump:
            up = state.select(F.col("node").alias("label"), F.col("label").alias("up"))
            new = new.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label"))
        fresh = F.col("label").isNotNull() & (F.col("old").isNull() | (F.col("label") < F.col("old")))
        new, new_path = materialize(new.select("node", "label", fresh.alias("fresh")), "spread")
        drop(spark, path)
        state, path = new, new_path
        if state.where("fresh").isEmpty():
            return state.select("node", "label"), path
    raise RuntimeError(f"labels still change after {rounds} rounds")


def strong_components(edges: DataFrame, rounds: int = 500) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of the strongly connected components; self loops and null ends don't matter.

    Nodes without edges in or out are peeled off and the rest is coloured: the smallest id that reaches a node
    is its colour; what reaches the colour's own node within the colour is a component. That repeats on the edges left within colours, in all colours at once.
    """
    spark = edges.sparkSession
    e = edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct()
    nodes, _ = materialize(edges.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct(), "nodes")
    parts, path = [], None
    while True:
        old, (e, path, n) = path, cyclic_core(e)
        if old:
            drop(spark, old)
        if not n:
            break
        live = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        colour, colour_path = spread_labels(live.withColumn("label", F.col("node")), e, rounds)
        same = e.join(colour.select(F.col("node").alias("source"), F.col("label").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("label").alias("b")), "target").where("a = b")
        back, back_path = materialize(same.select(F.col("target").alias("source"), F.col("source").alias("target")), "back")
        roots = colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label"))
        reach, reach_path = spread_labels(roots, back, rounds, False)
        found, _ = materialize(reach.where("label is not null").select("node", F.col("label").alias("component")), "components")
        parts.append(found)
        gone = found.select("node")
        inner = back.select(F.col("target").alias("source"), F.col("source").alias("target"))  # components don't reach over colours
        left = inner.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        e, path, old = *materialize(left, "edges"), path
        for p in (old, colour_path, back_path, reach_path):
            drop(spark, p)
    drop(spark, path)
    if not parts:
        return nodes.select("node", F.col("node").alias("component"))
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(components: DataFrame, read_of: Column) -> DataFrame:
    """Nodes of the strong component (of two nodes or more) with the most reads, then nodes, then the smallest name: ``node``."""
    sized = components.groupBy("component").agg(F.count_distinct(read_of).alias("reads"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return components.join(sized.orderBy(F.desc("reads"), F.desc("n"), "component").limit(1).select("component"), "component", "left_semi").select("node")


def orientation_constraints(edges: DataFrame, mode: str = "overlap_len_power2", ordinal: str = "paf_line") -> DataFrame:
    """One edge per unordered pair of reads and relative orientation, the strongest: by reward, overlap, identity and error rate, all descending, then the first.

    That the higher error rate wins a tie of the others is how the selection is defined. Adds ``first``, ``second``, ``parity`` and ``score``.
    """
    e = edges.where("left_id <> right_id").withColumns({"score": reward(mode), "first": F.least("left_id", "right_id"), "second": F.greatest("left_id", "right_id"), "parity": F.col("left_orientation") * F.col("right_orientation")})
    best = Window.partitionBy("first", "second", "parity").orderBy(F.desc("score"), F.desc("overlap_len"), F.desc("identity"), F.desc("error_rate"), ordinal)
    return e.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def orient_reads(constraints: DataFrame, reads: DataFrame, rounds: int = 60) -> DataFrame:
    """``rid``, ``tree`` and ``side`` (1 or -1): orientations relative to the smallest read of the tree, along the maximum spanning forest of the constraints.

    Every tree picks its strongest edge out (the order is strict, so no cycle arises but the pair that picks the same edge), trees join along the picks, and orientations are
    multiplied along the way. The number of trees at least halves in every round.
    """
    spark = reads.sparkSession
    order = F.struct((-F.col("score")).alias("a"), (-F.col("overlap_len")).alias("b"), (-F.col("identity")).alias("c"), "left_id", "right_id", "left_orientation", "right_orientation")
    e, _ = materialize(constraints.select("left_id", "right_id", "parity", order.alias("o")), "constraints")
    state, path = materialize(reads.select("rid", F.col("rid").alias("tree"), F.lit(1).alias("side")), "trees")
    for _ in range(rounds):
        s = lambda x: state.select(F.col("rid").alias(f"{x}_id"), F.col("tree").alias(f"{x}_tree"), F.col("side").alias(f"{x}_side"))
        out = e.join(s("left"), "left_id").join(s("right"), "right_id").where("left_tree <> right_tree").withColumn("turn", F.col("parity") * F.col("left_side") * F.col("right_side"))
        ends = out.select("o", "turn", F.explode(F.array(F.struct(F.col("left_tree").alias("tree"), F.col("right_tree").alias("other")), F.struct(F.col("right_tree").alias("tree"), F.col("left_tree").alias("other")))).alias("t"))
        picks = ends.groupBy("t.tree").agg(F.min_by(F.struct("t.other", "turn"), "o").alias("p")).select("tree", F.col("p.other").alias("parent"), "p.turn")
        picks, picks_path = materialize(picks, "picks")
        if picks.isEmpty():
            drop(spark, picks_path)
            return state
        # of two trees that picked each other the smaller is the root
        mutual = picks.select(F.col("tree").alias("parent"), F.col("parent").alias("back"))
        up = picks.join(mutual, "parent", "left")
        root = (F.col("back") == F.col("tree")) & (F.col("tree") < F.col("parent"))
        up = up.select("tree", F.when(root, F.col("tree")).otherwise(F.col("parent")).alias("parent"), F.when(root, F.lit(1)).otherwise(F.col("turn")).alias("turn"))
        up, up_path = materialize(up, "up")
        sign = None
        while True:  # jump to the root
            top = up.select(F.col("tree").alias("parent"), F.col("parent").alias("grand"), F.col("turn").alias("t2"))
            new, new_path = materialize(up.join(top, "parent").select("tree", F.col("grand").alias("parent"), (F.col("turn") * F.col("t2")).alias("turn")), "up")
            drop(spark, up_path)
            up, up_path = new, new_path
            now = _fixpoint_sign(up, "tree", "parent")
            if now == sign:
                break
            sign = now
        new, new_path = materialize(state.join(up, "tree", "left").select("rid", F.coalesce("parent", "tree").alias("tree"), (F.col("side") * F.coalesce("turn", F.lit(1))).cast("int").alias("side")), "trees")
        for p in (path, picks_path, up_path):
            drop(spark, p)
        state, path = new, new_path
    raise RuntimeError(f"trees still join after {rounds} rounds")


def select_orientation(edges: DataFrame, reads: DataFrame, mode: str = "overlap_len_power2", ordinal: str = "paf_line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One orientation per read, the edges that agree with it, and a report of one row.

    Orientations follow the forest of :func:`orient_reads`, normalised to +1 for the smallest read of a tree; of a tree and its mirror image the one is taken with more reads that
    have agreeing edges both in and out, then with either, then the higher score, then more edges, then +1.
    """
    known = reads.select("rid").where("rid is not null").distinct()
    e = edges.where("left_id <> right_id").join(known.withColumnRenamed("rid", "left_id"), "left_id", "left_semi").join(known.withColumnRenamed("rid", "right_id"), "right_id", "left_semi").withColumn("score", reward(mode))
    c = orientation_constraints(e, mode, ordinal)
    forest = orient_reads(c, known)
    low = forest.groupBy("tree").agg(F.min_by("side", "rid").alias("base"))
    o, _ = materialize(forest.join(low, "tree").select("rid", "tree", (F.col("side") * F.col("base")).alias("side")), "sides")
    s = lambda x: o.select(F.col("rid").alias(f"{x}_id"), F.col("side").alias(f"{x}_side"), *([F.col("tree")] if x == "left" else []))
    j = e.join(s("left"), "left_id").join(s("right"), "right_id")
    lp, rp = F.col("left_side") * F.col("left_orientation"), F.col("right_side") * F.col("right_orientation")
    agree = j.where(lp == rp).withColumn("phase", lp)
    ends = agree.select("tree", "phase", F.explode(F.array(F.struct(F.col("left_id").alias("rid"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("right_id").alias("rid"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("x"))
    per_read = ends.groupBy("tree", "phase", "x.rid").agg(F.max("x.out").alias("o"), F.max("x.in").alias("i"))
    sets = per_read.groupBy("tree", "phase").agg(F.sum(F.col("o") * F.col("i")).alias("both"), F.count(F.lit(1)).alias("either"))
    sums = agree.groupBy("tree", "phase").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    pick = sets.join(sums, ["tree", "phase"]).groupBy("tree").agg(F.max_by("phase", F.struct("both", "either", "score", "n", "phase")).alias("phase"))
    final, _ = materialize(o.join(pick, "tree", "left").select("rid", "tree", (F.col("side") * F.coalesce("phase", F.lit(1))).cast("int").alias("orientation")), "orientations")
    f = lambda x: final.select(F.col("rid").alias(f"{x}_id"), F.col("orientation").alias(f"_{x}"))
    kept = e.join(f("left"), "left_id").join(f("right"), "right_id").where("_left = left_orientation and _right = right_orientation").drop("_left", "_right")
    conflicts = c.join(f("left"), "left_id").join(f("right"), "right_id").agg(F.count(F.lit(1)).alias("constraints"), F.count_if(F.col("_left") * F.col("_right") != F.col("parity")).alias("conflicts"))
    report = conflicts.crossJoin(final.agg(F.count_distinct("tree").alias("components"), F.count(F.lit(1)).alias("reads"))).crossJoin(kept.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score")))  # one row each
    return final.select("rid", "orientation"), kept, report


def contained_reads(reads: DataFrame, evidence: DataFrame) -> DataFrame:
    """``rid``, ``reason``: reads with evidence of lying in a strictly longer one; the container by identity, alignment length, length and id."""
    a, b = reads.select(F.col("rid").alias("contained_id"), F.length("seq").alias("_n")), reads.select(F.col("rid").alias("container_id"), F.length("seq").alias("_m"))
    d = evidence.join(a, "contained_id").join(b, "container_id").where("_n < _m and contained_id <> container_id")
    best = d.groupBy("contained_id").agg(F.max(F.struct(F.coalesce("identity", F.lit(-1.0)).alias("i"), "alignment_length", F.col("_m"), "container_id")).alias("b"))
    return best.select(F.col("contained_id").alias("rid"), F.concat(F.lit("contained_in:"), "b.container_id").alias("reason"))


def covered_reads(reads: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """``rid``, ``reason``: all reads of a group of full coverage but the longest, then the one with most edges, then the largest id."""
    known = reads.select("rid", F.length("seq").alias("n"))
    links = evidence.join(known.select(F.col("rid").alias("first_id")), "first_id", "left_semi").join(known.select(F.col("rid").alias("second_id")), "second_id", "left_semi")
    groups = weak_components(links.select(F.col("first_id").alias("source"), F.col("second_id").alias("target")))
    inner = edges.join(known.select(F.col("rid").alias("left_id")), "left_id", "left_semi").join(known.select(F.col("rid").alias("right_id")), "right_id", "left_semi")
    degree = inner.select(F.explode(F.array("left_id", "right_id")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("d"))
    g = groups.withColumnRenamed("node", "rid").join(known, "rid").join(degree, "rid", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    keep = g.groupBy("component").agg(F.max(F.struct("n", "d", "rid")).alias("k")).select("component", F.col("k.rid").alias("kept"))
    return g.join(keep, "component").where("rid <> kept").select("rid", F.concat(F.lit("full_coverage_with:"), "kept").alias("reason"))


def unsupported_reads(reads: DataFrame, edges: DataFrame, min_in: int = 1, min_out: int = 1) -> DataFrame:
    """``rid``, ``reason``: reads with fewer different neighbours in or out than asked, in one pass."""
    if min_in < 0 or min_out < 0:
        raise ValueError("minima must not be negative")
    known = reads.select("rid").distinct()
    e = edges.join(known.withColumnRenamed("rid", "left_id"), "left_id", "left_semi").join(known.withColumnRenamed("rid", "right_id"), "right_id", "left_semi")
    e = e.select("left_id", "right_id", "left_orientation", "right_orientation").distinct()
    outs, ins = e.groupBy(F.col("left_id").alias("rid")).agg(F.count(F.lit(1)).alias("o")), e.groupBy(F.col("right_id").alias("rid")).agg(F.count(F.lit(1)).alias("i"))
    d = known.join(outs, "rid", "left").join(ins, "rid", "left")
    no_in, no_out = F.coalesce("i", F.lit(0)) < min_in, F.coalesce("o", F.lit(0)) < min_out
    why = F.when(no_in & no_out, "low_quality:no_in_or_out_support").when(no_in, "low_quality:no_in_support").when(no_out, "low_quality:no_out_support")
    return d.select("rid", why.alias("reason")).where("reason is not null")


def without_reads(reads: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads and edges without the given reads."""
    g = gone.select("rid")
    return reads.join(g, "rid", "left_anti"), edges.join(g.withColumnRenamed("rid", "left_id"), "left_id", "left_anti").join(g.withColumnRenamed("rid", "right_id"), "right_id", "left_anti")


def degree_table(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``node`` with ``out_degree`` and ``in_degree`` (different neighbours)."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    o, i = e.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("out_degree")), e.groupBy(F.col("t").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return o.join(i, "node", "full_outer").select("node", zero("out_degree"), zero("in_degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Every three edges (``source``, ``target``, ``shift``) that join the same three nodes, whatever their directions: ``a``, ``b``, ``c``, each a struct of the edge.

    Each triangle is found at its node of the smallest degree: edges are held by their end of the smaller degree, at which at most the square root of twice the edges end, so hot nodes pair nothing.
    """
    e = edges.where("source <> target").select("source", "target", "shift").distinct()
    pair = e.select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"), F.struct("source", "target", "shift").alias("e"))
    degree = pair.select("x", "y").distinct().select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    d = lambda c: degree.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    p = pair.join(d("x"), "x").join(d("y"), "y")
    first = F.struct("nx", "x") < F.struct("ny", "y")
    held, _ = materialize(p.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("low"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("high"), "x", "y", "e"), "held")
    left, right = held.select("low", F.col("high").alias("u"), F.col("e").alias("a")), held.select("low", F.col("high").alias("v"), F.col("e").alias("b"))
    wedge = left.join(right, "low").where("u < v").select(F.col("u").alias("x"), F.col("v").alias("y"), "a", "b")
    return wedge.join(held.select("x", "y", F.col("e").alias("c")), ["x", "y"]).select("a", "b", "c")


def transitive_edges(edges: DataFrame, tolerance: int) -> DataFrame:
    """Edges i-k (``source``, ``target``, ``shift``) that i-j and j-k explain: their shifts add up to within ``tolerance``."""
    def explained(z: str, x: str, y: str) -> Column:
        joins = (F.col(f"{x}.source") == F.col(f"{z}.source")) & (F.col(f"{x}.target") == F.col(f"{y}.source")) & (F.col(f"{y}.target") == F.col(f"{z}.target"))
        return F.when(joins & (F.abs(F.col(f"{z}.shift") - F.col(f"{x}.shift") - F.col(f"{y}.shift")) <= tolerance), F.col(z))

    roles = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")]
    hit = triangles(edges).select(F.explode(F.array_compact(F.array(*[explained(*r) for r in roles]))).alias("e"))
    return hit.select("e.source", "e.target", "e.shift").distinct()


def forced_edges(edges: DataFrame) -> DataFrame:
    """Edges whose source has no other successor and whose target no other predecessor, without self loops."""
    e = edges.select("source", "target").where("source <> target").distinct()
    one_out, one_in = e.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("source"), e.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("target")
    return e.join(one_out, "source", "left_semi").join(one_in, "target", "left_semi")


def unitigs(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node``, ``head`` and ``position`` (from 0) of the chains of forced edges; nodes on closed chains are left out.

    Every node points to its predecessor and doubles its reach in each round (pointer jumping), so rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    f = forced_edges(edges)
    nodes = f.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    p = nodes.join(f.select(F.col("target").alias("node"), F.col("source").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("d"), F.col("up").isNull().alias("root"))
    p, path = materialize(p, "chains")
    open_before = -1
    for _ in range(rounds):
        top = p.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("root").alias("top"))
        new = p.join(top, "up").select("node", F.col("up2").alias("up"), F.when(F.col("root"), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"), "root", "top")
        new, new_path = materialize(new, "chains")
        drop(spark, path)
        p, path = new.drop("top"), new_path
        still = new.where("not top").count()  # nodes whose pointer wasn't at a head yet; those on closed chains never are
        if still == open_before or not still:
            break
        open_before = still
    heads = p.where("root").select(F.col("node").alias("up"))
    return p.join(heads, "up", "left_semi").select("node", F.col("up").alias("head"), F.col("d").alias("position"))


def contract_unitigs(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Edges between chains (each named by its head) and remaining nodes; edges inside a chain vanish."""
    m = lambda c, x: chains.select(F.col("node").alias(c), F.col("head").alias(x))
    d = edges.select("source", "target").join(m("source", "s"), "source", "left").join(m("target", "t"), "target", "left")
    d = d.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), F.col("s").isNotNull().alias("a"), F.col("t").isNotNull().alias("b"))
    return d.where("not (source = target and a and b)").select("source", "target").distinct()


def remove_tips(edges: DataFrame, nodes: DataFrame, max_length: int, max_coverage: float, rounds: int = 100) -> DataFrame:
    """Nodes (``node``, ``length``, ``coverage``) that stay when dead ends that are short and thin are removed, again until none is left."""
    spark, path, e_path = edges.sparkSession, None, None
    e = edges.select("source", "target").distinct()
    n = nodes.count()
    for _ in range(rounds):
        d = nodes.join(degree_table(e), "node", "left")
        dead = (F.coalesce("in_degree", F.lit(0)) == 0) | (F.coalesce("out_degree", F.lit(0)) == 0)
        keep = d.where(~(dead & (F.col("length") <= max_length) & (F.col("coverage") < max_coverage))).select("node", "length", "coverage")
        new, new_path = materialize(keep, "nodes")
        rest = e.join(new.select(F.col("node").alias("source")), "source", "left_semi").join(new.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")
        e, new_e = materialize(rest, "edges")
        for old in (path, e_path):
            if old:
                drop(spark, old)
        nodes, path, e_path = new, new_path, new_e
        before, n = n, nodes.count()
        if n == before:
            drop(spark, e_path)
            return nodes
    raise RuntimeError(f"tips still vanish after {rounds} rounds")


def equal_bubbles(edges: DataFrame, nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """Pairs of single branches between the same two nodes whose sequences are equal: ``source``, ``sink``, ``kept`` and ``dropped`` (the larger name).

    ``nodes`` has node and seq; branches are nodes with one predecessor and one successor, or chains of them as given by ``chains`` (spelled by joining their sequences, without
    the overlaps where ``edges`` has ``overlap_len``; of parallel edges the longest counts).
    """
    e = edges.select("source", "target").where("source <> target").distinct()
    placed = nodes.join(chains, "node", "left").select("node", F.coalesce("head", "node").alias("branch"), F.coalesce("position", F.lit(0)).alias("position"), "seq")
    if "overlap_len" in edges.columns:
        c = lambda x, p: chains.select(F.col("node").alias(x), F.col("head").alias("_" + x), F.col("position").alias(p))
        into = edges.join(c("source", "_p"), "source").join(c("target", "_q"), "target").where("_source = _target and _q = _p + 1").groupBy(F.col("target").alias("node")).agg(F.max("overlap_len").alias("_k"))
        placed = placed.join(into, "node", "left").withColumn("seq", F.substring("seq", F.coalesce("_k", F.lit(0)).cast("int") + 1, F.length("seq")))
    spelled = placed.select("branch", "position", "seq")
    spelled = spelled.groupBy("branch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "seq"))), lambda x: x["seq"]), "").alias("spelled"))
    c = contract_unitigs(e, chains)
    d = degree_table(c).where("in_degree = 1 and out_degree = 1").select(F.col("node").alias("branch"))
    b = d.join(c.select(F.col("target").alias("branch"), F.col("source").alias("a")), "branch").join(c.select(F.col("source").alias("branch"), F.col("target").alias("z")), "branch").join(spelled, "branch").where("a <> z")
    low = b.groupBy("a", "z", "spelled").agg(F.min("branch").alias("kept"))
    return b.join(low, ["a", "z", "spelled"]).where("branch <> kept").select(F.col("a").alias("source"), F.col("z").alias("sink"), "kept", F.col("branch").alias("dropped"))


def simple_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Strong components whose nodes have one edge in and one out inside: ``component``, ``nodes``, ``cycle`` (array, from the smallest node).

    The edge into the smallest node is left out; positions along the rest, a chain, come by pointer doubling. Self loops don't count.
    """
    c = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"c{x[0]}"))
    e = edges.select("source", "target").where("source <> target").distinct().join(c("source"), "source").join(c("target"), "target").where("cs = ct")
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    d = degree_table(e.select("source", "target")).join(components, "node").groupBy("component").agg(F.max(F.greatest("in_degree", "out_degree")).alias("m"))
    good = sizes.join(d.where("m = 1"), "component").select("component", "nodes")
    arcs = e.join(good, F.col("cs") == F.col("component")).where("target <> component").select("source", "target")
    along = unitigs(arcs).join(good, F.col("head") == F.col("component"))
    return along.groupBy("component", "nodes").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "node"))), lambda x: x["node"]).alias("cycle"))


def contract_components(edges: DataFrame, components: DataFrame, prefix: str = "block:") -> DataFrame:
    """Edges between components of two nodes or more, as one node each, and remaining nodes, with the original ends (ports) kept."""
    big = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    m = components.join(big, "component", "left_semi")
    s, t = m.select(F.col("node").alias("source"), F.concat(F.lit(prefix), "component").alias("s")), m.select(F.col("node").alias("target"), F.concat(F.lit(prefix), "component").alias("t"))
    d = edges.join(s, "source", "left").join(t, "target", "left")
    d = d.where("not (s is not null and s <=> t)")
    return d.select(F.coalesce("s", "source").alias("src"), F.coalesce("t", "target").alias("dst"), F.col("source").alias("src_port"), F.col("target").alias("dst_port"))


def split_cycle(cycle: Column, entry: Column, exit_: Column) -> Column:
    """The part of a cycle (array) from an entry to an exit port; null if either isn't on it."""
    n, i, j = F.size(cycle), F.array_position(cycle, entry).cast("int"), F.array_position(cycle, exit_).cast("int")
    twice = F.concat(cycle, cycle)
    return F.when((i > 0) & (j > 0), F.slice(twice, i, F.pmod(j - i, n) + 1))


def repeat_blocks(edges: DataFrame, threshold: int) -> DataFrame:
    """Components of two or more among the nodes with at least ``threshold`` neighbours both in and out: ``node``, ``component``."""
    hubs = degree_table(edges).where((F.col("in_degree") >= threshold) & (F.col("out_degree") >= threshold)).select("node")
    e = edges.select("source", "target").join(hubs.withColumnRenamed("node", "source"), "source", "left_semi").join(hubs.withColumnRenamed("node", "target"), "target", "left_semi")
    w = weak_components(e.select("source", "target").where("source <> target"))
    return w.join(w.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "component", "left_semi").select("node", "component")


def boundary_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``source``, ``target`` and ``kind`` (internal, incoming, outgoing) of the edges at each region; ``members`` has region and node."""
    s, t = members.select(F.col("node").alias("source"), F.col("region").alias("rs")), members.select(F.col("node").alias("target"), F.col("region").alias("rt"))
    e = edges.select("source", "target").distinct().join(s, "source", "left").join(t, "target", "left")
    inside = F.array(F.struct(F.col("rs").alias("region"), F.lit("internal").alias("kind")))
    both = F.when(F.col("rs").isNotNull() & F.col("rt").isNotNull() & (F.col("rs") == F.col("rt")), inside).otherwise(
        F.array_compact(F.array(F.when(F.col("rs").isNotNull(), F.struct(F.col("rs").alias("region"), F.lit("outgoing").alias("kind"))), F.when(F.col("rt").isNotNull(), F.struct(F.col("rt").alias("region"), F.lit("incoming").alias("kind")))))
    )
    return e.select("source", "target", F.explode(both).alias("b")).select("b.region", "source", "target", "b.kind")


def compress_region(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Macro edges of each region: every incoming with every outgoing boundary edge. ``region``, ``source``, ``entry``, ``exit``, ``target``."""
    b = boundary_edges(edges, members)
    i = b.where("kind = 'incoming'").select("region", "source", F.col("target").alias("entry"))
    o = b.where("kind = 'outgoing'").select("region", F.col("source").alias("exit"), "target")
    return i.join(o, "region")


def macro_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """What :func:`compress_region` would give, counted without forming it: ``region``, ``macro_edges``, ``entries``, ``exits``; regions without edges in or out have none."""
    b = boundary_edges(edges, members)
    i = b.where("kind = 'incoming'").groupBy("region").agg(F.count(F.lit(1)).alias("i"), F.count_distinct("target").alias("entries"))
    o = b.where("kind = 'outgoing'").groupBy("region").agg(F.count(F.lit(1)).alias("o"), F.count_distinct("source").alias("exits"))
    return i.join(o, "region").select("region", (F.col("i") * F.col("o")).alias("macro_edges"), "entries", "exits")


def reachable(edges: DataFrame, start: DataFrame, rounds: int = 1000) -> DataFrame:
    """``region``, ``node``: what can be reached from the start nodes (``region``, ``node``) of each region, these included."""
    spark = edges.sparkSession
    e = edges.select("source", "target").distinct()
    first = start.select("region", "node").distinct()
    seen, path = materialize(first.withColumn("fresh", F.lit(True)), "reached")
    for _ in range(rounds):
        step = seen.where("fresh").withColumnRenamed("node", "source").join(e, "source").select("region", F.col("target").alias("node")).distinct().withColumn("come", F.lit(True))
        both = seen.join(step, ["region", "node"], "full_outer").select("region", "node", F.col("fresh").isNull().alias("fresh"))
        new, new_path = materialize(both, "reached")
        drop(spark, path)
        seen, path = new, new_path
        if seen.where("fresh").isEmpty():
            return seen.select("region", "node")
    raise RuntimeError(f"still reaching after {rounds} rounds")


def close_regions(edges: DataFrame, members: DataFrame, block: int = 512, largest: int = 1_000_000) -> DataFrame:
    """Regions grown by every node on a path that leaves and comes back: ``region``, ``node``.

    These are the nodes that can be reached from what a region leads to and that reach what leads into it; no path leaves the grown region and comes back. Paths stay within weak components, so each is
    swept for ``block`` of its regions at a time, one bit a region, along its strong components and back; components of over ``largest`` edges are followed round by round.
    """
    m, _ = materialize(members.select("region", "node").where("region is not null and node is not null").distinct(), "members")
    e, _ = materialize(edges.where("source is not null and target is not null").select("source", "target").distinct(), "edges")
    parts, _ = materialize(weak_components(e), "parts")
    held = m.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("k"))
    at = lambda x: held.select(F.col("node").alias(x), F.col("k").alias(f"k_{x}"))
    inner = e.join(parts.withColumnRenamed("node", "source"), "source").join(at("source"), "source", "left").join(at("target"), "target", "left").na.fill(0, ["k_source", "k_target"])
    owned = m.join(parts, "node")
    sizes = inner.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = owned.groupBy("component").agg(F.ceil(F.count_distinct("region") / block).cast("int").alias("blocks"))
    todo, _ = materialize(blocks.join(sizes, "component"), "blocks")
    small = todo.where(F.col("n") <= largest).select("component", "blocks")
    arcs = inner.join(small, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("region"), "source", "target", "k_source", "k_target")
    own = owned.join(small, "component").select("component", F.pmod(F.xxhash64("region"), F.col("blocks")).cast("int").alias("block"), "region", F.col("node").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(0).alias("k_source"), F.lit(0).alias("k_target"))
    grown = arcs.unionByName(own).groupBy("component", "block").applyInPandas(_grown_regions, "region string, node string")
    done = m.unionByName(grown)
    big = todo.where(F.col("n") > largest).select("component")
    if big.isEmpty():
        return done
    e = inner.join(big, "component", "left_semi").select("source", "target")
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    b, path = materialize(boundary_edges(e, m).where("kind <> 'internal'"), "boundary")
    out = reachable(e, b.where("kind = 'outgoing'").select("region", F.col("target").alias("node")))
    into = reachable(back, b.where("kind = 'incoming'").select("region", F.col("source").alias("node")))
    drop(edges.sparkSession, path)
    return done.unionByName(out.join(into, ["region", "node"], "left_semi")).distinct()


def _grown_regions(d: pd.DataFrame) -> pd.DataFrame:
    """Of one weak component and some regions: the nodes that each region grows by. Rows with a ``region`` are its members, the others edges, with the number of regions that hold their ends."""
    from .solve import strong_parts

    inside = d["region"].notna()
    arcs, own = d[~inside], d[inside]
    if own.empty:
        return pd.DataFrame({"region": [], "node": []}, dtype=object)
    numbers, names = pd.factorize(pd.concat([arcs["source"], arcs["target"]]))
    u, v = numbers[: len(arcs)].tolist(), numbers[len(arcs) :].tolist()
    of, regions = pd.factorize(own["region"])
    held = [0] * len(names)
    for x, r in zip(pd.Index(names).get_indexer(own["source"]).tolist(), of.tolist()):
        held[x] |= 1 << r
    part = strong_parts(len(names), zip(u, v)).tolist()
    leads, comes = [0] * len(names), [0] * len(names)  # by strong component: regions that reach it, regions that it reaches
    after: dict[int, set[int]] = {}
    for x, y, k_x, k_y in zip(u, v, arcs["k_source"].tolist(), arcs["k_target"].tolist()):
        leads[part[y]] |= held[x] & ~held[y] if k_y == 1 else held[x]
        comes[part[x]] |= held[y] & ~held[x] if k_x == 1 else held[y]
        if part[x] != part[y]:
            after.setdefault(part[x], set()).add(part[y])
    waits = [0] * len(names)
    for s in after.values():
        for y in s:
            waits[y] += 1
    order = [c for c in set(part) if not waits[c]]
    for c in order:
        for y in after.get(c, ()):
            leads[y] |= leads[c]
            waits[y] -= 1
            if not waits[y]:
                order.append(y)
    for c in reversed(order):
        for y in after.get(c, ()):
            comes[c] |= comes[y]
    which, nodes = [], []
    for x, c in enumerate(part):
        new = leads[c] & comes[c] & ~held[x]
        if new:
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes((len(regions) + 7) // 8, "little"), np.uint8), bitorder="little"))
            which.append(bits)
            nodes.append(np.full(len(bits), x))
    if not which:
        return pd.DataFrame({"region": [], "node": []}, dtype=object)
    return pd.DataFrame({"region": np.asarray(regions, object)[np.concatenate(which)], "node": np.asarray(names, object)[np.concatenate(nodes)]})


def safe_unitigs(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """The ``chains`` of :func:`unitigs` that hold no cycle of the graph they come from, that is, no edge from a place to the same or an earlier one."""
    at = lambda x: chains.select(F.col("node").alias(x), F.col("head").alias(f"h{x[0]}"), F.col("position").alias(f"p{x[0]}"))
    back = edges.select("source", "target").join(at("source"), "source").join(at("target"), "target").where("hs = ht and ps >= pt").select(F.col("hs").alias("head")).distinct()
    return chains.join(back, "head", "left_anti").select("node", "head", "position")


def map_nodes(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """``node`` and ``mapped``: the node that stands for each after contraction, itself where it is in no chain."""
    return nodes.select("node").join(chains.select("node", "head"), "node", "left").select("node", F.coalesce("head", "node").alias("mapped"))


def prune_macros(edges: DataFrame, solved: DataFrame) -> DataFrame:
    """Macro edges (``macro`` and further columns) without those that ``solved`` (macro, status) found infeasible; others stay, also unsolved ones."""
    return edges.join(solved.where("status = 'INFEASIBLE'").select("macro"), "macro", "left_anti")


def broken_regions(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``region``: regions that cut a lower block. ``blocks`` lists the edges (block, source, target) of each block, ``members`` region and node.

    A region may hold all edges of a block or touch none; a block of one edge may also have just one end inside.
    """
    end = lambda x: members.select("region", F.col("node").alias(x)).distinct()
    b, _ = materialize(blocks.select("block", "source", "target").distinct(), "blocks")
    sizes = b.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    ends = b.join(end("source"), "source").select("region", "block", "source", "target", F.lit(1).alias("e")).unionByName(b.join(end("target"), "target").select("region", "block", "source", "target", F.lit(1).alias("e")))
    touched = ends.groupBy("region", "block", "source", "target").agg(F.sum("e").alias("ends"))
    g = touched.groupBy("region", "block").agg(F.count_if(F.col("ends") == 2).alias("inside"), F.count(F.lit(1)).alias("touching")).join(sizes, "block")
    return g.where("inside <> n and not (n = 1 and inside = 0)").select("region").distinct()


def supported_regions(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``region``: regions all of whose nodes can be reached from an entry and reach an exit within the region."""
    m = members.select("region", "node").distinct()
    b, _ = materialize(boundary_edges(edges, m), "boundary")
    name = lambda node: F.concat_ws("\x00", "region", node)
    inner = b.where("kind = 'internal'").select(name("source").alias("source"), name("target").alias("target"))
    start = lambda kind, end: b.where(f"kind = '{kind}'").select(F.lit(0).alias("region"), name(end).alias("node")).distinct()
    on = reachable(inner, start("incoming", "target")).join(reachable(inner.select(F.col("target").alias("source"), F.col("source").alias("target")), start("outgoing", "source")), ["region", "node"], "left_semi").select("node")
    good = m.select("region", name("node").alias("node")).join(on.withColumn("ok", F.lit(1)), "node", "left")
    return good.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("k")).where("n = k").select("region")


def region_tiers(edges: DataFrame, members: DataFrame, preferred: int, hard: int) -> DataFrame:
    """Size of each region's macro-edge model and the tier in which it would be solved: ``region``, ``variables`` (a macro edge each), ``couplings`` (pairs of inner edges with an end in common on the same side), ``degree`` (mean number of couplings), ``tier``.

    Tiers: 0, the region is acyclic; 1, at most ``preferred`` variables; 2, at most ``hard``; 99, more.
    """
    m = members.select("region", "node").distinct()
    inner, _ = materialize(boundary_edges(edges, m).where("kind = 'internal' and source <> target").select("region", "source", "target"), "inner")
    name = lambda c: F.concat_ws("\x00", "region", c).alias(c)
    core, core_path, _ = cyclic_core(inner.select(name("source"), name("target")))
    cyclic = core.select(F.split_part("source", F.lit("\x00"), F.lit(1)).alias("region")).distinct().withColumn("c", F.lit(True))
    pairs = None
    for side in ("source", "target"):
        k = inner.groupBy("region", side).agg(F.count(F.lit(1)).alias("k")).select("region", (F.col("k") * (F.col("k") - 1) / 2).cast("bigint").alias("p"))
        pairs = k if pairs is None else pairs.unionByName(k)
    v, p = inner.groupBy("region").agg(F.count(F.lit(1)).alias("variables")), pairs.groupBy("region").agg(F.sum("p").alias("couplings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    d = m.select("region").distinct().join(v, "region", "left").join(p, "region", "left").join(cyclic, "region", "left").select("region", zero("variables"), zero("couplings"), F.coalesce("c", F.lit(False)).alias("c"))
    tier = F.when(~F.col("c"), 0).when(F.col("variables") <= preferred, 1).when(F.col("variables") <= hard, 2).otherwise(99)
    out, _ = materialize(d.select("region", "variables", "couplings", F.when(F.col("variables") > 0, 2 * F.col("couplings") / F.col("variables")).otherwise(0.0).alias("degree"), tier.alias("tier")), "tiers")
    drop(edges.sparkSession, core_path)
    return out
