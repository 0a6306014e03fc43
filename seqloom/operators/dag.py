"""Levels and longest paths of acyclic graphs, cuts of circular layouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, materialize, ship
from .graph import _fixpoint_sign
from .ranking import running_before


#: Rounds of an iteration that one job holds.
_STEPS = 4


def path_levels(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """``node`` and ``level``, the edges of the longest path that ends there. Raises on a cycle.

    Each round relaxes all edges at once, four rounds a job, so rounds are the longest path's edges; a level beyond the number of nodes proves a cycle.
    """
    spark = edges.sparkSession
    e, e_path = materialize(edges.select("source", "target").distinct(), "edges")
    n = e.select(F.explode(F.array("source", "target")).alias("node"))
    if nodes is not None:
        n = n.unionByName(nodes.select("node"))
    state, path = materialize(n.distinct().withColumn("level", F.lit(0).cast("bigint")), "levels")
    size, sign = state.count(), None
    for _ in range(0, min(rounds, size + 1) + _STEPS, _STEPS):
        new = state
        for _ in range(_STEPS):  # several levels a job
            come = e.join(new.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.max(F.col("level") + 1).alias("c"))
            new = new.join(come, "node", "left").select("node", F.greatest("level", F.coalesce("c", F.lit(0))).alias("level"))
        new, new_path = materialize(new, "levels")
        drop(spark, path)
        state, path = new, new_path
        now = _fixpoint_sign(state, "node", "level")
        if now == sign:
            drop(spark, e_path)
            return state
        sign = now
    if size == 0:
        return state
    raise ValueError("the graph has a cycle" if rounds > size else f"levels still change after {rounds} rounds")


def longest_path(edges: DataFrame) -> DataFrame:
    """One row ``edges``: the number of edges of the longest path of an acyclic graph."""
    return path_levels(edges).agg(F.coalesce(F.max("level"), F.lit(0)).alias("edges"))


def cut_crossings(spans: DataFrame, entity: str) -> DataFrame:
    """``entity``, ``cut`` and ``crossing``: intervals (``lo`` < ``hi``) that reach over each cut, the cuts lying before the positions where an interval begins or ends.

    A difference array: +1 at lo+1, -1 at hi+1, summed up by position over buckets.
    """
    one = spans.select(entity, F.explode(F.array(F.struct((F.col("lo") + 1).alias("cut"), F.lit(1).cast("bigint").alias("d")), F.struct((F.col("hi") + 1).alias("cut"), F.lit(-1).cast("bigint").alias("d")))).alias("x"))
    d = one.groupBy(entity, F.col("x.cut").alias("cut")).agg(F.sum("x.d").alias("d"))
    return running_before(d, [entity], "cut", "d").select(entity, "cut", (F.col("before") + F.col("d")).alias("crossing"))


def shift_layout(edges: DataFrame, anchors: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``entity``, ``node``, ``position``: least sum of positive shifts from the anchor of each entity (Bellman-Ford rounds; the least shift of a pair counts).

    ``edges`` has entity, source, target, shift, ``anchors`` entity, node. Nodes out of reach are left out.
    """
    spark = edges.sparkSession
    e, e_path = materialize(edges.where("shift > 0").groupBy("entity", "source", "target").agg(F.min("shift").alias("shift")), "shifts")
    state, path = materialize(anchors.select("entity", "node", F.lit(0).cast("bigint").alias("position")), "positions")
    sign = None
    for _ in range(0, rounds + _STEPS, _STEPS):
        new = state
        for _ in range(_STEPS):
            come = e.join(new.withColumnRenamed("node", "source"), ["entity", "source"]).select("entity", F.col("target").alias("node"), (F.col("position") + F.col("shift")).alias("position"))
            new = new.unionByName(come).groupBy("entity", "node").agg(F.min("position").alias("position"))
        new, new_path = materialize(new, "positions")
        drop(spark, path)
        state, path = new, new_path
        now = _fixpoint_sign(state, "entity", "node", "position")
        if now == sign:
            drop(spark, e_path)
            return state
        sign = now
    raise RuntimeError(f"positions still change after {rounds} rounds")


def circumference(edges: DataFrame, layout: DataFrame, anchors: DataFrame) -> DataFrame:
    """``entity``, ``circumference``: the shortest way from the anchor back to it."""
    back = edges.where("shift > 0").join(anchors.select("entity", F.col("node").alias("target")), ["entity", "target"], "left_semi")
    d = back.join(layout.withColumnRenamed("node", "source"), ["entity", "source"])
    return d.groupBy("entity").agg(F.min(F.col("position") + F.col("shift")).alias("circumference"))


def rebase_layout(edges: DataFrame, layout: DataFrame, circle: DataFrame) -> DataFrame:
    """``entity``, ``node``, ``position``, ``wraps``: the layout counted from the node before which fewest edges run, of equal ones the first; ``wraps`` is their number. Positions are taken modulo the circumference.

    An edge runs forward from its source to its target, round the circle (``entity``, ``circumference``) where the target lies before. Counts come from a difference array over positions.
    """
    layout, _ = materialize(layout.join(circle, "entity").select("entity", "node", F.pmod(F.col("position"), F.col("circumference")).alias("position")), "places")
    p = lambda x: layout.select("entity", F.col("node").alias(x), F.col("position").alias(f"_{x}"))
    e = edges.select("entity", "source", "target").distinct().join(p("source"), ["entity", "source"]).join(p("target"), ["entity", "target"]).join(circle, "entity").where("_source <> _target")
    span = lambda lo, hi: F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    s, t, c = F.col("_source"), F.col("_target"), F.col("circumference")
    arcs = e.select("entity", F.explode(F.when(t > s, F.array(span(s, t))).otherwise(F.array(span(s, c), span(F.lit(-1), t)))).alias("a"))
    step = lambda at, d: F.struct(at.alias("pos"), F.lit(d).cast("bigint").alias("d"))
    events = arcs.select("entity", F.explode(F.array(step(F.col("a.lo") + 1, 1), step(F.col("a.hi") + 1, -1))).alias("x")).select("entity", "x.pos", "x.d", F.lit(0).alias("node"))
    points = events.unionByName(layout.select("entity", F.col("position").alias("pos"), F.lit(0).cast("bigint").alias("d"), F.lit(1).alias("node")))
    d = points.groupBy("entity", "pos").agg(F.sum("d").alias("d"), F.max("node").alias("node"))
    over = running_before(d, ["entity"], "pos", "d").where("node = 1").select("entity", "pos", (F.col("before") + F.col("d")).alias("crossing"))
    best = over.groupBy("entity").agg(F.min(F.struct("crossing", "pos")).alias("b")).select("entity", "b.crossing", "b.pos")
    j = layout.join(best, "entity").join(circle, "entity")
    return j.select("entity", "node", F.pmod(F.col("position") - F.col("pos"), F.col("circumference")).alias("position"), F.col("crossing").alias("wraps"))


def residuals(edges: DataFrame, layout: DataFrame, circle: DataFrame) -> DataFrame:
    """``entity``, ``residual``, ``n``: edges by how far their shift is from the layout, modulo the circumference."""
    p = lambda x: layout.select("entity", F.col("node").alias(x), F.col("position").alias(f"_{x}"))
    d = edges.join(p("source"), ["entity", "source"]).join(p("target"), ["entity", "target"]).join(circle, "entity")
    return d.groupBy("entity", F.pmod(F.col("shift") - (F.col("_target") - F.col("_source")), F.col("circumference")).alias("residual")).agg(F.count(F.lit(1)).alias("n"))


def circular_windows(layout: DataFrame, size: int) -> DataFrame:
    """``entity``, ``node``, ``window``: consecutive windows of about ``size`` nodes by position, balanced so that their sizes differ by one at most."""
    from .ranking import entity_rank

    r = entity_rank(layout, ["entity"], "position", ["node"])
    count = F.greatest(F.lit(1), F.round(F.col("rank_n") / size).cast("bigint"))
    return r.select("entity", "node", "position", F.floor(F.col("rank") * count / F.col("rank_n")).cast("bigint").alias("window"))


def port_cuts(crossing: np.ndarray, target: int, least: int | None = None, most: int | None = None) -> list[int]:
    """Where to cut n nodes in a row into windows of about ``target`` (the last value is n): ``crossing`` counts, for each of the n+1 places, the edges over it.

    Lexicographically least: the largest product of the crossings at both ends of a window, then the sum of the products, of the crossings at the cuts, and of the differences of the sizes
    from the target. First the least possible largest product is found, then sums are minimised without going over it, so the result is a true minimum. If no sizes fit, windows are balanced.
    """
    n = len(crossing) - 1
    if n < 1:
        return []
    count = max(1, -(-n // target))
    least = min(max(2, int(0.7 * target)) if least is None else least, n // count)
    most = max(max(least, -(-6 * target // 5)) if most is None else most, -(-n // count))
    sizes = np.arange(max(1, least), most + 1)

    def fill(limit: float) -> list[np.ndarray] | None:
        """Best predecessor of every place after 1, 2, ... windows, with no product over the limit."""
        cost = np.full((n + 1, 3), np.inf)
        cost[0] = 0
        back = []
        for b in range(count):
            new, come = np.full((n + 1, 3), np.inf), np.full(n + 1, -1)
            for i in range(1, n + 1) if b < count - 1 else [n]:
                j = i - sizes
                j = j[(j >= 0)]
                product = crossing[j] * crossing[i]
                ok = (product <= limit) & np.isfinite(cost[j, 0])
                if not ok.any():
                    continue
                j, product = j[ok], product[ok]
                c = cost[j] + np.stack([product, np.full(len(j), crossing[i] if i < n else 0), np.abs(i - j - target)], axis=1)
                k = np.lexsort((j, c[:, 2], c[:, 1], c[:, 0]))[0]
                new[i], come[i] = c[k], j[k]
            cost = new
            back.append(come)
        return back if np.isfinite(cost[n, 0]) else None

    tries = np.unique(np.multiply.outer(np.unique(crossing), np.unique(crossing)))
    low, high = 0, len(tries) - 1
    if fill(tries[-1]) is None:
        return [(k + 1) * (n // count) + min(k + 1, n % count) for k in range(count)]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fill(tries[mid]) is not None else (mid + 1, high)
    cuts = [n]
    for come in reversed(fill(tries[low])):
        cuts.append(int(come[cuts[-1]]))
    return cuts[-2::-1]


def port_windows(layout: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """``entity``, ``node``, ``position``, ``window``: windows of about ``size`` nodes by position, cut where few edges cross (see :func:`port_cuts`). A layout must fit one task.

    ``edges`` has entity, source and target; edges that lead back to an earlier place go round the circle and cross its beginning.
    """
    from .ranking import entity_rank

    ship(layout.sparkSession)
    r, _ = materialize(entity_rank(layout.select("entity", "node", "position"), ["entity"], "position", ["node"]).select("entity", "node", "position", "rank", "rank_n"), "ranks")
    at = lambda c: r.select("entity", F.col("node").alias(c), F.col("rank").alias(f"r{c}"))
    e = edges.select("entity", "source", "target").join(at("source"), ["entity", "source"]).join(at("target"), ["entity", "target"])
    arcs = e.groupBy("entity").agg(F.collect_list(F.struct("rsource", "rtarget")).alias("arcs"))
    sizes = r.groupBy("entity").agg(F.max("rank_n").alias("n")).join(arcs, "entity", "left")

    def run(parts):
        for p in parts:
            rows = []
            for g in p.itertuples():
                n, diff, wraps = int(g.n), np.zeros(int(g.n) + 2, np.int64), 0
                for a in g.arcs if g.arcs is not None else ():
                    u, v = int(a["rsource"]), int(a["rtarget"])
                    if v > u:
                        diff[u + 1] += 1
                        diff[v + 1] -= 1
                    elif v < u:
                        wraps += 1
                crossing = np.cumsum(diff[: n + 1])
                crossing[0] = crossing[n] = wraps
                rows.append((g.entity, port_cuts(crossing, size), [int(c) for c in crossing]))
            yield pd.DataFrame(rows, columns=["entity", "cuts", "crossing"])

    cuts = sizes.mapInPandas(run, "entity string, cuts array<bigint>, crossing array<bigint>")
    w = F.size(F.filter("cuts", lambda c: c <= F.col("rank"))).cast("bigint")
    return r.join(cuts, "entity").select("entity", "node", "position", w.alias("window"), "cuts", "crossing")


def window_graph(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Edges with at least one end in a window: ``entity``, ``window``, ``source``, ``target``, ``core`` (both ends are in it)."""
    w = lambda x: windows.select("entity", F.col("node").alias(x), F.col("window").alias(f"w{x}"))
    d = edges.select("entity", "source", "target").distinct().join(w("source"), ["entity", "source"]).join(w("target"), ["entity", "target"])
    inside = F.array_distinct(F.array("wsource", "wtarget"))
    return d.select("entity", F.explode(inside).alias("window"), "source", "target", (F.col("wsource") == F.col("wtarget")).alias("core"))


def expand_macros(children: DataFrame, roots: DataFrame, depth: int = 100) -> DataFrame:
    """``root`` and ``leaf`` in order (``path``, an array of sequence numbers): macro edges replaced by their children until only original edges are left.

    ``children`` has macro, seq and child; a child that isn't a macro is an original edge.
    """
    spark = children.sparkSession
    c, _ = materialize(children.select("macro", "seq", "child"), "children")  # read again by the result
    open_ = roots.select(F.col("root"), F.col("root").alias("leaf"), F.array().cast("array<bigint>").alias("path"))
    done = None
    for _ in range(depth):
        open_, _ = materialize(open_, "open")
        j = open_.join(c, F.col("leaf") == F.col("macro"), "left")
        ends = j.where("macro is null").select("root", "leaf", "path")
        done = ends if done is None else done.unionByName(ends)
        open_ = j.where("macro is not null").select("root", F.col("child").alias("leaf"), F.concat("path", F.array(F.col("seq").cast("bigint"))).alias("path"))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"macros are nested more than {depth} deep")
