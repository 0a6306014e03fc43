"""Layouts and samples of layout models: orders to samples, samples to orders, and solving from end to end.

A model has ``n`` reads and numbered edges; its sample is the set of variables that are 1. Kinds: ``positions`` (read i at position p is variable i*n+p), ``edge_path`` and
``assembly`` (a variable per edge), ``path_cover`` and ``cycle_cover`` (edges, then a source and a sink per read) and ``ordered_path`` (edges, the bits of their
places, sources and sinks). A model must fit one task; models are independent rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .solve import SAMPLERS, Model, best_dag_path, polish_arcs, strong_parts

KINDS = ("positions", "edge_path", "assembly", "path_cover", "cycle_cover", "ordered_path")


def place_bits(n: int) -> int:
    """Bits of an edge's place in an ordered path."""
    return max(1, int(np.ceil(np.log2(max(2, n)))))


@dataclass
class Layout:
    """A decoded sample: reads in order, the chains and cycles it consists of, and what is wrong with it."""

    order: list[int] = field(default_factory=list)
    paths: list[list[int]] = field(default_factory=list)
    cycles: list[list[int]] = field(default_factory=list)
    violations: int = 0

    def valid(self, n: int) -> bool:
        return not self.violations and not self.cycles and len(self.paths) <= 1 and len(self.order) == n


def encode(kind: str, n: int, arcs: list[tuple[int, int]], order: list[int]) -> list[int]:
    """The sample of an order of all reads. Raises if the order isn't one of all reads or, but for positions, the graph lacks an edge of it."""
    if sorted(order) != list(range(n)):
        raise ValueError("the order does not name every read once")
    if kind == "positions":
        return sorted(r * n + p for p, r in enumerate(order))
    number = {a: k for k, a in enumerate(arcs)}
    missing = [a for a in zip(order, order[1:]) if a not in number]
    if missing:
        raise ValueError(f"the graph has no edge {missing[0]}")
    edges, m = [number[a] for a in zip(order, order[1:])], len(arcs)
    if kind in ("edge_path", "assembly") or not order:
        return sorted(edges)
    if kind in ("path_cover", "cycle_cover"):
        return sorted([*edges, m + order[0], m + n + order[-1]])
    if kind != "ordered_path":
        raise ValueError(f"unknown kind {kind}")
    bits = place_bits(n)
    places = [m + e * bits + b for k, e in enumerate(edges) for b in range(bits) if k + 1 >> b & 1]
    return sorted([*edges, *places, m * (1 + bits) + order[0], m * (1 + bits) + n + order[-1]])


def _by_position(n: int, ones: list[int]) -> Layout:
    """The first unused read of every position; positions without one get the unused reads in order."""
    here: list[list[int]] = [[] for _ in range(n)]
    for v in sorted(ones):
        here[v % n].append(v // n)
    reads = np.bincount([v // n for v in ones], minlength=n) if ones else np.zeros(n, int)
    used: set[int] = set()
    order = []
    for some in here:
        r = next((r for r in some if r not in used), -1)
        used.add(r)
        order.append(r)
    left = iter([r for r in range(n) if r not in used])
    order = [r if r >= 0 else next(left) for r in order]
    return Layout(order, [order], [], int((reads != 1).sum()) + sum(len(some) != 1 for some in here))


def _chains(n: int, chosen: list[tuple[int, int]]) -> Layout:
    """Chains and cycles of chosen edges; of several edges from or into a read the first counts, the others are violations."""
    nxt, prev, wrong = [-1] * n, [-1] * n, 0
    for u, v in chosen:
        if nxt[u] >= 0 or prev[v] >= 0:
            wrong += 1
            continue
        nxt[u], prev[v] = v, u
    out, seen = Layout(violations=wrong), [False] * n
    for s in [v for v in range(n) if prev[v] < 0] + list(range(n)):
        if seen[s]:
            continue
        walk, v = [], s
        while v >= 0 and not seen[v]:
            seen[v] = True
            walk.append(v)
            v = nxt[v]
        (out.paths if prev[s] < 0 else out.cycles).append(walk)
    out.order = [v for p in (*out.paths, *out.cycles) for v in p]
    return out


def decode(kind: str, n: int, arcs: list[tuple[int, int]], ones: list[int]) -> Layout:
    """The order that a sample means, as far as it means one. ``valid`` tells whether it is a path through all reads without a violation.

    ``violations`` counts, besides edges that share an end: reads and positions not used once (positions); reads whose source, sink and edges don't make one way in and one out (covers, ordered
    path), and for the cycle cover, where a void read closes the path, sources or sinks other than one each; places of unchosen edges and places that don't rise by one (ordered path).
    """
    if kind == "positions":
        return _by_position(n, ones)
    m = len(arcs)
    chosen = [arcs[v] for v in sorted(ones) if v < m]
    out = _chains(n, chosen)
    if kind in ("edge_path", "assembly"):
        out.violations += abs(len(chosen) - max(0, n - 1))
        return out
    bits = place_bits(n) if kind == "ordered_path" else 0
    base = m * (1 + bits)
    ways_in, ways_out = np.zeros(n, int), np.zeros(n, int)
    for u, v in chosen:
        ways_out[u] += 1
        ways_in[v] += 1
    ends = [v - base for v in ones if v >= base]
    for e in ends:
        (ways_in if e < n else ways_out)[e % n] += 1
    out.violations = int((ways_in != 1).sum() + (ways_out != 1).sum())
    if kind != "path_cover":
        out.violations += abs(sum(e < n for e in ends) - min(1, n)) + abs(sum(e >= n for e in ends) - min(1, n))
    if kind == "ordered_path":
        place: dict[int, int] = {}
        for v in ones:
            if m <= v < base:
                place[(v - m) // bits] = place.get((v - m) // bits, 0) + (1 << (v - m) % bits)
        taken = {v for v in ones if v < m}
        out.violations += len(place.keys() - taken)
        ends_at = {arcs[e][1]: place.get(e, 0) for e in taken}
        out.violations += sum(place.get(e, 0) != ends_at.get(arcs[e][0], 0) + 1 for e in taken)
    return out


def edge_path_status(n: int, arcs: list[tuple[int, int]], need_path: bool = True) -> str:
    """Whether the edge-path model may be built: ``ok``, ``cyclic`` or, where asked for, ``no_hamilton_path``."""
    if any(u == v for u, v in arcs) or (strong_parts(n, arcs) != np.arange(n)).any():
        return "cyclic"
    if need_path and n and best_dag_path(n, [(u, v, 0.0) for u, v in arcs]) is None:
        return "no_hamilton_path"
    return "ok"


def edge_path_model(n: int, arcs: list[tuple[int, int, float]], count_penalty: float, degree_penalty: float) -> Model:
    """One edge-path model, put together within a task for sweeps over its penalties."""
    u, v, w = (np.array(c) for c in zip(*arcs)) if arcs else (np.empty(0, int),) * 3
    i, j = np.triu_indices(len(arcs), 1)
    pairs = 2 * count_penalty + degree_penalty * ((u[i] == u[j]).astype(float) + (v[i] == v[j]))
    return Model.from_arrays(count_penalty * (1 - 2 * (n - 1)) - w, i, j, pairs, count_penalty * (n - 1) ** 2)


def packed_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per model of numbered reads and edges: ``model``, ``n``, ``arcs`` (array of ``li``, ``ri``, ``reward`` in the order of the edge variables)."""
    n = nodes.groupBy("model").agg(F.max("n").alias("n"))
    arcs = edges.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("var", "li", "ri", "reward"))), lambda x: F.struct(x["li"].alias("li"), x["ri"].alias("ri"), x["reward"].alias("reward"))).alias("arcs"))
    none = F.lit([]).cast("array<struct<li:bigint,ri:bigint,reward:double>>")
    return n.join(arcs, "model", "left").withColumn("arcs", F.coalesce(F.col("arcs").cast("array<struct<li:bigint,ri:bigint,reward:double>>"), none))


def by_model(graphs: DataFrame, function: Callable, schema: str, *more: str) -> DataFrame:
    """Rows ``model`` and what ``function(n, arcs, ...)`` returns (a tuple, or a list of tuples) for every packed graph; ``more`` names further columns given to it. ``schema`` describes the tuple."""
    ship(graphs.sparkSession)
    kind = graphs.schema["model"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples():
                got = function(int(r.n), [(int(a["li"]), int(a["ri"]), float(a["reward"])) for a in r.arcs], *[getattr(r, c) for c in more])
                rows += [(r.model, *g) for g in (got if isinstance(got, list) else [got])]
            yield pd.DataFrame(rows, columns=["model", *[c.split()[0] for c in schema.split(", ")]])

    return graphs.select("model", "n", "arcs", *more).mapInPandas(run, f"model {kind}, {schema}")


def solve_layouts(nodes: DataFrame, edges: DataFrame, terms: DataFrame, kind: str, method: str, seed: int = 0, polish: bool = False, samplers: dict[str, Callable] | None = None) -> DataFrame:
    """From model to layout: samples every model, decodes the sample and, for positions, polishes the order.

    ``model``, ``reads``, ``variables``, ``energy`` (null without variables), ``ones``, ``order``, ``violations``, ``valid``, ``missing`` and ``missing_polished`` (neighbours
    without an edge before and after polishing). A model without variables has the trivial layout of its reads in order; one without reads is empty. Polishing moves reads, so it is
    refused for models of edges.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    if polish and kind != "positions":
        raise ValueError("only layouts by position can be polished")
    take = (samplers or SAMPLERS)[method]
    packed = terms.groupBy("model").agg(F.collect_list(F.struct("i", "j", "coeff")).alias("terms"))
    g = packed_graphs(nodes, edges).join(packed, "model", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<i:bigint,j:bigint,coeff:double>>")))

    def one(n: int, arcs: list, rows: list) -> tuple:
        m = Model([(int(t["i"]), int(t["j"]), float(t["coeff"])) for t in rows])
        pairs = [a[:2] for a in arcs]
        ones, energy = [], None
        if m.n:
            x, energy = take(m, seed)
            ones = [int(v) for v in np.flatnonzero(x)]
        out = decode(kind, n, pairs, ones) if m.n else Layout(list(range(n)), [list(range(n))] if n else [])
        have = set(pairs)
        lacks = lambda o: sum(a not in have for a in zip(o, o[1:]))
        order, before = out.order, lacks(out.order)
        if polish and n:
            order, _ = polish_arcs(order, have)
        return n, m.n, energy, ones, order, out.violations, out.valid(n), before, lacks(order)

    schema = "reads bigint, variables bigint, energy double, ones array<bigint>, order array<bigint>, violations bigint, valid boolean, missing bigint, missing_polished bigint"
    return by_model(g, one, schema, "terms")
