"""Compression of overlap graphs in stages, and exact solving of what is left.

Nodes are ``node``, ``seq``, ``coverage``, ``members``; edges ``source``, ``target``, ``overlap_len``, ``identity``, ``internal`` and ``paf_line``. Every stage is a
transform of the two tables; a table of counts per stage is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from . import graph as G
from .overlap import contained_sequences
from .scoring import top_per_node
from .solve import strong_parts


@dataclass(frozen=True)
class CompressConfig:
    min_overlap: int = 0
    min_identity: float = 0.0
    top_k: int | None = None
    shift_tolerance: int = 0
    tip_length: int | None = None
    tip_coverage: float = 1.5
    contract_components: bool = True
    repeat_degree: int | None = None


def merge_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of equal, non-empty sequence become the smallest of them: coverage is summed, members are joined, edges follow, self loops vanish."""
    has = F.col("seq").isNotNull() & (F.col("seq") != "")
    low = nodes.where(has).groupBy("seq").agg(F.min("node").alias("kept"), F.sum("coverage").alias("coverage"), F.flatten(F.sort_array(F.collect_list("members"))).alias("members"))
    renamed = nodes.where(has).join(low.select("seq", "kept"), "seq").select("node", "kept")
    merged = low.select(F.col("kept").alias("node"), "seq", "coverage", "members").unionByName(nodes.where(~has).select("node", "seq", "coverage", "members"))
    return merged, _rename(edges, renamed)


def _rename(edges: DataFrame, names: DataFrame) -> DataFrame:
    s, t = names.select(F.col("node").alias("source"), F.col("kept").alias("_s")), names.select(F.col("node").alias("target"), F.col("kept").alias("_t"))
    d = edges.join(s, "source", "left").join(t, "target", "left").withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")}).drop("_s", "_t")
    return d.where("source <> target")


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")


def _best_parallel(edges: DataFrame) -> DataFrame:
    key = F.struct((F.col("identity") * 1000 + F.col("overlap_len")).alias("s"), (-F.col("paf_line")).alias("p"))
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.groupBy("source", "target").agg(F.max_by(F.struct(*rest), key).alias("b")).select("source", "target", "b.*")


def compress(nodes: DataFrame, edges: DataFrame, c: CompressConfig) -> tuple[DataFrame, DataFrame, list[tuple[str, int, int]]]:
    """All stages in order: duplicates, contained, quality, internal, parallel, top k, transitive, unitigs, tips, bubbles, components, repeats. Gives nodes, edges and counts (stage, nodes, edges)."""
    counts: list[tuple[str, int, int]] = []

    def stage(name: str, n: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
        n, e = materialize(n, "nodes")[0], materialize(e, "edges")[0]
        counts.append((name, n.count(), e.count()))
        return n, e

    n, e = stage("input", nodes.select("node", "seq", "coverage", "members"), edges)
    n, e = stage("duplicates", *merge_duplicates(n, e))
    gone = contained_sequences(n.where("seq is not null").select(F.col("node").alias("rid"), "seq")).select(F.col("rid").alias("node"))
    n = n.join(gone, "node", "left_anti")
    n, e = stage("contained", n, _within(e, n))
    n, e = stage("quality", n, e.where((F.col("overlap_len") >= c.min_overlap) & (F.col("identity") >= c.min_identity)))
    n, e = stage("internal", n, e.where("not internal"))
    n, e = stage("parallel", n, _best_parallel(e))
    if c.top_k is not None:
        n, e = stage("top_k", n, top_per_node(e, c.top_k, F.col("identity") * 1000 + F.col("overlap_len")))
    shifted = e.join(n.select(F.col("node").alias("source"), F.length("seq").cast("bigint").alias("_n")), "source").withColumn("shift", F.col("_n") - F.col("overlap_len")).drop("_n")
    n, e = stage("transitive", n, shifted.join(G.transitive_edges(shifted, c.shift_tolerance).select("source", "target"), ["source", "target"], "left_anti"))
    chains, _ = materialize(G.unitigs(e), "chains")
    n, e = stage("unitigs", *contract_chains(n, e, chains))
    if c.tip_length is not None:
        kept = G.remove_tips(e, n.select("node", F.length("seq").alias("length"), "coverage"), c.tip_length, c.tip_coverage)
        n = n.join(kept.select("node"), "node", "left_semi")
        n, e = stage("tips", n, _within(e, n))
    chains, _ = materialize(G.unitigs(e), "chains")
    same = G.equal_bubbles(e, n.select("node", "seq"), chains)
    branch = n.select("node").join(chains, "node", "left").select("node", F.coalesce("head", "node").alias("dropped"))
    n = n.join(branch.join(same.select("dropped").distinct(), "dropped", "left_semi").select("node"), "node", "left_anti")
    n, e = stage("bubbles", n, _within(e, n))
    if c.contract_components:
        n, e = stage("components", *_contract(n, e, G.strong_components(e), "scc:"))
    if c.repeat_degree is not None:
        n, e = stage("repeats", *_contract(n, e, G.repeat_blocks(e, c.repeat_degree), "repeat:"))
    n, e = stage("final", n, _best_parallel(e))
    return n, e, counts


def contract_chains(nodes: DataFrame, edges: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains become one node each, named by the head: sequences are joined by their overlaps in order (a group is one chain, as long as its sequence), coverage is averaged."""
    into = edges.select("source", "target", "overlap_len").join(chains.select(F.col("node").alias("source"), F.col("head").alias("_h"), F.col("position").alias("_p")), "source").join(chains.select(F.col("node").alias("target"), "head", "position"), "target").where("_h = head and position = _p + 1")
    parts = chains.join(nodes, "node").join(into.select(F.col("target").alias("node"), F.col("overlap_len").alias("k")), "node", "left")
    piece = F.when(F.col("position") == 0, F.col("seq")).otherwise(F.substring("seq", F.coalesce("k", F.lit(0)).cast("int") + 1, F.length("seq")))
    g = parts.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("position", piece.alias("s"), "members"))).alias("p"), F.avg("coverage").alias("coverage"))
    merged = g.select(F.col("head").alias("node"), F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"), "coverage", F.flatten(F.transform("p", lambda x: x["members"])).alias("members"))
    rest = nodes.join(chains.select("node"), "node", "left_anti")
    names = chains.select("node", F.col("head").alias("kept"))
    return rest.select("node", "seq", "coverage", "members").unionByName(merged), _rename(edges, names)


def _contract(nodes: DataFrame, edges: DataFrame, components: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    big = components.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component")
    names = components.join(big, "component", "left_semi").select("node", F.concat(F.lit(prefix), "component").alias("kept"))
    names, _ = materialize(names, "names")
    macro = names.join(nodes, "node").groupBy(F.col("kept").alias("node")).agg(F.lit(None).cast("string").alias("seq"), F.sum("coverage").alias("coverage"), F.flatten(F.sort_array(F.collect_list("members"))).alias("members"))
    rest = nodes.join(names.select("node"), "node", "left_anti").select("node", "seq", "coverage", "members")
    return rest.unionByName(macro.select("node", "seq", "coverage", "members")), _rename(edges, names)


def _from_arc(k: int, arcs: list[tuple[int, int]], near: list[list[tuple[int, int]]], least: int) -> Iterator[tuple[int, int, int]]:
    """Regions that arc ``k`` leads into: the arc out, the nodes as bits, and their number. Without the arc, the far side of a bridge is a run of the search's order."""
    u, a = arcs[k]
    depth, low, parent, order, ends = {a: 0}, {a: 0}, {a: -1}, [a], {}
    stack = [(a, iter(near[a]))]
    while stack:
        x, it = stack[-1]
        for y, i in it:
            if i == k:
                continue
            if y not in depth:
                depth[y], low[y], parent[y] = depth[x] + 1, depth[x] + 1, i
                order.append(y)
                stack.append((y, iter(near[y])))
                break
            if i != parent[x]:
                low[x] = min(low[x], depth[y])
        else:
            stack.pop()
            ends[x] = len(order)
            if stack:
                low[stack[-1][0]] = min(low[stack[-1][0]], low[x])
    bits = None
    for start, y in enumerate(order):
        i = parent[y]
        if not start or low[y] < depth[y] or arcs[i][1] != y:
            continue  # no bridge, or it leads back in
        size = len(order) - (ends[y] - start)
        if size < least:
            continue
        if bits is None:
            bits = [0]
            for x in order:
                bits.append(bits[-1] | 1 << x)
        inside = bits[-1] ^ bits[ends[y]] ^ bits[start]
        if not inside >> u & 1:
            yield i, inside, size


def _near(n: int, arcs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, (x, y) in enumerate(arcs):
        if x != y:
            near[x].append((y, i))
            near[y].append((x, i))
    return near


def _weak_parts(n: int, arcs: list[tuple[int, int]]) -> Iterator[tuple[list[int], list[int], list[tuple[int, int]]]]:
    """Weak components with an arc: their nodes, the numbers of their arcs, and these between places in the list of nodes; both keep their order."""
    near, of, nodes = _near(n, arcs), [-1] * n, []
    for root in range(n):
        if of[root] < 0:
            of[root] = len(nodes)
            todo = own = [root]
            for x in todo:
                for y, _ in near[x]:
                    if of[y] < 0:
                        of[y] = len(nodes)
                        own.append(y)
            nodes.append(sorted(own))
    held: list[list[int]] = [[] for _ in nodes]
    for k, (u, _) in enumerate(arcs):
        held[of[u]].append(k)
    for own, ks in zip(nodes, held):
        if ks:
            number = {v: p for p, v in enumerate(own)}
            yield own, ks, [(number[arcs[k][0]], number[arcs[k][1]]) for k in ks]


def two_terminal_regions(n: int, arcs: list[tuple[int, int]], least: int = 2) -> list[tuple[tuple[int, int], tuple[int, int], frozenset[int]]]:
    """Regions with exactly one edge in and one out: (edge in, edge out, nodes).

    Without one edge, a bridge of the rest that separates its end from its start closes a region; so each edge needs one search of its weak component for bridges, no search over pairs.
    """
    found = []
    for own, ks, inner in _weak_parts(n, arcs):
        near = _near(len(own), inner)
        for p, k in enumerate(ks):
            found += [(k, ks[i], frozenset(v for x, v in enumerate(own) if inside >> x & 1)) for i, inside, _ in _from_arc(p, inner, near, least)]
    return [(arcs[k], arcs[i], inside) for k, i, inside in sorted(found, key=lambda f: f[0])]


def two_terminal_sizes(n: int, arcs: list[tuple[int, int]], least: int = 2) -> tuple[int, int]:
    """How many :func:`two_terminal_regions` there are, and the nodes of the largest."""
    count = largest = 0
    for own, ks, inner in _weak_parts(n, arcs):
        near = _near(len(own), inner)
        for p in range(len(ks)):
            for _, _, size in _from_arc(p, inner, near, least):
                count, largest = count + 1, max(largest, size)
    return count, largest


class _Part:
    """A weak component of a graph that is partitioned: its nodes, and its two-terminal regions as [size, edge in, edge out, nodes as bits]."""

    def __init__(self, own: list[int], inner: list[tuple[int, int]]):
        self.nodes, self.place = list(own), {v: x for x, v in enumerate(own)}
        near, name = _near(len(own), inner), lambda arc: (own[arc[0]], own[arc[1]])
        self.regions = [[size, name(inner[p]), name(inner[i]), inside] for p in range(len(inner)) for i, inside, size in _from_arc(p, inner, near, 2)]

    def pack(self, region: list[int], block: int) -> None:
        """Make a region one node. Regions that hold it hold the block, those apart from it stay, others end. There are no new ones, as no two edges of the region lead to the same node outside."""
        gone, new = sum(1 << self.place[v] for v in region), len(self.nodes)
        self.nodes.append(block)
        self.place[block] = new
        within = set(region)
        swap = lambda arc: tuple(block if v in within else v for v in arc)
        kept = []
        for size, k, i, inside in self.regions:
            if inside & gone == gone and inside != gone:
                kept.append([size - len(region) + 1, swap(k), swap(i), inside ^ gone | 1 << new])
            elif not inside & gone:
                kept.append([size, swap(k), swap(i), inside])
        self.regions = kept
        for v in region:
            del self.place[v]

    def members(self, inside: int) -> list[int]:
        return sorted(v for v, x in self.place.items() if inside >> x & 1)


def choose_two_terminal(found: list[tuple], n: int, most: int) -> tuple | None:
    """Of two-terminal regions the one with most nodes among those of at most ``most``; if there is none, the one nearest to half of the ``n`` nodes; of equal ones the first."""
    small = [f for f in found if len(f[2]) <= most]
    if small:
        return max(small, key=lambda f: len(f[2]))
    return min(found, key=lambda f: abs(len(f[2]) - n / 2), default=None)


def two_terminal_partition(n: int, arcs: list[tuple[int, int]], most: int) -> list[tuple[int, list[int], tuple[int, int]]]:
    """Blocks that the two-terminal regions of a graph are packed into, one after another: number, the nodes or blocks it holds (blocks are numbered from n on), and its entry and exit.

    A chosen region of more than ``most`` nodes is partitioned itself first; it is packed once nothing smaller is left in it. A region becomes one node, with its edge in and its edge out.
    """
    blocks: list[tuple[int, list[int], tuple[int, int]]] = []
    out: dict[int, set[int]] = {}
    into: dict[int, set[int]] = {}

    def join(u: int, v: int) -> None:
        out.setdefault(u, set()).add(v)
        into.setdefault(v, set()).add(u)

    for u, v in arcs:
        if u != v:
            join(u, v)

    def arcs_of(nodes: set[int] | dict[int, int]) -> list[tuple[int, int]]:
        return sorted((u, v) for u in nodes for v in out.get(u, ()) if v in nodes)

    def start(nodes: set[int]) -> list:
        """A graph to be partitioned: how many nodes it has, and its weak components."""
        own = sorted(nodes)
        number = {v: x for x, v in enumerate(own)}
        return [len(own), [_Part([own[x] for x in part], inner) for part, _, inner in _weak_parts(len(own), [(number[u], number[v]) for u, v in arcs_of(nodes)])]]

    def best_of(n: int, parts: list[_Part]) -> tuple | None:
        """See :func:`choose_two_terminal`; first is by the edge in, then by the search from it."""
        small = max((r[0] for p in parts for r in p.regions if r[0] <= most), default=None)
        off = (lambda size: abs(size - small)) if small is not None else (lambda size: abs(size - n / 2))
        least = min((off(r[0]) for p in parts for r in p.regions), default=None)
        like = [(r[1], p, r) for p in parts for r in p.regions if off(r[0]) == least]
        if not like:
            return None
        first = min(k for k, _, _ in like)
        like = [(p, r) for k, p, r in like if k == first]
        if len(like) > 1:
            p, own = like[0][0], sorted(like[0][0].place)
            number = {v: x for x, v in enumerate(own)}
            named = arcs_of(p.place)
            inner = [(number[u], number[v]) for u, v in named]
            turn = {named[i]: t for t, (i, _, _) in enumerate(_from_arc(named.index(first), inner, _near(len(own), inner), 2))}
            like.sort(key=lambda x: turn[x[1][2]])
        return like[0]

    graphs = [start(set(range(n)))]  # the graph, and the regions within regions that are being partitioned
    tried: set[frozenset[int]] = set()
    while graphs:
        best = best_of(*graphs[-1])
        if best is None:
            graphs.pop()
            continue
        part, (size, entry, leave, bits) = best
        inside = part.members(bits)
        if size > most and frozenset(inside) not in tried:
            tried.add(frozenset(inside))  # partition it first
            graphs.append(start(set(inside)))
            continue
        name = n + len(blocks)
        blocks.append((name, inside, (entry[1], leave[0])))
        before = {u for v in inside for u in into.pop(v, ())}.difference(inside)
        after = {w for v in inside for w in out.pop(v, ())}.difference(inside)
        for u in before:
            out[u].difference_update(inside)
            join(u, name)
        for w in after:
            into[w].difference_update(inside)
            join(name, w)
        for g in graphs:
            for p in g[1]:
                if inside[0] in p.place:
                    p.pack(inside, name)
                    g[0] -= len(inside) - 1
    return blocks


def block_summary(n: int, blocks: list[tuple[int, list[int], tuple[int, int]]]) -> tuple[list[tuple[int, list[int]]], int]:
    """Of the blocks of :func:`two_terminal_partition`: those without a block in them, as number and nodes, and how deep blocks are nested."""
    depth: dict[int, int] = {}
    for name, inside, _ in blocks:  # inner blocks come first
        depth[name] = 1 + max((depth[v] for v in inside if v >= n), default=0)
    return [(name, inside) for name, inside, _ in blocks if depth[name] == 1], max(depth.values(), default=0)


def solve_hierarchy(n: int, arcs: list[tuple[int, int, float]], most: int = 14) -> tuple[str, list[int], float]:
    """Heaviest path through all nodes of a graph with cycles: status, order and weight.

    Strong components are regions; the heaviest path through all nodes of one is found for every pair of entry and exit (these are its
    macro edges): up to ``most`` nodes by subsets, beyond by :func:`path_between`. Regions in their only possible order are then joined by a sweep over exits. Status: ``FEASIBLE``, ``INFEASIBLE``, or,
    where larger regions were searched up to the bound of steps, ``FEASIBLE_NOT_PROVEN_BEST`` or ``UNKNOWN``.
    """
    weight: dict[tuple[int, int], float] = {}
    for u, v, w in arcs:
        if u != v:
            weight[u, v] = max(w, weight.get((u, v), w))
    label = strong_parts(n, weight).tolist()
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(label[i], []).append(i)
    proven = True
    into = {c: 0 for c in groups}
    across = {(label[u], label[v]) for u, v in weight if label[u] != label[v]}
    for _, c in across:
        into[c] += 1
    ready, order = [c for c in groups if not into[c]], []
    while ready:
        if len(ready) > 1:
            return "INFEASIBLE", [], 0.0
        c = ready.pop()
        order.append(c)
        for a, b in across:
            if a == c:
                into[b] -= 1
                if not into[b]:
                    ready.append(b)
    state: dict[int, tuple[float, list[int]]] | None = None
    for c in order:
        g = groups[c]
        best: dict[int, tuple[float, list[int]]] = {}
        for entry in g:
            if state is None:
                come = (0.0, [])
            else:
                options = [(w + weight[x, entry], p) for x, (w, p) in state.items() if (x, entry) in weight]
                if not options:
                    continue
                come = max(options, key=lambda o: o[0])
            if len(g) > most:
                for leave in g:
                    if leave != entry:
                        p, w, complete = path_between(g, weight, entry, leave)
                        proven = proven and complete
                        if p and (leave not in best or come[0] + w > best[leave][0]):
                            best[leave] = (come[0] + w, come[1] + p)
                continue
            at = {(1 << g.index(entry), entry): (0.0, [entry])}
            for _ in range(len(g) - 1):
                grown: dict[tuple[int, int], tuple[float, list[int]]] = {}
                for (mask, x), (w, p) in at.items():
                    for j, y in enumerate(g):
                        if not mask >> j & 1 and (x, y) in weight:
                            t = (w + weight[x, y], [*p, y])
                            key = (mask | 1 << j, y)
                            if key not in grown or t[0] > grown[key][0]:
                                grown[key] = t
                at = grown
            for (_, x), (w, p) in at.items():
                if x not in best or come[0] + w > best[x][0]:
                    best[x] = (come[0] + w, come[1] + p)
        if not best:
            return "INFEASIBLE" if proven else "UNKNOWN", [], 0.0
        state = best
    if not state:
        return "FEASIBLE", [], 0.0
    top = max(state.values(), key=lambda s: s[0])
    return "FEASIBLE" if proven else "FEASIBLE_NOT_PROVEN_BEST", top[1], top[0]


def path_between(nodes: list[int], weight: dict[tuple[int, int], float], entry: int, leave: int, steps: int = 20_000) -> tuple[list[int], float, bool]:
    """Heaviest path from ``entry`` to ``leave`` through all ``nodes``: path (empty if none was found), weight, and whether the search was complete within ``steps``.

    Depth first, heaviest edge first; a branch is cut where a node left can't be reached any more, or the heaviest edges into the nodes left can't beat the best path.
    """
    own = set(nodes)
    out = {u: sorted((v for v in own if (u, v) in weight), key=lambda v: weight[u, v]) for u in own}  # noqa: B023
    most = {v: max((weight[u, v] for u in own if (u, v) in weight), default=-math.inf) for v in own}
    best: list[int] = []
    top = -math.inf
    path, total, on = [entry], [0.0], {entry}
    hope = [sum(most[v] for v in own if v != entry)]
    ways = [list(out[entry])]
    while path:
        if not steps:
            return best, top if best else 0.0, False
        steps -= 1
        if not ways[-1]:
            on.discard(path.pop())
            for stack in (total, hope, ways):
                stack.pop()
            continue
        v = ways[-1].pop()
        if v in on or (v == leave) != (len(path) == len(own) - 1):
            continue
        w, h = total[-1] + weight[path[-1], v], hope[-1] - most[v]
        if len(path) == len(own) - 1:
            if w > top:
                best, top = [*path, v], w
            continue
        if w + h <= top:
            continue
        reach, todo = {v}, [v]
        while todo:
            for x in out[todo.pop()]:
                if x not in on and x not in reach:
                    reach.add(x)
                    todo.append(x)
        if len(reach) < len(own) - len(path):
            continue
        path.append(v)
        on.add(v)
        total.append(w)
        hope.append(h)
        ways.append(list(out[v]))
    return best, top if best else 0.0, True


def solve_models(graphs: DataFrame, most: int = 14) -> DataFrame:
    """:func:`solve_hierarchy` for every row ``model``, ``n``, ``arcs`` (array of li, ri, reward): ``model``, ``status``, ``nodes``, ``weight``, ``path``."""
    ship(graphs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples():
                s, path, w = solve_hierarchy(int(r.n), [(int(a["li"]), int(a["ri"]), float(a["reward"])) for a in r.arcs], most)
                rows.append((r.model, s, len(path), round(w, 6), path))
            yield pd.DataFrame(rows, columns=["model", "status", "nodes", "weight", "path"])

    return graphs.select("model", "n", "arcs").mapInPandas(run, "model string, status string, nodes bigint, weight double, path array<bigint>")


def region_scores(edges: DataFrame, members: DataFrame, node_weight: float = 1.0, edge_weight: float = 1.0, gain_weight: float = 1.0, children: int = 0, priority: Column | None = None) -> DataFrame:
    """Measures of regions and their priority as a block solved classically.

    With n nodes, e internal edges, a in and b out: ``edge_reduction`` = e+a+b-ab, ``gain`` = e + child ports - ab, ``benefit`` their weighted sum with n, ``score`` = benefit over
    max(1, ab) * max(1, n+e), or ``priority``, a Column over the others. Without boundary edges on a side a region has no macro edge.
    """
    b = G.boundary_edges(edges, members)
    k = lambda x: F.count_if(F.col("kind") == x)
    m = members.select("region", "node").distinct().groupBy("region").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("region").agg(k("internal").alias("e"), k("incoming").alias("a"), k("outgoing").alias("b")), "region", "left").na.fill(0)
    ab = F.col("a") * F.col("b")
    m = m.withColumns({"edge_reduction": F.col("e") + F.col("a") + F.col("b") - ab, "gain": F.col("e") + children - ab})
    m = m.withColumn("benefit", node_weight * F.col("n") + edge_weight * F.col("edge_reduction") + gain_weight * F.col("gain"))
    if priority is not None:
        return m.withColumn("score", priority.cast("double"))
    return m.withColumn("score", F.greatest(F.lit(1e-9), F.col("benefit")) / (F.greatest(F.lit(1), ab) * F.greatest(F.lit(1), F.col("n") + F.col("e"))))
