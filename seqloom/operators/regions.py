"""Regions of small boundary in a graph, and hierarchies of them; one graph per task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


class RegionSearch:
    """Regions of small boundary of a graph that shrinks as regions become blocks; only what a new block touches is looked at again."""

    def __init__(self, arcs: Iterable[tuple[int, int]], ports: int, largest: int, width: int):
        self.ports, self.largest, self.width = ports, largest, width
        self.out: dict[int, set[int]] = {}
        self.into: dict[int, set[int]] = {}
        for u, v in arcs:
            self._join(u, v)
        self.found: dict[frozenset[int], float] = {}
        self.seen: set[frozenset[int]] = set()
        for u in sorted(self.out):
            for v in sorted(self.out[u]):
                self.grow(u, v)

    def _join(self, u: int, v: int) -> None:
        for x in (u, v):
            self.out.setdefault(x, set())
            self.into.setdefault(x, set())
        self.out[u].add(v)
        self.into[v].add(u)

    def boundary(self, region: frozenset[int]) -> tuple[int, int, int]:
        """Edges inside, into and out of a region, from its own nodes only."""
        inside = sum(len(self.out[v] & region) for v in region)
        return inside, sum(len(self.into[v]) for v in region) - inside, sum(len(self.out[v]) for v in region) - inside

    def score(self, region: frozenset[int]) -> float:
        """Nodes and edges saved by making a region one block, over the work of solving it for every pair of ports; 0 without an edge in or out."""
        e, a, b = self.boundary(region)
        if not a or not b:
            return 0.0
        benefit = len(region) + (e + a + b - a * b) + (e - a * b)
        return max(0.0, benefit) / (a * b * (len(region) + e))

    def grow(self, u: int, v: int) -> None:
        """Regions from an edge, by a beam that keeps the smallest boundaries."""
        beam = [frozenset((u, v))] if u != v else []
        while beam:
            fresh: set[frozenset[int]] = set()
            for r in beam:
                if r in self.seen:
                    continue
                self.seen.add(r)
                _, a, b = self.boundary(r)
                if 0 < a <= self.ports and 0 < b <= self.ports:
                    self.found[r] = self.score(r)
                if len(r) < self.largest:
                    near = set().union(*(self.out[y] | self.into[y] for y in r)) - r
                    fresh |= {r | {x} for x in near}
            beam = sorted(fresh - self.seen, key=lambda r: (sum(self.boundary(r)[1:]), sorted(r)))[: self.width]

    def ranked(self) -> list[tuple[frozenset[int], float]]:
        """Best score first, then smaller regions, then by members."""
        return sorted(self.found.items(), key=lambda x: (-x[1], len(x[0]), sorted(x[0])))

    def best(self) -> frozenset[int] | None:
        """The first of :meth:`ranked` that saves anything and isn't the whole graph."""
        good = [(-s, len(r), sorted(r), r) for r, s in self.found.items() if s > 0 and len(r) < len(self.out)]
        return min(good)[3] if good else None

    def pack(self, region: frozenset[int], name: int) -> None:
        """Make a region one node; parallel edges become one."""
        sources = {u for v in region for u in self.into[v]} - region
        targets = {w for v in region for w in self.out[v]} - region
        for v in region:
            for w in self.out.pop(v):
                self.into.get(w, set()).discard(v)
            for u in self.into.pop(v):
                self.out.get(u, set()).discard(v)
        self.out[name], self.into[name] = set(), set()
        for u in sources:
            self._join(u, name)
        for w in targets:
            self._join(name, w)
        near = sources | targets
        for r in [r for r in self.found if r & region or r & near]:
            del self.found[r]
            if not r & region:
                _, a, b = self.boundary(r)
                if 0 < a <= self.ports and 0 < b <= self.ports:
                    self.found[r] = self.score(r)
        for u in sorted(sources):
            self.grow(u, name)
        for w in sorted(targets):
            self.grow(name, w)


def region_score(region: frozenset[int], arcs: list[tuple[int, int]]) -> float:
    """See :meth:`RegionSearch.score`."""
    s = RegionSearch([], 0, 0, 0)
    for u, v in arcs:
        s._join(u, v)
    return s.score(region)


def bounded_regions(n: int, arcs: list[tuple[int, int]], ports: int = 4, largest: int = 12, width: int = 6) -> list[tuple[frozenset[int], float]]:
    """Regions with at most ``ports`` edges in and out each, grown from every edge by a beam that keeps the ``width`` smallest boundaries; best score first, then smaller, then by members. Parallel edges count once."""
    return RegionSearch(arcs, ports, largest, width).ranked()


def build_hierarchy(n: int, arcs: list[tuple[int, int]], ports: int = 4, largest: int = 12, width: int = 6) -> list[tuple[int, int, list[int], int, int, int]]:
    """Blocks made one after the other of the best region while one saves anything: (level, block, members, edges inside, in, out); members may be earlier blocks, numbered from n."""
    blocks, search = [], RegionSearch({(u, v) for u, v in arcs if u != v}, ports, largest, width)
    while (region := search.best()) is not None:
        blocks.append((len(blocks), n + len(blocks), sorted(region), *search.boundary(region)))
        search.pack(region, n + len(blocks) - 1)
    return blocks


def hierarchies(graphs: DataFrame, ports: int = 4, largest: int = 8) -> DataFrame:
    """:func:`build_hierarchy` for every row ``model``, ``n``, ``arcs`` (array of li, ri): ``model``, ``level``, ``block``, ``members``, ``inside``, ``entries``, ``exits``."""
    ship(graphs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples():
                arcs = [(int(a["li"]), int(a["ri"])) for a in r.arcs]
                rows += [(r.model, *b) for b in build_hierarchy(int(r.n), arcs, ports, largest)]
            yield pd.DataFrame(rows, columns=["model", "level", "block", "members", "inside", "entries", "exits"])

    return graphs.select("model", "n", "arcs").mapInPandas(run, "model string, level bigint, block bigint, members array<bigint>, inside bigint, entries bigint, exits bigint")
