import itertools
import random

import pytest
from conftest import rows

from seqloom.operators import layout as L
from seqloom.operators import qubo as Q
from seqloom.operators import solve as V


@pytest.mark.parametrize("kind", L.KINDS)
def test_round_trip(kind):
    rng = random.Random(3)
    for n in range(1, 9):
        order = rng.sample(range(n), n)
        arcs = sorted({*zip(order, order[1:]), *[tuple(rng.sample(range(n), 2)) for _ in range(5) if n > 1]})
        ones = L.encode(kind, n, arcs, order)
        got = L.decode(kind, n, arcs, ones)
        assert got.order == order and got.valid(n)
        if len(ones) > 1:
            assert not L.decode(kind, n, arcs, ones[1:]).valid(n)


def test_encoding_rejects():
    with pytest.raises(ValueError):
        L.encode("edge_path", 3, [(0, 1)], [0, 1, 2])
    with pytest.raises(ValueError):
        L.encode("positions", 3, [], [0, 1, 1])
    assert L.encode("positions", 2, [], [1, 0]) == [1, 2]


def test_positions_fill_gaps():
    got = L.decode("positions", 3, [], [0 * 3 + 1, 2 * 3 + 1])  # reads 0 and 2 at position 1
    assert got.order == [1, 0, 2] and got.violations == 4
    assert L.decode("positions", 2, [], []).order == [0, 1]


def test_chains_and_cycles():
    arcs = [(0, 1), (2, 3), (3, 2), (1, 4)]
    got = L.decode("edge_path", 5, arcs, [0, 1, 2, 3])
    assert got.paths == [[0, 1, 4]] and got.cycles == [[2, 3]] and not got.valid(5)
    cover = L.decode("cycle_cover", 3, [(0, 1), (1, 0)], [0, 1, 2 + 2, 2 + 3 + 2])  # a cycle beside the void path
    assert cover.cycles == [[0, 1]] and cover.paths == [[2]] and not cover.violations and not cover.valid(3)


def test_ghost_places():
    arcs = [(0, 1), (1, 2), (0, 2)]
    ones = L.encode("ordered_path", 3, arcs, [0, 1, 2])
    assert L.decode("ordered_path", 3, arcs, sorted([*ones, 3 + 2 * 2])).violations == 1
    assert L.decode("ordered_path", 3, arcs, [v for v in ones if v != 3 + 2 + 1]).violations == 1


def test_edge_path_status():
    assert L.edge_path_status(3, [(0, 1), (1, 2), (2, 0)]) == "cyclic"
    assert L.edge_path_status(3, [(0, 1), (0, 2)]) == "no_hamilton_path"
    assert L.edge_path_status(3, [(0, 1), (0, 2)], False) == "ok"
    assert L.edge_path_status(3, [(0, 1), (1, 2)]) == "ok"


def test_solving_from_model_to_layout(spark):
    nodes = spark.createDataFrame([("a", i, 4, 3) for i in range(4)], "model string, idx bigint, n bigint, m bigint")
    edges = spark.createDataFrame([("a", 0, 1, 0, 0.5), ("a", 1, 2, 1, 0.5), ("a", 2, 3, 2, 0.5)], "model string, li bigint, ri bigint, var bigint, reward double")
    terms = Q.edge_path_model(nodes, edges).terms()
    got = L.solve_layouts(nodes, edges, terms, "edge_path", "exhaustive").collect()
    assert got[0].order == [0, 1, 2, 3] and got[0].valid and got[0].variables == 3 and got[0].energy == pytest.approx(-1.5)
    placed = L.solve_layouts(nodes, edges, Q.missing_edge_model(nodes, edges).terms(), "positions", "tabu", 1, polish=True).collect()[0]
    assert placed.missing_polished <= placed.missing and placed.missing_polished == 0
    with pytest.raises(ValueError):
        L.solve_layouts(nodes, edges, terms, "edge_path", "tabu", polish=True)
    trivial = L.solve_layouts(nodes, edges.limit(0), terms.limit(0), "edge_path", "tabu").collect()[0]
    assert trivial.order == [0, 1, 2, 3] and trivial.variables == 0 and trivial.energy is None
    assert L.solve_layouts(nodes.limit(0), edges.limit(0), terms.limit(0), "edge_path", "tabu").count() == 0


def test_searches_against_all_orders():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(2, 7)
        arcs = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.35]
        have = set(arcs)
        every = [p for p in itertools.permutations(range(n)) if all(a in have for a in zip(p, p[1:]))]
        assert sorted(V.all_hamilton_paths(n, arcs)) == sorted(map(list, every))
        status, cycle = V.hamilton_cycle(n, arcs)
        assert status == ("yes" if any((p[-1], p[0]) in have for p in every) else "no")
        if cycle:
            assert sorted(cycle) == list(range(n)) and all((a, b) in have for a, b in zip(cycle, cycle[1:] + cycle[:1]))
        best = (0, 0.0)
        w = {a: rng.random() for a in arcs}
        for k in range(2, n + 1):
            for p in itertools.permutations(range(n), k):
                ring = list(zip(p, p[1:] + p[:1]))
                if p[0] == min(p) and all(a in have for a in ring):
                    best = max(best, (k, sum(w[a] for a in ring)))
        path, weight, complete = V.longest_cycle(n, [(*a, w[a]) for a in arcs])
        assert complete and len(path) == best[0] and weight == pytest.approx(best[1])


def test_strong_parts_against_reachability():
    rng = random.Random(8)
    for _ in range(100):
        n = rng.randrange(1, 9)
        arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(12))]
        reach = [[i == j for j in range(n)] for i in range(n)]
        for a, b in arcs:
            reach[a][b] = True
        for k, i, j in itertools.product(range(n), repeat=3):
            reach[i][j] = reach[i][j] or reach[i][k] and reach[k][j]
        assert V.strong_parts(n, arcs).tolist() == [min(j for j in range(n) if reach[i][j] and reach[j][i]) for i in range(n)]


def test_search_gives_up_after_steps_alike():
    arcs = [(a, b) for a in range(12) for b in range(12) if a != b and (a + b) % 3]
    assert V.hamilton_cycle(12, arcs, 5) == V.hamilton_cycle(12, arcs, 5)
