import itertools
import random

import pytest
from conftest import rows

from seqloom.operators import qubo as Q
from seqloom.operators import regions as H
from seqloom.operators import solve as V


def test_regions_keep_their_limits():
    rng = random.Random(4)
    arcs = sorted({*((i, i + 1) for i in range(11)), *((rng.randrange(12), rng.randrange(12)) for _ in range(5))})
    found = H.bounded_regions(12, arcs, ports=2, largest=5)
    assert found
    for r, s in found:
        a = sum(u not in r and v in r for u, v in arcs)
        b = sum(u in r and v not in r for u, v in arcs)
        assert 1 <= a <= 2 and 1 <= b <= 2 and 2 <= len(r) <= 5 and s >= 0
    assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_hierarchy_ends_and_nests():
    blocks = H.build_hierarchy(6, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], ports=1, largest=3)
    assert blocks and [b[1] for b in blocks] == list(range(6, 6 + len(blocks)))
    members = list(itertools.chain(*(b[2] for b in blocks)))
    assert len(members) == len(set(members))
    assert H.build_hierarchy(3, []) == []


def test_hierarchies_table(spark):
    long = [(i, i + 1) for i in range(600)] + [(0, 1)] * 50
    d = spark.createDataFrame([("a", 2, [(0, 1)]), ("big", 601, long)], "model string, n bigint, arcs array<struct<li:bigint,ri:bigint>>")
    got = H.hierarchies(d).collect()
    assert {r.model for r in got} == {"big"}
    inner = [m for r in got for m in r.members]
    assert len(inner) == len(set(inner)) and sorted(r.block for r in got) == list(range(601, 601 + len(got)))


def test_packing_keeps_what_a_new_search_would_find():
    rng = random.Random(9)
    arcs = sorted({(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(26)) if a != b})
    s = H.RegionSearch(arcs, 3, 5, 6)
    r = s.best()
    s.pack(r, 14)
    left = sorted({(14 if u in r else u, 14 if v in r else v) for u, v in arcs} - {(14, 14)})
    assert {(u, v) for u in s.out for v in s.out[u]} == set(left)
    for region, score in s.found.items():
        assert score == H.region_score(region, left)


def graph(spark, n, arcs):
    nodes = spark.createDataFrame([("m", f"n{i}", i) for i in range(n)], "model string, node string, pos int")
    pairs = spark.createDataFrame([("m", f"n{a}", f"n{b}", w) for a, b, w in arcs], "model string, left string, right string, reward double")
    return Q.number_graph(nodes, pairs)


def test_macro_edge_and_circle_models(spark):
    nodes, edges = graph(spark, 4, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 2, 5.0), (2, 1, 1.0), (1, 3, 1.0), (3, 0, 9.0)])
    var = {(r.li, r.ri): r["var"] for r in edges.collect()}
    ports = spark.createDataFrame([("m", 0, 3)], "model string, entry bigint, exit bigint")
    x, e = V.exhaustive(V.Model([(r.i, r.j, r.coeff) for r in Q.macro_edge_model(nodes, edges, ports).terms().collect()]))
    assert {k for k, v in var.items() if x[v]} == {(0, 2), (2, 1), (1, 3)} and e == pytest.approx(-7.0)
    x, _ = V.exhaustive(V.Model([(r.i, r.j, r.coeff) for r in Q.circle_model(nodes, edges).terms().collect()]))
    assert {k for k, v in var.items() if x[v]} == {(0, 2), (2, 1), (1, 3), (3, 0)}


def test_boundary_states(spark):
    s = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 4.0), ("m", 2, 2.0)], "model string, var bigint, weight double")
    x, e = V.exhaustive(V.Model([(r.i, r.j, r.coeff) for r in Q.boundary_state_model(s, 20.0).terms().collect()]))
    assert list(x) == [0, 1, 0] and e == pytest.approx(-4.0)


def test_order_violations(spark):
    _, edges = graph(spark, 3, [(0, 1, 1.0), (1, 2, 1.0)])
    at = {(r.li, r.ri): r["var"] for r in edges.collect()}
    bit = lambda e, k: 2 + at[e] * 2 + k
    good = [("m", v) for v in (0, 1, bit((1, 2), 0))]
    one = lambda s: rows(Q.order_violations(spark.createDataFrame(s, "model string, var bigint"), edges, 2), "ghost_bits", "order_violations")
    assert one(good) == [(0, 0)]
    assert one([("m", 0), ("m", 1)]) == [(0, 1)]
    assert one([("m", at[0, 1]), ("m", bit((1, 2), 1))]) == [(1, 0)]
