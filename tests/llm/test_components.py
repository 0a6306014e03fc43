import random

from conftest import rows

from seqloom.llm.components import connected_components, links_from


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return sorted(((min(g), x) for g in groups.values() for x in g), key=repr)


def run(spark, pairs, schema="a string, b string"):
    return rows(connected_components(links_from(spark.createDataFrame(pairs, schema), "a", "b")), "group_id", "read_id")


def test_random_graphs_nulls_and_repeats(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)]
    pairs += pairs[:9] + [(None, "n01"), ("n02", None), ("", "n03"), ("n04", "n04")]
    assert run(spark, pairs) == brute(pairs)


def test_long_chain_and_hot_star(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(130)]
    star = [("s", f"t{i:04}") for i in range(1500)]
    assert run(spark, chain + star) == brute(chain + star)


def test_empty(spark):
    assert run(spark, []) == []


def test_clashing_columns(spark):
    d = spark.createDataFrame([("a", "b", "x", "y", "z")], "a string, b string, big string, small string, group_id string")
    assert rows(connected_components(links_from(d, "a", "b"))) == [("a", "a"), ("a", "b")]
