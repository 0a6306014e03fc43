import random

from conftest import rows

from seqloom.operators.intervals import periods_and_gaps, unwrap_circular


def brute(data):
    out, per = [], {}
    for e, s, t in data:
        if e is not None and s is not None and t is not None and s < t:
            per.setdefault(e, []).append((s, t))
    for e, xs in per.items():
        merged = []
        for s, t in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out += [(e, "covered", s, t) for s, t in merged]
        out += [(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def test_against_merging(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "a", "b"]), s := rng.randrange(600), s + rng.randrange(-2, 12)) for _ in range(300)]
    data += data[:40] + [(None, 1, 2), ("a", None, 4), ("a", 4, None), ("n", 5, 5), ("touch", 0, 5), ("touch", 5, 9), ("nest", 0, 50), ("nest", 10, 20), ("far", 10**9, 10**9 + 5), ("far", 0, 1)]
    d = spark.createDataFrame([(*x, "q") for x in data], "entity string, start bigint, end bigint, kind string")
    for width in (7, 4096):
        assert rows(periods_and_gaps(d, width), "entity", "kind", "pos_start", "pos_end") == brute(data)


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], "entity string, start bigint, end bigint")).count() == 0


def test_circles(spark):
    d = spark.createDataFrame([("c", 90, 110), ("c", 95, 100), ("c", 0, 250), ("c", 130, 140), ("l", 90, 110), ("z", 1, 9)], "entity string, start bigint, end bigint")
    n = spark.createDataFrame([("c", 100), ("z", 0)], "entity string, length bigint")
    assert rows(unwrap_circular(d, n), "entity", "start", "end") == sorted([("c", 90, 100), ("c", 0, 10), ("c", 95, 100), ("c", 0, 100), ("c", 30, 40), ("l", 90, 110), ("z", 1, 9)], key=repr)
