import random
from collections import Counter

from conftest import rows

from seqloom.operators.skew import hot_keys, join_states, two_step_walks

SCHEMA = "source string, target string, weight bigint, key string"


def data():
    rng = random.Random(2)
    node = lambda: rng.choice(["hot"] * 12 + [f"n{i}" for i in range(20)] + [None, ""])
    out = [(node(), node(), rng.choice([None, -2, 0, 5]), "k") for _ in range(400)]
    return out + out[:30]


def test_states_equal_the_join(spark):
    d = data()
    df = spark.createDataFrame(d, SCHEMA)
    out = {r.key: r for r in join_states(df, df, "target", "source", "weight", "weight").collect()}
    pairs = [(a[1], (a[2] or 0) + (b[2] or 0)) for a in d for b in d if a[1] and a[1] == b[0]]
    n, s = Counter(k for k, _ in pairs), Counter()
    for k, w in pairs:
        s[k] += w
    assert {k: (r.joined_n, r.joined_sum) for k, r in out.items() if r.joined_n} == {k: (n[k], s[k]) for k in n}
    assert None not in out and "" not in out


def test_hot_keys(spark):
    d = data()
    got = rows(hot_keys(spark.createDataFrame(d, SCHEMA), "source", "target", 25, 1000, "source", "target"))
    want = []
    for side, i in (("source", 0), ("target", 1)):
        want += [(side, k) for k, n in Counter(r[i] for r in d if r[i]).items() if n * 40 >= len(d)]
    assert got == sorted(want, key=repr)


def test_walks(spark):
    d = data()
    e = [(a, b, w or 0) for a, b, w, _ in d if a and b]
    n, s = Counter(), Counter()
    for a, b, w in e:
        for c, _, x in e:
            if b == c:
                n[a] += 1
                s[a] += w + x
    assert rows(two_step_walks(spark.createDataFrame(d, SCHEMA))) == sorted(((k, n[k], s[k]) for k in n), key=repr)


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert join_states(e, e, "source", "target").count() == 0
    assert hot_keys(e, "source", "target", 25, 1000, "s", "t").count() == 0
    assert two_step_walks(e).count() == 0


def test_joins_of_hot_keys_in_blocks(spark):
    from seqloom.operators.skew import blocked_join

    left = spark.createDataFrame([("hot", i) for i in range(9)] + [("b", 1), ("none", 2)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", i) for i in range(3)], "k string, y int")
    want = rows(left.join(right, "k"), "k", "x", "y")
    assert rows(blocked_join(left, right, "k", 7), "k", "x", "y") == want == rows(blocked_join(left, right, "k", 1000), "k", "x", "y")
    e = spark.createDataFrame([(f"s{i % 40}", "hot", i) for i in range(90)] + [("hot", f"t{i}", 1) for i in range(5)], "source string, target string, weight bigint")
    assert rows(two_step_walks(e, block=6)) == rows(two_step_walks(e))
