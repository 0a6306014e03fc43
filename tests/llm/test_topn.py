import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm.topn import top_n

SCHEMA = "source string, target string, weight bigint, identity double, line bigint"


def brute(data, n):
    groups = {}
    for r in set(data):
        if r[2] is not None:
            groups.setdefault(r[0], []).append(r)
    key = lambda r: (-r[2], r[3] is None, -(r[3] or 0), r[1], r[4])
    return sorted((r for g in groups.values() for r in sorted(g, key=key)[:n]), key=repr)


def run(df, n, **kw):
    out = top_n(df, ["source"], "weight", [F.col("identity").desc_nulls_last(), F.col("target").asc(), F.col("line").asc()], n, **kw)
    return sorted((tuple(r[c] for c in ("source", "target", "weight", "identity", "line")) for r in out.collect()), key=repr)


@pytest.mark.parametrize("few", [50_000, 0, 2])
def test_hot_group_ties_and_repeats(spark, few):
    rng = random.Random(1)
    data = [("hot", f"t{rng.randrange(40)}", rng.choice([5, 5, 5, 9, -3, 0]), rng.choice([None, 0.5, 0.9]), i) for i in range(1200)]
    data += [(rng.choice(["a", "b", None]), "t", rng.randrange(-9, 9), 0.1, i) for i in range(60)]
    data += [("all_tied", "t", 1, None, i % 5) for i in range(400)] + [("nulls", "t", None, 0.5, 1)]
    data += data[:300]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert run(df, 3, broadcast_rows=few) == brute(data, 3)


def test_repeats_cannot_lift_the_threshold(spark):
    data = [("g", "t", 100, 0.5, 1)] * 500 + [("g", "t", w, 0.5, w) for w in range(20)]
    assert run(spark.createDataFrame(data, SCHEMA), 3) == brute(data, 3)


def test_large_n_and_empty(spark):
    data = [("g", "t", w % 7, None, w) for w in range(300)]
    assert run(spark.createDataFrame(data, SCHEMA), 100) == brute(data, 100)
    assert run(spark.createDataFrame([], SCHEMA), 3) == []


def test_extra_columns_count_for_repeats_only_when_named(spark):
    df = spark.createDataFrame([("g", "t", 1, 0.5, 1, "x"), ("g", "t", 1, 0.5, 1, "y")], SCHEMA + ", rank string")
    names = ["source", "target", "weight", "identity", "line"]
    assert top_n(df, ["source"], "weight", [], 3, identity=names).count() == 1


def test_threshold_filters_small_groups(spark):
    from seqloom.llm.topn import score_bin, thresholds

    data = [("g", "t", w, None, w) for w in range(40)] + [("h", "t", w, None, w) for w in range(3)]
    df = spark.createDataFrame(data, SCHEMA)
    low = thresholds(df, ["source"], "weight", F.xxhash64("line"), 3).collect()
    assert [r.source for r in low] == ["g"]
    assert 3 <= df.where((F.col("source") == "g") & (score_bin(F.col("weight")) >= low[0].keep_bin)).count() < 40
    assert run(df, 3) == brute(data, 3)


def test_clashing_names_and_null_ties(spark):
    data = [("g", w % 5, None if w % 2 else "x", w) for w in range(60)] * 2
    df = spark.createDataFrame(data, "keep_bin string, group_rows bigint, bin string, rows bigint")
    got = top_n(df, ["keep_bin"], "group_rows", [F.col("bin").asc_nulls_last()], 4)
    assert sorted((r["rank"], r.group_rows, r.bin, r["rows"]) for r in got.collect()) == [(1, 4, "x", 4), (2, 4, "x", 14), (3, 4, "x", 24), (4, 4, "x", 34)]
