import itertools
import random

import numpy as np
import pytest

from seqloom.llm.bases import canonical_set
from seqloom.llm.near_duplicates import class_report, covering_masks, expand_pairs, keys_of, near_duplicates, pack, sketches, table_keys, unpack


def similar(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        i = rng.randrange(len(s))
        k = rng.randrange(3)
        if k == 0:
            s[i] = rng.choice("ACGT")
        elif k == 1:
            s.insert(i, rng.choice("ACGT"))
        else:
            del s[i]
    return "".join(s)


def brute(data):
    sets = {}
    for rid, seq in data:
        if rid is not None and len(canonical_set(seq, 21)):
            sets[rid] = set(canonical_set(seq, 21).tolist())
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]))


def run(spark, data, **kw):
    df = spark.createDataFrame([(r, s, "x") for r, s in data], "rid string, seq string, id string")
    links, members = near_duplicates(df, "rid", "seq", **kw)
    return sorted((r.id_a, r.id_b) for r in expand_pairs(links, members, block=7).collect()), links, members


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_radius(radius):
    m = covering_masks(radius)
    for wrong in itertools.combinations(range(m.shape[1]), radius):
        assert any(not row[list(wrong)].any() for row in m)


def test_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(8)]
    data = [(f"r{i:03}", similar(rng, base[i % 8], rng.randrange(0, 9))) for i in range(64)]
    data += [("copy1", base[0]), ("copy2", base[0].lower()), ("copy3", base[0]), ("copy3", base[0])]
    turned = base[1][::-1].translate(str.maketrans("ACGT", "TGCA"))
    data += [("turned", turned), ("none", None), ("empty", ""), ("short", "ACGT"), (None, base[2]), ("odd", "N" * 50), ("mixed", base[3][:150] + "N" + base[3][150:])]
    got, links, members = run(spark, data)
    assert got == brute(data)
    report = {r.id: (r.class_id, r.links) for r in class_report(links, members).collect()}
    assert report["copy2"][0] == report["copy1"][0] == report["copy3"][0]
    assert set(report) == {r for r, s in data if r is not None and s and len(canonical_set(s, 21))}


def test_hot_copies_and_refined_buckets(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(200))
    data = [(f"same{i:03}", base) for i in range(40)] + [(f"near{i:03}", similar(rng, base, 2)) for i in range(30)] + [(f"far{i:03}", "".join(rng.choice("ACGT") for _ in range(200))) for i in range(30)]
    got, _, _ = run(spark, data, most=5)
    assert got == brute(data)


def test_empty(spark):
    assert run(spark, [])[0] == []


def test_packing():
    assert unpack(pack("acgtNx")) == "ACGTNN" and unpack(pack("ACG")) == "ACGN" and pack("") == b""


def test_long_sequence():
    s = "".join(np.random.default_rng(0).choice(list("ACGT"), 200_000))
    v = canonical_set(s, 21)
    assert table_keys(sketches(v, np.array([0, len(v)]), 60, 0), 20, 1).shape == (1, 60)


@pytest.mark.parametrize("size", [1, 3, 12, 60, 150, 250, 700])
def test_recall_by_similarity(size):
    """Sets of every size collide in a table as surely as independent hashes would, from a similarity of 0.5 on."""
    rng = np.random.default_rng(size)
    for share in (0.5, 0.6, 0.8, 1.0):
        sets = []
        for _ in range(2000):
            both = max(1, round(share * size))
            x = np.unique(rng.integers(0, 1 << 42, 3 * size + 3, np.uint64))
            rng.shuffle(x)
            left = (size - both) // 2
            sets += [x[: both + left], np.concatenate([x[:both], x[both + left : size]])]
        sets = [np.sort(s) for s in sets]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        keys, begin = keys_of(np.concatenate(sets), starts, 20, 1)
        own = [set(keys[a:b].tolist()) for a, b in zip(begin, begin[1:])]
        met = np.array([bool(a & b) for a, b in zip(own[::2], own[1::2])])
        true = np.array([2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2])])
        assert met[true].mean() >= 0.9995
