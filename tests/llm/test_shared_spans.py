import random

from conftest import rows

from seqloom.llm.shared_spans import SpanStore, shared_spans


def brute(data, length):
    seqs, where = {}, {}
    for rid, seq in data:
        if rid is not None and seq:
            seqs.setdefault(rid, set()).add(seq.upper())
    for rid, all_ in seqs.items():
        for s in all_:
            for i in range(len(s) - length + 1):
                w = s[i : i + length]
                if not w.strip("ACGT"):
                    where.setdefault(w, set()).add(rid)
    out = []
    for rid, all_ in seqs.items():
        for s in all_:
            hit = [False] * len(s)
            for i in range(len(s) - length + 1):
                if len(where.get(s[i : i + length], ())) > 1:
                    hit[i : i + length] = [True] * length
            i = 0
            while i < len(s):
                j = i
                while j < len(s) and hit[j]:
                    j += 1
                if j > i:
                    out.append((rid, i, j))
                i = j + 1
    return sorted(out, key=repr)


def run(spark, data, **kw):
    return rows(shared_spans(spark.createDataFrame([(r, s, 1) for r, s in data], "rid string, seq string, start int"), "rid", "seq", **kw))


def test_against_all_windows(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(900))
    data = []
    for i in range(40):
        a = rng.randrange(700)
        s = list(genome[a : a + rng.randrange(60, 200)])
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        data.append((f"r{i:02}", "".join(s)))
    data += [("own", genome[:80] * 2), ("low", data[0][1].lower()), ("null", None), ("empty", ""), (None, genome), data[3], data[3]]
    assert run(spark, data, length=50, k=12) == brute(data, 50)
    assert run(spark, data, length=49, k=20, batches=3) == brute(data, 49)
    assert run(spark, data, length=20, k=12, many=2) == brute(data, 20)


def test_hot_copies(spark):
    rng = random.Random(8)
    s = "".join(rng.choice("ACGT") for _ in range(150))
    data = [(f"c{i:03}", s) for i in range(60)] + [(f"d{i:03}", s[:100] + "".join(rng.choice("ACGT") for _ in range(60))) for i in range(60)] + [("lone", "".join(rng.choice("ACGT") for _ in range(150))), ("broken", s[:70] + "N" + s[70:])]
    assert run(spark, data, length=40, k=16) == brute(data, 40)
    assert run(spark, data, length=40, k=16, many=10) == brute(data, 40)


def test_empty(spark):
    assert run(spark, []) == []


def test_store_is_opened_again_and_compacted(spark, tmp_path):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    data = [(f"r{i:02}", genome[a : a + rng.randrange(50, 160)]) for i in range(50) for a in [rng.randrange(450)]]
    data += [("other", data[0][1]), data[7]]
    path = f"file://{tmp_path}/store"
    for b in range(5):
        with SpanStore(spark, path, 40, 16) as store:
            store.index.fanout = 2
            store.add(spark.createDataFrame(data[b * 10 : b * 10 + 12], "rid string, seq string"), "rid", "seq")
            so_far = data[: b * 10 + 12]
            assert len(store.index.runs) < 4
            assert rows(store.spans()) == brute(so_far, 40)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]
    assert rows(shared_spans(spark.createDataFrame(data, "rid string, seq string"), "rid", "seq", 40, 16)) == brute(data, 40)
