import random

import numpy as np

from seqloom.llm.contamination import find_passages, han_kana, smith_waterman, words


def test_reading():
    assert words(r"Caf\'e na\"{\i}ve \cite[p. 3]{ab_c} so\-called \emph{Big} x_2 \'{E}t\`e") == ["café", "naïve", "socalled", "big", "x", "2", "étè"]
    assert words(None) == [] and words("") == []
    assert han_kana(r"ab 漢字\cite{x}カナ、 漢") == "漢字カナ漢"


def test_alignment_score():
    a = np.array([1, 2, 3, 4, 5])
    assert smith_waterman(a, a) == 10
    assert smith_waterman(a, np.array([9, 1, 2, 7, 4, 5])) == 2 * 4 - 1
    assert smith_waterman(a, np.array([1, 2, 3, 8, 4, 5])) == 10 - 1
    assert smith_waterman(a, np.array([0, 0])) == 0


def brute(docs, items):
    out = set()
    for item, lang, p in items:
        kind = lang in ("zh", "ja")
        t = han_kana(p) if kind else words(p)
        n = 26 if kind else 13
        grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        for doc, text in docs:
            u = han_kana(text) if kind else words(text)
            if any(tuple(u[i : i + n]) in grams for i in range(len(u) - n + 1)):
                out.add((item, doc))
    return out


def test_against_all_windows(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, "en", " ".join(text(rng.randrange(10, 40)))) for i in range(30)]
    items += [(100, "zh", "".join(chr(0x4E00 + rng.randrange(50)) for _ in range(40))), (101, "en", None), (102, "en", ""), (103, "en", "too short"), (104, None, items[0][2])]
    docs = []
    for d in range(120):
        w = text(60)
        if d % 3:
            src = words(items[d % 30][2])
            a = rng.randrange(max(1, len(src) - 12))
            cut = src[a : a + rng.choice([11, 12, 13, 14, 20])]
            k = rng.randrange(60)
            w[k:k] = cut
        docs.append((d, " ".join(w)))
    han = items[30][2]
    docs += [(500, "甲乙" + han[3:29] + "丙"), (501, han[3:28]), (502, han[:13] + " x \\emph{y} " + han[13:27]), (503, None), (504, ""), (505, items[0][2] * 2)]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, score string")
    i = spark.createDataFrame(items + items[:3], "item_id bigint, lang string, passage string")
    for size in (4_000_000, 400):
        for edits in (False, True):
            got = {(r.item_id, r.doc_id) for r in find_passages(d, i, edits, size).where("run >= window and score >= 2 * window").collect()}
            assert got == brute(docs, items)


def test_edited_copy_scores_high(spark):
    item = " ".join(f"a{i}" for i in range(40))
    w = item.split()
    w[9], w[19], w[29] = "x", "y", "z"
    d = spark.createDataFrame([(1, " ".join(["q"] * 20 + w + ["q"] * 20))], "doc_id bigint, text string")
    r = find_passages(d, spark.createDataFrame([(7, "en", item)], "item_id bigint, lang string, passage string")).collect()[0]
    assert r.run < 13 and r.similarity >= 0.8


def test_edited_copies_beside_a_verbatim_one(spark):
    item = [f"a{i}" for i in range(40)]
    swapped, added = item.copy(), []
    for i in range(7, 40, 8):
        swapped[i] = "x"
    for i, w in enumerate(item):
        added += [w, "y"] if i % 5 in (1, 3) else [w]  # no four words in a row are left
    text = lambda w: " ".join(["q"] * 20 + w + ["q"] * 20)
    short = ["b1", "b2", "b3", "b4", "b5"]
    docs = [(1, text(item)), (2, text(swapped)), (3, text(added)), (4, text(item[:20])), (5, text([*short, "q", *short[:2], "q", *short[2:]])), (6, text([*short[:2], "z", *short[2:]]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(7, "en", " ".join(item)), (8, "en", " ".join(short))], "item_id bigint, lang string, passage string")
    got = {(r.item_id, r.doc_id): r.score for r in find_passages(d, i).where("similarity >= 0.8").collect()}
    assert got == {(7, 1): 80, (7, 2): 66, (7, 3): 64, (8, 5): 10, (8, 6): 9}


def test_every_similar_copy_is_found(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(4, 45) if k else 3)] for k in range(25)]
    docs = []
    for k in range(300):
        w = []
        for x in items[k % 25]:
            u = rng.random()
            w += [] if u < 0.04 else [rng.choice(vocab)] if u < 0.08 else [x, rng.choice(vocab)] if u < 0.2 else [x]
        docs.append([rng.choice(vocab) for _ in range(30)] + w + [rng.choice(vocab) for _ in range(30)])
    ids = {w: i + 1 for i, w in enumerate(vocab)}
    code = lambda t: np.array([ids[w] for w in t])
    true = {(i, d): s for i, p in enumerate(items) for d, t in enumerate(docs) if (s := smith_waterman(code(p), code(t))) >= 1.6 * len(p)}
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, "en", " ".join(t)) for k, t in enumerate(items)], "item_id bigint, lang string, passage string")
    assert len(true) > 100
    assert {(r.item_id, r.doc_id): r.score for r in find_passages(d, i).where("similarity >= 0.8").collect()} == true


def test_run_of_an_edited_copy(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "a b c d e x f g h i j k l n")], "doc_id bigint, text string")
    r = find_passages(d, spark.createDataFrame([(7, "en", "a b c d e f g h i j k l m n")], "item_id bigint, lang string, passage string"))
    assert sorted((x.doc_id, x.run, x.score) for x in r.collect()) == [(1, 14, 28), (2, 7, 24)]


def test_short_items(spark):
    d = spark.createDataFrame([(1, "x a y"), (2, "a b"), (3, "b a c d q e"), (4, "cd")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "en", "a"), (2, "en", "a b"), (3, "en", "c d e"), (4, "en", "...")], "item_id bigint, lang string, passage string")
    assert sorted((r.item_id, r.doc_id, r.score) for r in find_passages(d, i).collect()) == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (2, 2, 4), (3, 3, 5)]
    assert find_passages(d, i, False).count() == 0


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, lang string, passage string")
    assert find_passages(d, i).count() == 0
