import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import seq as S
from seqloom.operators import align as A
from seqloom.operators import evaluate as E
from seqloom.operators import scoring as C


@pytest.mark.parametrize("x, y, mi, nmi", [("ACGTACGT", "ACGTACGT", 2.0, 1.0), ("AAAAAAAA", "AAAAAAAA", 0.0, 0.0), ("", "", 0.0, 0.0)])
def test_mutual_information(spark, x, y, mi, nmi):
    r = C.mutual_information(spark.createDataFrame([(1, x, y)], "k int, aligned_left string, aligned_right string"), ["k"]).collect()[0]
    assert (r.mi, r.nmi, r.mi_distance) == pytest.approx((mi, nmi, 1 - nmi))


def test_gaps_left_out(spark):
    r = C.mutual_information(spark.createDataFrame([(1, "AC-GT", "ACT-T")], "k int, aligned_left string, aligned_right string"), ["k"], include_gap=False).collect()[0]
    assert r.columns == 3


def test_scalars(spark):
    r = spark.range(1).select(
        S.gc_count(F.lit("A-CGgnN")).alias("a"), S.gc_fraction(F.lit("A-CG")).alias("b"), S.revcomp(F.lit("ACgtN")).alias("c"), S.merge_overlap(F.lit("ACGT"), F.lit("GTCC"), F.lit(2)).alias("d"),
        S.clamp_slice(F.lit("ACGT"), F.lit(-3), F.lit(9)).alias("e"), S.position_bits(F.lit(9)).alias("f"), S.canonical_rotation(F.array(F.lit("c"), F.lit("a"), F.lit("b"))).alias("g"), S.tag_map(F.array(F.lit("a:i:1"), F.lit("bad"), F.lit("b:Z:x:y"), F.lit("a:i:2"))).alias("h"),
    ).collect()[0]
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (3, 2 / 3, "NacGT", "ACGTCC", "ACGT", 4, ["a", "b", "c"], {"a": "2", "b": "x:y"})
    assert S.margin_coefficients(0.98) == (1, 49)
    with pytest.raises(ValueError):
        S.reward("nonsense")
    with pytest.raises(ValueError):
        S.reward("overlap_len_power:-1")
    with pytest.raises(Exception, match="overlap longer"):
        spark.range(1).select(S.merge_overlap(F.lit("A"), F.lit("C"), F.lit(2))).collect()


def test_likelihood_weight():
    assert S.likelihood_weight(10, 0) == pytest.approx(10)
    assert S.likelihood_weight(5000, 40) > S.likelihood_weight(5000, 80) > 0


def test_composition(spark):
    reads = spark.createDataFrame([("x", "TTGGAA"), ("y", "CCCCAA")], "rid string, seq string")
    e = spark.createDataFrame([("x", "y", 2, 6, 0, 4, 4), ("x", "q", 0, 0, 0, 0, 10)], "left_id string, right_id string, left_start int, left_end int, right_start int, right_end int, overlap_len int")
    got = {r.right_id: (r.gc_length, r.gc, r.gc_share, r.gc_source) for r in C.overlap_composition(e, reads).collect()}
    assert got["y"] == (4.0, 3.0, 0.75, "coordinates")
    assert got["q"][3] == "read_average_fallback" and got["q"][2] == pytest.approx(1 / 3)


def score(x, y, match=2, mismatch=-3, open_=5, extend=1):
    """Best score by plain dynamic programming."""
    low = -(10**9)
    m, n = len(x), len(y)
    h = [[low] * (n + 1) for _ in range(m + 1)]
    e, f = [r[:] for r in h], [r[:] for r in h]
    for i in range(m + 1):
        h[i][0] = 0
    for i in range(m + 1):
        for j in range(1, n + 1):
            e[i][j] = max(h[i][j - 1] - open_, e[i][j - 1] - extend)
            if i:
                f[i][j] = max(h[i - 1][j] - open_, f[i - 1][j] - extend)
            d = h[i - 1][j - 1] + (match if x[i - 1] == y[j - 1] else mismatch) if i else low
            h[i][j] = max(d, e[i][j], f[i][j])
    return max(h[m])


def test_alignment_scores():
    rng = random.Random(3)
    xs, ys = [], []
    for _ in range(60):
        core = "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 40)))
        y = "".join(c for c in core if rng.random() > 0.1)
        xs.append("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 9))) + core)
        ys.append(y + "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 9))))
    for (s, p, q, start, end), x, y in zip(A.align_batch(xs, ys), xs, ys):
        assert s == score(x, y)
        assert p.replace("-", "") == x[start:] and q.replace("-", "") == y[:end]
        m, mm, ins, dele = A.column_stats(p, q)
        gaps = sum(5 + len(g) - 1 for t in (p, q) for g in __import__("re").findall("-+", t))
        assert s == 2 * m - 3 * mm - gaps


def test_flanks():
    assert A.align_batch(["GGGGACGT"], ["ACGTTTTT"])[0][1:] == ("ACGT", "ACGT", 4, 4)


def test_alignments_of_a_batch_are_those_of_each_pair():
    """a pair's alignment doesn't depend on longer ones beside it, and narrow bands lose nothing."""
    short = ("ACGTTGCAAC", "G" + "ACGTTGCAAC")
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [short, ("", "ACGT"), ("ACGT", ""), ("AC\u00e9GT" * 5, "AC\u00e9GT" * 5)]
    for k in range(40):
        core = letters(rng.randrange(60, 160))
        cut = rng.randrange(20, 50)
        y = core[:cut] + letters(k % 4) + core[cut + k % 3 :] if k % 5 else letters(90)
        pairs.append((letters(rng.randrange(0, 25)) + core, y + letters(rng.randrange(0, 25))))
    got = A.align_batch(*map(list, zip(*pairs)))
    assert got == [A.align_batch([x], [y])[0] for x, y in pairs]
    assert got[0] == (15, "-ACGTTGCAAC", "GACGTTGCAAC", 0, 11)
    assert [g[0] for g in got] == [score(x, y) for x, y in pairs]


def test_pipeline_report_aligns_once(spark):
    """the report reads aligned edges from a table; before, every use of them aligned all pairs again."""
    from seqloom.plans.score_plans import pipeline_report

    report = pipeline_report(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.collect()[0].total_edges > 0


def test_gap_truth(spark):
    reads = spark.createDataFrame([("l", [0, 1, 3, 4], 0, 5), ("r", [0, 1, -1, 3, 4], 0, 5), ("s", [0, 1, 3, 4], 0, 5)], "rid string, ref_coords array<bigint>, true_start bigint, true_end bigint")
    e = spark.createDataFrame([("l", "r", "AC-GT", "ACTGT", 0, 0), ("l", "s", "AC-GT", "ACG-T", 0, 0), ("l", "none", "A", "A", 0, 0)], "left_id string, right_id string, aligned_left string, aligned_right string, left_start bigint, right_start bigint")
    got = {r.right_id: (r.gap_columns, r.supported_gap_columns) for r in E.gap_truth(e, reads).collect()}
    assert got == {"r": (1, 1), "s": (2, 0), "none": (None, None)}


def test_inversions(spark):
    rng = random.Random(1)
    v = list(range(70))
    rng.shuffle(v)
    d = spark.createDataFrame(list(enumerate(v)), "p bigint, v bigint")
    assert E.inversions(d, "p", "v", 70).collect()[0][0] == sum(v[i] > v[j] for i in range(70) for j in range(i + 1, 70))


def test_edge_report_on_nothing(spark):
    k = E.truth_ranks(spark.createDataFrame([("a", 0, 5), ("b", 3, 9)], "rid string, true_start bigint, true_end bigint"))
    r = E.edge_report(spark.createDataFrame([], "left_id string, right_id string, shift bigint"), k).collect()[0]
    assert (r.total_edges, r.edge_precision, r.adjacent_recall, r.mean_shift_error, r.missing_adjacent_edges) == (0, 0.0, 0.0, None, 1)
