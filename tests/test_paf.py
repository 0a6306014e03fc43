import pytest

from seqloom.operators import paf as P


def line(*f):
    return "\t".join(map(str, f))


def run(spark, lines, **kw):
    c = P.PafConfig(**kw)
    d = P.with_outcomes(P.parse_paf(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")), c)
    return d, c


FWD = dict(min_overlap=100, tolerance=10)


@pytest.mark.parametrize("text", [line("read_1", 1000, 0, 600, "+", "read_0", 1000, 400, 1000, 580, 600, 60), line("read_0", 1000, 400, 1000, "+", "read_1", 1000, 0, 600, 580, 600, 60)])
def test_direction(spark, text):
    r = P.candidates(run(spark, [text], **FWD)[0]).collect()[0]
    assert (r.left_id, r.right_id, r.left_start_hint, r.left_end_hint, r.right_start_hint, r.right_end_hint, r.rough_shift) == ("read_0", "read_1", 400, 1000, 0, 600, 400)


def test_reverse_strand(spark):
    text = line("read_0", 1000, 5, 1000, "-", "read_1", 1000, 5, 1000, 980, 995, 60)
    assert P.candidates(run(spark, [text], reverse_strand=False, **FWD)[0]).count() == 0
    c = P.candidates(run(spark, [text], **FWD)[0])
    r = c.collect()[0]
    assert (r.left_id, r.left_orientation, r.right_id, r.right_orientation, r.rough_shift) == ("read_0", 1, "read_1", -1, 5)
    r = P.reciprocal(c).collect()[0]
    assert (r.left_id, r.left_orientation, r.right_id, r.right_orientation) == ("read_1", 1, "read_0", -1)


def test_reciprocal_coordinates(spark):
    c = P.candidates(run(spark, [line("left", 148, 67, 148, "-", "right", 151, 70, 151, 81, 81, 60)], min_overlap=50)[0])
    r = P.reciprocal(c).collect()[0]
    assert (r.left_id, r.right_id, r.left_start_hint, r.left_end_hint, r.right_start_hint, r.right_end_hint) == ("right", "left", 70, 151, 0, 81)


def test_tag_before_ratio(spark):
    f = ("a", 4000, 1500, 4000, "+", "b", 4000, 0, 2500, 1300, 2500, 60)
    outcomes = {r.line_no: r.outcome for r in run(spark, [line(*f, "dv:f:0.075"), line(*f), line(*f, "dv:f:x", "de:f:0.1")], max_error_hint=0.30, **FWD)[0].collect()}
    assert outcomes == {0: "accepted", 1: "skipped_error_hint", 2: "accepted"}


def test_full_coverage_has_its_own_threshold(spark):
    d, c = run(spark, [line("read_a", 150, 0, 150, "-", "read_b", 150, 0, 150, 149, 150, 60)], min_overlap=100, min_identity=0.995, full_coverage_identity=0.990)
    assert P.candidates(d).count() == 0
    r = P.full_coverage(d).collect()
    assert [(x.first_orientation, x.second_orientation) for x in r] == [(1, -1)]


def test_full_coverage_needs_exact_ends(spark):
    d, _ = run(spark, [line("read_a", 150, 1, 150, "+", "read_b", 150, 0, 149, 149, 149, 60)], min_overlap=100, min_identity=0.9)
    assert P.full_coverage(d).count() == 0


def test_counts_and_odd_lines(spark):
    good = line("a", 1000, 400, 1000, "+", "b", 1000, 0, 600, 590, 600, 60)
    d, c = run(spark, ["", "  ", "a\tb", good, good, line("a", 9, 0, 9, "+", "a", 9, 0, 9, 9, 9, 60)], **FWD)
    n = {r.outcome: r.n for r in P.outcome_counts(d, c).collect()}
    assert n == {"raw_records": 4, "skipped_malformed": 1, "accepted": 2, "skipped_self": 1, "accepted_reverse_complement": 2}


def test_direct_edges(spark):
    r = P.direct_edges(P.candidates(run(spark, [line("a", 100, 10, 100, "+", "b", 100, 0, 90, 89, 90, 60)], min_overlap=50)[0])).collect()[0]
    assert (r.edit_distance, r.identity, r.accepted) == (1, 89 / 90, True)


def test_empty(spark):
    d, c = run(spark, [])
    assert P.candidates(d).count() == 0 and P.containment(d).count() == 0
    assert [r.n for r in P.outcome_counts(d, c).collect()] == []
