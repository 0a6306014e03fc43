"""Scalar functions on sequences, intervals and edges, as Column builders that stay in generated code."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Text) -> Column:
    """Reverse complement; case is kept, other letters stay. Null gives null."""
    return F.reverse(F.translate(_c(seq), "ACGTNacgtn", "TGCANtgcan"))


def revcomp_upper(seq: Text) -> Column:
    """Reverse complement in upper case, of A, C, G and T only."""
    return F.reverse(F.translate(F.upper(_c(seq)), "ACGT", "TGCA"))


def oriented(seq: Text, orientation: Text) -> Column:
    """The sequence for orientation 1, its reverse complement for -1; anything else fails the query."""
    o = _c(orientation)
    return F.when(o == 1, _c(seq)).when(o == -1, revcomp(seq)).otherwise(F.raise_error(F.lit("orientation must be 1 or -1")))


def one_hot(seq: Text) -> Column:
    """Array of four 0/1 arrays, one for each of A, C, G, T."""
    letters = F.split(F.upper(_c(seq)), "")

    def channel(base: str) -> Column:
        return F.transform(letters, lambda x: F.when(x == base, 1).otherwise(0))

    return F.array(*[channel(b) for b in "ACGT"])


def gc_count(seq: Text) -> Column:
    """Number of G and C in either case."""
    s = _c(seq)
    return (F.length(s) - F.length(F.translate(s, "GCgc", ""))).cast("bigint")


def non_gap_length(seq: Text) -> Column:
    return F.length(F.translate(_c(seq), "-", "")).cast("bigint")


def gc_fraction(seq: Text) -> Column:
    """G and C over all letters but gaps; 0 for none."""
    n = non_gap_length(seq)
    return F.when(n > 0, gc_count(seq) / n).otherwise(F.lit(0.0))


def clamp_slice(seq: Text, start: Text, end: Text) -> Column:
    """Letters from start to end (0-based, half-open), both clamped to the sequence."""
    s = _c(seq)
    a = F.greatest(F.lit(0), F.least(F.length(s), _c(start))).cast("int")
    b = F.greatest(a, F.least(F.length(s), _c(end))).cast("int")
    return F.substring(s, a + 1, b - a)


def merge_overlap(left: Text, right: Text, overlap: Text) -> Column:
    """Left, then right without its first ``overlap`` letters; fails the query if the overlap is longer than either. An empty side gives the other."""
    a, b, k = _c(left), _c(right), _c(overlap)
    bad = k > F.least(F.length(a), F.length(b))
    return F.when(a == "", b).when(b == "", a).when(bad, F.raise_error(F.lit("overlap longer than a sequence"))).otherwise(F.concat(a, F.substring(b, k.cast("int") + 1, F.length(b))))


def spell_path(seqs: Text, overlaps: Text) -> Column:
    """Sequence of a path: array of sequences merged in order, ``overlaps[i]`` between i and i+1."""
    s, k = _c(seqs), _c(overlaps)
    steps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), k, lambda x, y: F.struct(x.alias("s"), y.alias("k")))
    return F.aggregate(steps, F.element_at(s, 1), lambda acc, x: F.concat(acc, F.substring(x["s"], x["k"].cast("int") + 1, F.length(x["s"]))))


def tag_map(fields: Text) -> Column:
    """``KEY:TYPE:VALUE`` fields as a map of KEY to VALUE; other fields are left out, of equal keys the last counts."""
    parts = F.transform(_c(fields), lambda x: F.split(x, ":", 3))
    good = F.filter(parts, lambda p: F.size(p) == 3)
    return F.aggregate(good, F.expr("map()").cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _v: k != p[0]), F.create_map(p[0], p[2])))


def sign_token(orientation: Text) -> Column:
    return F.when(_c(orientation) == 1, "+").otherwise("-")


def unsigned(token: Text) -> Column:
    return F.regexp_replace(_c(token), "[+-]$", "")


def orientation_of(token: Text) -> Column:
    """1 or -1 from the last sign of a token, null without one."""
    last = F.right(_c(token), F.lit(1))
    return F.when(last == "+", 1).when(last == "-", -1)


def dot_escape(text: Text) -> Column:
    return F.replace(F.replace(_c(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def identity(matches: Text, length: Text) -> Column:
    return F.when(_c(length) > 0, _c(matches) / _c(length)).otherwise(F.lit(0.0))


def error_rate(errors: Text, length: Text) -> Column:
    return F.when(_c(length) > 0, _c(errors) / _c(length)).otherwise(F.lit(1.0))


def margin_coefficients(threshold: float) -> tuple[int, int]:
    """Match and error coefficients of the margin above an identity threshold p/q: q-p and p."""
    f = Fraction(str(threshold)).limit_denominator(1_000_000)
    if not 0 < f < 1:
        raise ValueError("threshold must lie between 0 and 1")
    return f.denominator - f.numerator, f.numerator


def margin_weight(matches: Text, errors: Text, threshold: float) -> Column:
    m, e = margin_coefficients(threshold)
    return _c(matches) * m - _c(errors) * e


def position_bits(n: Text) -> Column:
    """Binary digits for positions of n items, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(2), _c(n)).cast("double")))).cast("bigint")


def canonical_rotation(tokens: Text) -> Column:
    """An array of distinct items rotated to begin with its smallest: equal for arrays that are rotations of each other."""
    t = _c(tokens)
    k = F.array_position(t, F.array_min(t)).cast("int")
    return F.when(F.size(t) > 0, F.concat(F.slice(t, k, F.size(t)), F.slice(t, F.lit(1), k - 1))).otherwise(t)


def cigar_lengths(cigar: Text, ops: str) -> Column:
    """Sum of the lengths of the given operations of a CIGAR string."""
    found = F.regexp_extract_all(_c(cigar), F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def cigar_runs(cigar: Text) -> Column:
    """The operations of a CIGAR string in order: array of ``n`` and ``op``."""
    found = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+[=XIDM])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))


def decode_cigar(cigar: Text, query: Text, target: Text) -> Column:
    """Struct of a CIGAR string laid over its sequences: ``aligned_query``, ``aligned_target``, ``q_start``, ``q_end``, ``t_start``, ``t_end``.

    Leading insertions are the free beginning of the query, trailing deletions the free end of the target; both lie outside the overlap. The target starts at 0.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit("").alias("q"), F.lit("").alias("t"), zero.alias("i"), zero.alias("j"), zero.alias("free"), zero.alias("late"), F.lit(False).alias("on"))

    def step(a: Column, x: Column) -> Column:
        """``late`` deletions are taken once something follows them; insertions are free until ``on``."""
        size, late = x["n"], a["late"]
        part = lambda seq, at, n: F.substring(_c(seq), at.cast("int") + 1, n.cast("int"))
        dashes = lambda n: F.repeat(F.lit("-"), n.cast("int"))
        gap, ins = x["op"] == "D", x["op"] == "I"
        ahead = ins & ~a["on"]
        more_t = F.when(ins, dashes(size)).otherwise(part(target, a["j"] + late, size))
        return F.struct(
            F.when(gap | ahead, a["q"]).otherwise(F.concat(a["q"], dashes(late), part(query, a["i"], size))).alias("q"),
            F.when(gap | ahead, a["t"]).otherwise(F.concat(a["t"], part(target, a["j"], late), more_t)).alias("t"),
            F.when(gap, a["i"]).otherwise(a["i"] + size).alias("i"),
            F.when(gap | ahead, a["j"]).when(ins, a["j"] + late).otherwise(a["j"] + late + size).alias("j"),
            F.when(ahead, a["free"] + size).otherwise(a["free"]).alias("free"), F.when(gap, late + size).otherwise(zero).alias("late"), (a["on"] | ~ins).alias("on"),
        )

    def finish(a: Column) -> Column:
        return F.struct(a["q"].alias("aligned_query"), a["t"].alias("aligned_target"), a["free"].alias("q_start"), a["i"].alias("q_end"), zero.alias("t_start"), a["j"].alias("t_end"))

    return F.aggregate(cigar_runs(cigar), start, step, finish)


def dovetail_tolerance(q_span: Column, t_span: Column) -> Column:
    """How far an overlap may end before the end of a read: a fiftieth of the shorter interval, from 5 to 100."""
    return F.least(F.lit(100), F.greatest(F.lit(5), F.floor(F.least(q_span, t_span) * 0.02))).cast("bigint")


def ungapped_identity(a: Text, b: Text) -> Column:
    """Share of equal letters of two texts of one length; 0 for different lengths or empty texts."""
    x, y = _c(a), _c(b)
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), F.lit(0), lambda n, i: n + (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))).cast("int"))
    return F.when((F.length(x) == F.length(y)) & (F.length(x) > 0), same / F.length(x)).otherwise(0.0)


def cyclic_span(starts: Column, length: Column) -> Column:
    """The shortest stretch of a circle that holds all positions of an array: the length less the widest gap; 0 for fewer than two."""
    v = F.array_sort(starts)
    gaps = F.transform(v, lambda x, i: F.pmod(F.get(v, F.pmod(i + 1, F.size(v))) - x, length))
    return F.when(F.size(v) >= 2, length - F.array_max(gaps)).otherwise(F.lit(0).cast("bigint"))


def expected_identity(mismatch_rate: Column) -> Column:
    """Chance that two reads with independent substitutions show the same base."""
    return (1 - mismatch_rate) * (1 - mismatch_rate) + mismatch_rate * mismatch_rate / 3.0


def expected_read_errors(insertion_rate: Column, deletion_rate: Column, mismatch_rate: Column) -> Column:
    """Edits per reference base in one read."""
    return insertion_rate + deletion_rate + (1 - deletion_rate) * mismatch_rate


def expected_pair_errors(insertion_rate: Column, deletion_rate: Column, mismatch_rate: Column) -> Column:
    """Edits per reference base between two reads: different bases where both have one, a deletion in one of them, an insertion in either."""
    there = 1 - deletion_rate
    return there * there * (1 - expected_identity(mismatch_rate)) + 2 * deletion_rate * there + 2 * insertion_rate


def reward(mode: str | Column, threshold: float = 0.98) -> Column:
    """Reward of an edge by mode, over the columns of the edges schema; an unknown mode or a power that isn't positive raises. A Column is a mode of its own."""
    if isinstance(mode, Column):
        return mode.cast("double")
    ln = F.col("overlap_len").cast("double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if mode.startswith("overlap_len_power:"):
        try:
            gamma = float(mode.partition(":")[2])
        except ValueError:
            raise ValueError(f"no number in score mode {mode!r}") from None
        if not gamma > 0:
            raise ValueError(f"the power must be positive in score mode {mode!r}")
        return F.pow(ln, F.lit(gamma))
    plain = {
        "overlap_len": ln,
        "overlap_len_power": ln * ln,
        "overlap_len_power2": ln * ln,
        "overlap_len_power3": ln * ln * ln,
        "identity": F.col("identity"),
        "dp": F.coalesce("weight_dp", "dp_score", ln * F.col("identity")),
        "mi": F.coalesce(F.col("weight_mi"), ln * F.col("nmi"), F.col("mi"), F.lit(0.0)),
        "raw_mi": zero("mi"),
        "nmi": zero("nmi"),
        "weighted_nmi": F.coalesce(F.col("weight_mi"), ln * zero("nmi")),
        "mapq": F.col("mapq").cast("double"),
        "matches": F.col("matches").cast("double"),
        "quality": ln * F.col("identity") * F.greatest(F.lit(0.0), 1 - F.col("error_rate")),
        "quality_margin": margin_weight("matches", F.col("mismatches") + F.col("insertions") + F.col("deletions"), threshold),
    }
    if mode not in plain:
        raise ValueError(f"unknown score mode {mode!r}; known: {', '.join(plain)}, overlap_len_power:<power>")
    return plain[mode].cast("double")


def _log_ball(n: int, radius: int, alphabet: int) -> float:
    """Logarithm of the number of words of n letters that differ from a given one in at most ``radius`` places."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alphabet - 1) for i in range(min(radius, n) + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def likelihood_weight(length: int, distance: int, alphabet: int = 4) -> float:
    """Weight of an overlap: minus the base-``alphabet`` logarithm of the chance P(l, d) that random reads overlap so well.

    P(l, d) is the sum over i = 0..d of N(l, i) N(l, d-i), over (d+1) alphabet^(l+d), where N(l, d) counts the words of l+d letters
    within d substitutions of a given one. Everything is summed in logarithms, so long overlaps don't overflow.
    """
    if length < 0 or distance < 0 or alphabet < 2:
        raise ValueError("length and distance must not be negative, the alphabet needs two letters")
    ball = [_log_ball(length + i, i, alphabet) for i in range(distance + 1)]
    logs = [a + b for a, b in zip(ball, reversed(ball))]
    top = max(logs)
    total = top + math.log(sum(math.exp(x - top) for x in logs)) - math.log(distance + 1)
    return length + distance - total / math.log(alphabet)
