"""Suffix-prefix alignment with affine gaps, many pairs at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALIGNMENT = (
    "aligned_left string, aligned_right string, left_start bigint, left_end bigint, right_start bigint, right_end bigint, score double, "
    "matches bigint, mismatches bigint, insertions bigint, deletions bigint, gaps bigint, edit_distance bigint, alignment_length bigint"
)
_WORK, _TRACE = 1 << 16, 1 << 26  # cells of one step of a group, bytes of the ways back of a group


def align_batch(lefts: list[str], rights: list[str], match: int = 2, mismatch: int = -3, gap_open: int = 5, gap_extend: int = 1) -> list[tuple[int, str, str, int, int]]:
    """Best alignment of an end of each left sequence with the beginning of its right one.

    The start of the left and the end of the right sequence are free; of equal scores the shortest right part and, going back, a base pair before a gap in the
    right before one in the left is taken. A gap of n bases costs ``gap_open + (n-1)*gap_extend``. Gives (score, aligned left, aligned right, left start, right end).
    A pair's result doesn't depend on the others. Cells are left out where no alignment of at least a score that the pair is known to have can pass (:func:`_reach`), so nothing is lost by it.
    """
    costs = (match, mismatch, gap_open, gap_extend)
    a, b = ([np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in side] for side in (lefts, rights))
    usual = match > 0 >= mismatch and gap_open >= gap_extend >= 0
    bands = {k: (len(x), len(y)) for k, (x, y) in enumerate(zip(a, b))}  # the whole of a pair: cells (i, j) with i - j up to the first and j - i up to the second number
    if usual:
        center = [_shared_diagonal(x.tobytes(), y.tobytes()) for x, y in zip(a, b)]
        sure = [_ungapped(x, y, d, match, mismatch) for x, y, d in zip(a, b, center)]
        bands = {k: _reach(len(x), len(y), s, *costs) for k, (x, y, s) in enumerate(zip(a, b, sure))}
        # a look at the surroundings of the shared bases makes wide bands narrow
        wide = {k: near for k, d in enumerate(center) if d is not None and sum(bands[k]) > 2 * sum(near := (max(0, min(len(a[k]), d + 24)), max(0, min(len(b[k]), 24 - d))))}
        for part in _groups(a, b, wide):
            scores, _, _ = _fill(a, b, part, wide, costs, False)
            for k, s in zip(part, scores.tolist()):
                bands[k] = _reach(len(a[k]), len(b[k]), max(sure[k], s), *costs)
    out: list = [None] * len(a)
    for part in _groups(a, b, bands):
        scores, ends, ways = _fill(a, b, part, bands, costs, True)
        for k, s, end, way in zip(part, scores.tolist(), ends.tolist(), ways):
            x, y, start = lefts[k], rights[k], len(lefts[k]) - int((way != 2).sum())
            out[k] = (s, _spell(x[start:], a[k][start:], way != 2), _spell(y[:end], b[k][:end], way != 1), start, end)
    return out


def _shared_diagonal(x: bytes, y: bytes, k: int = 12) -> int | None:
    """``i - j`` of the first of the right sequence's blocks of k bases that the left one has."""
    for p in range(0, len(y) - k + 1, k):
        if (at := x.find(y[p : p + k])) >= 0:
            return at - p
    return None


def _ungapped(x: np.ndarray, y: np.ndarray, d: int | None, match: int, mismatch: int) -> int:
    """A score that the pair has: that of the overlap at ``d``, or of none."""
    if d is None or d < 0 or len(x) - d > len(y):
        return 0
    same = int((x[d:] == y[: len(x) - d]).sum())
    return max(0, same * match + (len(x) - d - same) * mismatch)


def _reach(m: int, n: int, score: int, match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[int, int]:
    """How far ``i - j`` and ``j - i`` go on alignments of at least ``score``.

    Through a cell with ``i - j = d`` at most ``m - d`` bases pair; with ``j - i = e`` at most ``min(m, n - e)``, and e bases of the right sequence at least stand in gaps.
    """
    down = m - -(-score // match)
    rest = score - gap_extend + gap_open
    across = min((match * m - rest) // gap_extend if gap_extend else n, (match * n - rest) // (match + gap_extend))
    return max(0, min(m, down)), max(0, min(n, across))


def _groups(a: list[np.ndarray], b: list[np.ndarray], bands: dict[int, tuple[int, int]]) -> Iterator[list[int]]:
    """Pairs of similar bands and lengths, as many as are worked on at a time."""
    wide = {k: min(sum(band), len(a[k]) + len(b[k])) + 1 for k, band in bands.items()}
    level = lambda k: max(6, wide[k].bit_length())
    part: list[int] = []
    for k in sorted(bands, key=lambda k: (level(k), len(a[k]), len(b[k]))):
        if part and (level(k) != level(part[0]) or len(a[k]) > longest or len(part) >= most):
            yield part
            part = []
        if not part:
            steps, span, longest = len(a[k]) + len(b[k]) + 1, min(wide[k] // 2, len(a[k]), len(b[k])) + 1, len(a[k]) * 5 // 4 + 64
            most = max(1, min(1024, max(8, _WORK // span), _TRACE // (steps * span)))
        part.append(k)
    if part:
        yield part


def _fill(a: list[np.ndarray], b: list[np.ndarray], part: list[int], bands: dict[int, tuple[int, int]], costs: tuple[int, int, int, int], back: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Scores and right ends of the best alignments within the bands of a group, and with ``back`` their columns (0 a pair, 1 a gap in the right, 2 one in the left).

    A step does the cells of one sum ``i + j`` of all pairs; ``i`` is the first axis. None of them depends on another of its step.
    """
    match, mismatch, gap_open, gap_extend = costs
    size, ms, ns = len(part), np.array([len(a[k]) for k in part]), np.array([len(b[k]) for k in part])
    m, n = int(ms.max()), int(ns.max())
    hi, lo = max(bands[k][0] for k in part), max(1, max(bands[k][1] for k in part))  # so that every step has cells up to the end
    far = max(abs(match), abs(mismatch), abs(gap_extend)) * (m + n + 2) + 2 * abs(gap_open)
    kind, low = (np.int16, -16000) if far < 16000 else (np.int32, -(1 << 28))
    x, y = np.zeros((m + 1, size), np.uint8), np.ones((n + 1, size), np.uint8)
    for c, k in enumerate(part):
        x[1 : ms[c] + 1, c] = a[k]
        y[n - ns[c] : n, c] = b[k][::-1]  # base j at n - j
    h = [np.full((m + 3, size), low, kind) for _ in range(3)]  # cell i at i + 1
    down, across, here = ([np.full((m + 3, size), low, kind) for _ in range(2)] for _ in range(3))
    shape = (min(m, n, (hi + lo) // 2 + 1) + 1, size)
    opened, longer, pair = (np.empty(shape, kind) for _ in range(3))
    same, other, third = (np.empty(shape, bool) for _ in range(3))
    best, ends, each = np.full(size, low, kind), np.zeros(size, np.int64), np.arange(size)
    sums = np.arange(int((ms + ns).max()) + 1)
    lows, highs = np.maximum(np.maximum(sums - n, 0), -((lo - sums) // 2)), np.minimum(np.minimum(sums, m), (sums + hi) // 2)
    rows = np.maximum(0, highs - lows + 1)
    base = (np.cumsum(rows) - rows - lows) * size  # of cell i = 0 of a step
    trace = np.empty(int(rows.sum()) * size if back else 0, np.uint8)
    first = max(ms.min(), (2 * ms - hi).min())
    go, ge, gain, loss = (kind(v) for v in (gap_open, gap_extend, match - mismatch, mismatch))
    for s, (l, r) in enumerate(zip(lows.tolist(), highs.tolist())):
        if l > r:
            break
        now, w = h[s % 3], slice(l + 1, r + 2)
        before, two = h[(s + 2) % 3], h[(s + 1) % 3]
        d0, d1, e0, e1, p0, p1 = down[s % 2], down[1 - s % 2], across[s % 2], across[1 - s % 2], here[s % 2], here[1 - s % 2]
        z = r - l + 1
        o, g, v, q, f, t = opened[:z], longer[:z], pair[:z], same[:z], other[:z], third[:z]
        np.subtract(before[l : r + 1], go, out=o)
        np.subtract(d1[l : r + 1], ge, out=g)
        np.maximum(o, g, out=d0[w])
        if back:
            np.greater(g, o, out=t)
            code = trace[base[s] + l * size : base[s] + (r + 1) * size].reshape(z, size)
            np.copyto(code, t.view(np.uint8))
        np.subtract(p1[w], go, out=o)
        np.subtract(e1[w], ge, out=g)
        np.maximum(o, g, out=e0[w])
        if back:
            np.greater_equal(g, o, out=t)
            t = t.view(np.uint8)
            t += t
            code += t
            code += code
            code += code  # sums, as shifts are slow
        np.equal(x[l : r + 1], y[n - s + l : n - s + r + 1], out=q)
        np.copyto(v, q)
        v *= gain
        v += loss
        v += two[l : r + 1]
        np.maximum(v, d0[w], out=p0[w])
        if l == 0:  # the left sequence hasn't begun: one gap in it
            start = -gap_open - (s - 1) * gap_extend if s else 0
            d0[1], e0[1], p0[1] = low, low, low
            now[1] = start
        if r == s:  # nor the right one, which is free
            d0[s + 1], e0[s + 1], p0[s + 1] = low, low, 0
        np.maximum(p0[w], e0[w], out=now[w])
        if l == 0:
            now[1] = start
        if back:
            np.not_equal(now[w], v, out=q)
            np.not_equal(now[w], d0[w], out=f)
            f &= q
            code += q.view(np.uint8)
            code += f.view(np.uint8)
            if l == 0:
                code[0] = 2 | (8 if s > 1 else 0)
        for arr in (now, d0, e0, p0):
            arr[l] = arr[r + 2] = low
        if s >= first:
            js = s - ms
            ok = (js >= 0) & (js <= ns) & (ms >= l) & (ms <= r)
            value = now[ms + 1, each]
            ok &= value > best
            best[ok] = value[ok]
            ends[ok] = js[ok]
    if not back:
        return best, ends, []
    i, j, state, steps = ms.copy(), ends.copy(), np.zeros(size, np.int64), []
    while (live := j > 0).any():
        t = trace[np.where(live, base[i + j] + i * size + each, 0)]
        op = np.where(state == 0, t & 3, state)
        state = np.where(op == 1, t >> 2 & 1, np.where(op == 2, t >> 2 & 2, 0))
        op = np.where(live, op, 3)
        i -= (op == 0) | (op == 1)
        j -= (op == 0) | (op == 2)
        steps.append(op.astype(np.uint8))
    if not steps:
        return best, ends, [np.zeros(0, np.uint8)] * size
    columns = np.ascontiguousarray(np.array(steps[::-1]).T)
    return best, ends, [c[c != 3] for c in columns]


def _spell(text: str, codes: np.ndarray, has: np.ndarray) -> str:
    """The text with a gap where a column has none of its letters."""
    if not text.isascii():
        letters = iter(text)
        return "".join(next(letters) if h else "-" for h in has)
    out = np.full(len(has), 45, np.uint8)
    out[has] = codes
    return out.tobytes().decode("ascii")


def column_stats(left: str, right: str) -> tuple[int, int, int, int]:
    """Matches, mismatches, insertions (gap on the left) and deletions (gap on the right); columns with two gaps don't count."""
    a, b = np.frombuffer(left.encode("latin-1", "replace"), np.uint8), np.frombuffer(right.encode("latin-1", "replace"), np.uint8)
    no_a, no_b = a == 45, b == 45
    both = ~no_a & ~no_b
    match = int((both & (a == b)).sum())
    return match, int(both.sum()) - match, int((no_a & ~no_b).sum()), int((no_b & ~no_a).sum())


def refine(candidates: DataFrame, reads: DataFrame, margin: int = 20, min_overlap: int = 100, max_error_rate: float = 0.2, group: int = 64, align: Callable = align_batch) -> DataFrame:
    """Candidates with their alignment, error statistics and ``accepted``.

    ``candidates`` as made from alignment records; the regions of the hints, widened by ``margin``, are aligned in the orientations of the candidate
    (the whole read where a region is empty), by ``align``, which takes and gives what :func:`align_batch` does, ``group`` pairs at a time if it is another. Candidates of reads that aren't in ``reads`` are left out; an empty input gives no row.
    """
    import pyarrow as pa

    from ..functions.seq import clamp_slice, oriented
    from ..session import ship

    ship(reads.sparkSession)
    whole = align is align_batch  # it forms groups itself

    a, b = reads.select(F.col("rid").alias("left_id"), F.col("seq").alias("x")), reads.select(F.col("rid").alias("right_id"), F.col("seq").alias("y"))
    d = candidates.join(a, "left_id").join(b, "right_id")
    d = d.withColumns({"x": oriented("x", "left_orientation"), "y": oriented("y", "right_orientation"), "ls": F.greatest(F.lit(0), F.col("left_start_hint") - margin).cast("bigint")})
    region_x, region_y = clamp_slice("x", F.col("ls"), F.length("x")), clamp_slice("y", F.lit(0), F.col("right_end_hint") + margin)
    d = d.select(
        "left_id", "right_id", "left_orientation", "right_orientation",
        F.when(region_x == "", F.lit(0).cast("bigint")).otherwise(F.col("ls")).alias("ls"), F.when(region_x == "", F.col("x")).otherwise(region_x).alias("x"), F.when(region_y == "", F.col("y")).otherwise(region_y).alias("y"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            order = sorted(range(batch.num_rows), key=lambda i: (len(cols[5][i]), len(cols[6][i])))
            rows: list = []
            most = max(1, len(order)) if whole else group
            for s in range(0, len(order), most):
                part = order[s : s + most]
                for i, (score, p, q, start, end) in zip(part, align([cols[5][i] for i in part], [cols[6][i] for i in part])):
                    match, miss, ins, dele = column_stats(p, q)
                    length = match + miss + ins + dele
                    ls = cols[4][i] + start
                    rows.append((*[c[i] for c in cols[:4]], p, q, ls, cols[4][i] + len(cols[5][i]), 0, end, float(score), match, miss, ins, dele, ins + dele, miss + ins + dele, length))
            fields = zip(*rows) if rows else [[]] * 18
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.float64(), *[pa.int64()] * 7]
            names = ["left_id", "right_id", "left_orientation", "right_orientation", *[x.split()[0] for x in ALIGNMENT.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, kinds)], names)

    e = d.mapInArrow(run, "left_id string, right_id string, left_orientation int, right_orientation int, " + ALIGNMENT)
    n = F.col("alignment_length")
    e = e.withColumns({"overlap_len": n, "shift": F.col("left_start") - F.col("right_start"), "error_rate": F.when(n > 0, F.col("edit_distance") / n).otherwise(1.0), "identity": F.when(n > 0, F.col("matches") / n).otherwise(0.0), "dp_score": F.col("score"), "weight_dp": F.col("score")})
    return e.withColumn("accepted", (n >= min_overlap) & (F.col("error_rate") <= max_error_rate))
