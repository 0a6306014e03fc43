"""Overlaps between sequences, found as equi-joins on seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import revcomp
from ..session import materialize, ship
from .ranking import global_rank
from .skew import blocked_join

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def duplicate_classes(reads: DataFrame) -> DataFrame:
    """Reads with equal sequences as one class: ``class_id`` (smallest rid), ``seq``, ``n``. Null ids and sequences are left out."""
    return reads.where("rid is not null and seq is not null").groupBy("seq").agg(F.min("rid").alias("class_id"), F.count_distinct("rid").alias("n"))


def class_members(reads: DataFrame) -> DataFrame:
    """``rid`` with its ``class_id``."""
    return reads.join(duplicate_classes(reads).select("class_id", "seq"), "seq").select("rid", "class_id").distinct()


def exact_overlaps(reads: DataFrame, min_overlap: int, allow_self: bool = False, allow_full_length: bool = True) -> DataFrame:
    """Every pair of classes where a suffix of one is a prefix of the other, at its longest: ``src``, ``dst``, ``overlap``.

    The first ``min_overlap`` bases of a suffix are the seed: their hashes meet in an equi-join with the hashes of all prefixes, and only matches fetch the
    sequences, to be verified in full. Sequences shorter than ``min_overlap`` overlap nothing.
    """
    c = duplicate_classes(reads).where(F.length("seq") >= min_overlap).select("class_id", F.col("seq").cast("binary").alias("b"))
    m = F.lit(min_overlap)
    size = F.octet_length("b")
    first = F.lit(1) if allow_full_length else F.lit(2)
    suffixes = c.where(size - m + 1 >= first).select(
        F.col("class_id").alias("src"), F.posexplode(F.transform(F.sequence(first, size - m + 1), lambda p: F.xxhash64(F.substring("b", p, m)))).alias("i", "seed")
    )
    prefixes = c.select(F.col("class_id").alias("dst"), F.xxhash64(F.substring("b", F.lit(1), m)).alias("seed"))
    hits = suffixes.join(prefixes, "seed").select("src", "dst", (F.col("i") + first).alias("at"))
    if not allow_self:
        hits = hits.where("src <> dst")
    left, right = c.select(F.col("class_id").alias("src"), F.col("b").alias("x")), c.select(F.col("class_id").alias("dst"), F.col("b").alias("y"))
    full = hits.join(left, "src").join(right, "dst").withColumn("overlap", F.octet_length("x") - F.col("at") + 1)
    limit = F.col("overlap") <= F.octet_length("y") if allow_full_length else F.col("overlap") < F.octet_length("y")
    good = full.where(limit & (F.substring("x", F.col("at"), F.col("overlap")) == F.substring("y", F.lit(1), F.col("overlap"))))
    return good.groupBy("src", "dst").agg(F.max("overlap").cast("bigint").alias("overlap"))


def best_outgoing(overlaps: DataFrame) -> DataFrame:
    """The longest overlap of each ``src``, of equal ones that of the smallest ``dst``."""
    best = Window.partitionBy("src").orderBy(F.desc("overlap"), "dst")
    return overlaps.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def expand_classes(overlaps: DataFrame, members: DataFrame) -> DataFrame:
    """Overlaps of classes as overlaps of all their reads: ``left_id``, ``right_id``, ``overlap``."""
    left, right = members.select(F.col("rid").alias("left_id"), F.col("class_id").alias("src")), members.select(F.col("rid").alias("right_id"), F.col("class_id").alias("dst"))
    return overlaps.join(left, "src").join(right, "dst").select("left_id", "right_id", "overlap")


def minimizers(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """``sid``, ``pos``, ``h``, ``n`` (length of the sequence), ``other`` (its letters but A, C, G, T): in every w windows of k bases in a row, the one with the smallest hash, the first of equal ones; windows with other letters don't count.

    Two sequences with w+k-1 equal bases in a row share a minimizer there.
    """
    import pyarrow as pa

    ship(seqs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, hs, sizes, others = [], [], [], [], []
            for sid, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = _CODE[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
                n = len(c) - k + 1
                if n < 1:
                    continue
                x = np.zeros(n, np.uint64)
                for j in range(k):
                    x = (x << np.uint64(2)) | (c[j : j + n].astype(np.uint64) & np.uint64(3))
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(32))) >> np.uint64(1)
                bad = np.concatenate([[0], np.cumsum(c == 4)])
                top = np.uint64(1 << 63)
                x[bad[k:] != bad[:n]] = top
                v = np.lib.stride_tricks.sliding_window_view(x, min(w, n))
                at = np.unique(v.argmin(axis=1) + np.arange(len(v)))
                at = at[x[at] != top]
                ids += [sid] * len(at)
                pos.append(at)
                hs.append(x[at])
                sizes.append(np.full(len(at), len(c)))
                others.append(np.full(len(at), bad[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(np.concatenate(pos or [[]]).astype(np.int64)), pa.array(np.concatenate(hs or [[]]).astype(np.uint64).view(np.int64)), *[pa.array(np.concatenate(y or [[]]).astype(np.int64)) for y in (sizes, others)]], ["sid", "pos", "h", "n", "other"])

    return seqs.select("sid", "seq").mapInArrow(run, f"sid {seqs.schema['sid'].dataType.simpleString()}, pos bigint, h bigint, n bigint, other bigint")


def ungapped_overlaps(reads: DataFrame, min_overlap: int, min_identity: float, k: int = 13, w: int = 10, strands: bool = False) -> DataFrame:
    """Best ungapped suffix-prefix overlap of each ordered pair: ``left_id``, ``right_id``, ``orientation`` (of the right read), ``overlap``, ``matches``.

    Best by identity, then length, then orientation. An overlap of L bases with d mismatches has L/(d+1) equal bases in a row,
    so every pair is found while ``w + k - 1`` is at most that for ``min_overlap`` at ``min_identity``; else this raises. Seeds are met by an equi-join, no pair is formed without one.
    """
    import pyarrow as pa

    if w + k - 1 > min_overlap // (int((1 - min_identity) * min_overlap + 1e-9) + 1):
        raise ValueError("seeds too long for these limits; choose a smaller k or w")
    # hits name reads by numbers; shifts of too short or too long an overlap, and those with fewer seeds than any overlap of this identity has, go before sequences are fetched,
    # and only the part of the left read that can overlap is sent to the right one
    r, _ = materialize(reads.where("seq is not null").select(F.monotonically_increasing_id().alias("id"), "rid", "seq"), "numbered")
    left = minimizers(r.select(F.col("id").alias("sid"), "seq"), k, w).select(F.col("sid").alias("left_no"), F.col("pos").alias("i"), "h", F.col("n").alias("n_left"), F.col("other").alias("o_left"))
    left, _ = materialize(left, "seeds")
    right = left.select((F.col("left_no") * 2).alias("right_no"), F.col("i").alias("j"), "h", F.col("n_left").alias("n_right"), F.col("o_left").alias("o_right"))
    if strands:
        back = minimizers(r.select((F.col("id") * 2 + 1).alias("sid"), revcomp("seq").alias("seq")), k, w)
        right = right.unionByName(materialize(back.select(F.col("sid").alias("right_no"), F.col("pos").alias("j"), "h", F.col("n").alias("n_right"), F.col("other").alias("o_right")), "targets")[0])
    size = F.col("n_left") - F.col("i") + F.col("j")
    fits = (F.col("left_no") != F.shiftright("right_no", 1)) & (F.col("i") >= F.col("j")) & (size >= min_overlap) & (size <= F.col("n_right"))
    # of its windows of w + k - 1 bases every mismatch spoils as many at most; the others have a shared seed each, which up to w of them share
    whole = size - (w + k - 2) - (w + k - 1) * F.floor(F.lit(1 - min_identity) * size + F.lit(1e-6))
    least = F.when(F.col("o_left") + F.col("o_right") > 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(whole / w)))
    hits = blocked_join(left, right, "h", 1000).where(fits).select("left_no", "right_no", (F.col("i") - F.col("j")).alias("shift"), least.cast("bigint").alias("least"))
    shifts = hits.groupBy("left_no", "right_no", "shift").agg(F.count(F.lit(1)).alias("seeds"), F.max("least").alias("least")).where("seeds >= least")
    each = shifts.groupBy("left_no", "right_no").agg(F.collect_list("shift").alias("shifts"), F.min("shift").alias("first"))  # fewer than the left read has bases
    x, y = r.select(F.col("id").alias("left_no"), F.col("seq").alias("x")), r.select(F.col("id").alias("right"), F.col("seq").alias("y"))
    part = F.expr("substring(x, cast(first + 1 as int))")
    pairs = each.join(x, "left_no").select("left_no", F.shiftright("right_no", 1).alias("right"), F.when(F.col("right_no") % 2 == 0, 1).otherwise(-1).alias("orientation"), part.alias("x"), F.transform("shifts", lambda s: s - F.col("first")).alias("shifts"))
    pairs = pairs.join(y, "right").select("left_no", "right", "orientation", "x", F.when(F.col("orientation") == 1, F.col("y")).otherwise(revcomp("y")).alias("y"), "shifts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, overlaps, matches = [], [], []
            for i, (x, y, own) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                u, v = np.frombuffer(x.encode("latin-1", "replace"), np.uint8), np.frombuffer(y.encode("latin-1", "replace"), np.uint8)
                for s in own:
                    n = len(u) - s
                    if min_overlap <= n <= len(v):
                        rows.append(i)
                        overlaps.append(n)
                        matches.append(int((u[s:] == v[:n]).sum()))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(3)], pa.array(overlaps, pa.int64()), pa.array(matches, pa.int64())], ["left_no", "right", "orientation", "overlap", "matches"])

    scored = pairs.mapInArrow(count, "left_no bigint, right bigint, orientation int, overlap bigint, matches bigint")
    scored = scored.where(F.col("matches") >= F.col("overlap") * F.lit(min_identity) - F.lit(1e-9))
    name = lambda no, side: r.select(F.col("id").alias(no), F.col("rid").alias(f"{side}_id"))
    scored = scored.join(name("left_no", "left"), "left_no").join(name("right", "right"), "right").where("left_id <> right_id").select("left_id", "right_id", "orientation", "overlap", "matches")
    best = Window.partitionBy("left_id", "right_id").orderBy(F.desc(F.col("matches") / F.col("overlap")), F.desc("overlap"), F.desc("orientation"))
    return scored.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def seed_chains(reads: DataFrame, k: int = 15, w: int = 5, band: int = 64, min_seeds: int = 3, block: int = 1000) -> DataFrame:
    """Approximate overlaps of any two reads in either orientation, as alignment records without bases: seeds of a pair on neighbouring diagonals are one chain.

    Columns as of parsed alignment records; ``n_match`` is seeds times k at most the shorter interval, ``block`` the longer interval. Reads with equal sequences are one, named by
    the smallest id (see :func:`class_members`). Every seed is followed, those of more than ``block`` occurrences in blocks.
    """
    # seeds and hits name reads by their ranks by id, those of targets doubled, odd ones for the other strand
    reads, _ = materialize(global_rank(duplicate_classes(reads).select(F.col("class_id").alias("rid"), "seq"), [F.col("rid")], "no"), "classes")
    fwd, _ = materialize(minimizers(reads.select(F.col("no").alias("sid"), "seq"), k, w).select(F.col("sid").alias("q_no"), F.col("pos").cast("int").alias("i"), "h"), "seeds")
    rc = minimizers(reads.select((F.col("no") * 2 + 1).alias("sid"), revcomp("seq").alias("seq")), k, w)
    rc, _ = materialize(rc.select(F.col("sid").alias("t_no"), F.col("pos").cast("int").alias("j"), "h"), "targets")
    both = fwd.select((F.col("q_no") * 2).alias("t_no"), F.col("i").alias("j"), "h").unionByName(rc)
    hits = blocked_join(fwd, both, "h", block).where(F.col("q_no") < F.shiftright("t_no", 1))
    hits = hits.select("q_no", "t_no", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.floor((F.col("i") - F.col("j")) / F.lit(band)).alias("bin"))
    chains = hits.groupBy("q_no", "t_no", "bin").agg(
        F.count(F.lit(1)).alias("seeds"), F.min("i").alias("q_st"), (F.max("i") + k).alias("q_en"), F.min("j").alias("o_st"), (F.max("j") + k).alias("o_en")
    ).where(F.col("seeds") >= min_seeds)
    best = Window.partitionBy("q_no", "t_no").orderBy(F.desc("seeds"), "bin")
    one = chains.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    one = one.withColumns({"strand": F.when(F.col("t_no") % 2 == 0, "+").otherwise("-"), "t_no": F.shiftright("t_no", 1)})
    ln = lambda side: reads.select(F.col("no").alias(f"{side}_no"), F.col("rid").alias(f"{side}_id"), F.length("seq").cast("bigint").alias(f"{side}_len"))
    d = one.join(ln("q"), "q_no").join(ln("t"), "t_no")
    plus = F.col("strand") == "+"
    # a chain that ends near the ends of both reads is extended to them
    before, after = F.least("q_st", "o_st"), F.least(F.col("q_len") - F.col("q_en"), F.col("t_len") - F.col("o_en"))
    d = d.withColumns({"q_st": F.col("q_st") - before, "o_st": F.col("o_st") - before, "q_en": F.col("q_en") + after, "o_en": F.col("o_en") + after})
    d = d.withColumns({"t_st": F.when(plus, F.col("o_st")).otherwise(F.col("t_len") - F.col("o_en")), "t_en": F.when(plus, F.col("o_en")).otherwise(F.col("t_len") - F.col("o_st"))})
    block = F.greatest(F.col("q_en") - F.col("q_st"), F.col("t_en") - F.col("t_st"))
    shorter = F.least(F.col("q_en") - F.col("q_st"), F.col("t_en") - F.col("t_st"))
    return d.select("q_id", "q_len", "q_st", "q_en", "strand", "t_id", "t_len", "t_st", "t_en", F.least(shorter, F.col("seeds") * k).alias("n_match"), block.alias("block"), F.least(F.lit(60).cast("bigint"), F.col("seeds") * 3).alias("mapq"))


def contained_sequences(reads: DataFrame, seed: int = 31) -> DataFrame:
    """Reads whose sequence lies in a longer one: ``rid``, ``container_id`` (the longest, of equal ones the smallest id).

    The first ``seed`` bases of the shorter read meet every window of the longer ones in an equi-join; matches are verified in full. Reads shorter than the seed are contained in none.
    """
    r = reads.where(F.length("seq") >= seed).select("rid", F.col("seq").cast("binary").alias("b"))
    n = F.octet_length("b")
    windows = r.select(F.col("rid").alias("container_id"), F.posexplode(F.transform(F.sequence(F.lit(1), n - seed + 1), lambda p: F.xxhash64(F.substring("b", p, F.lit(seed))))).alias("i", "h"))
    heads = r.select("rid", F.xxhash64(F.substring("b", F.lit(1), F.lit(seed))).alias("h"), n.alias("n"))
    hits = heads.join(windows, "h").where("rid <> container_id").select("rid", "container_id", (F.col("i") + 1).alias("at"), "n")
    j = hits.join(r.select("rid", F.col("b").alias("x")), "rid").join(r.select(F.col("rid").alias("container_id"), F.col("b").alias("y")), "container_id")
    j = j.where((F.octet_length("y") > F.col("n")) & (F.substring("y", F.col("at"), F.col("n")) == F.col("x")))
    best = Window.partitionBy("rid").orderBy(F.desc(F.octet_length("y")), "container_id")
    return j.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("rid", "container_id")
