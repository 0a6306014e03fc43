"""Pairs of sequences with largely the same windows, by covering locality-sensitive hashing.

A sequence's set of canonical windows gets a sketch of minimum hashes, cut into groups of 2^(r+1)-1 coordinates. Within
a group, coordinate i (a non-zero vector of r+1 bits) belongs to the mask of v where the scalar product of i and v is
odd; any r coordinates are missed by some mask, so two sketches that differ in at most r coordinates of some group -
hence any two that differ in fewer than groups*(r+1) coordinates - collide in a table. Candidates are verified on the
full sets. The guarantee is one on sketches: with 20 groups and r = 1, a pair of sets of similarity 0.5 is missed with a probability of 10^-6, others above it more rarely.

A sketch needs one hash a window: the hash's upper part chooses the coordinate, which keeps its smallest hash; a coordinate without
a window takes the one of another, tried in an order of its own that is the same for all sets. As windows of small sets often meet in a
coordinate, sets of fewer than ``SMALL`` windows have a second sketch of independent hashes; similar sets are of similar size, so
none below half of ``SMALL`` depends on the first.

Sequences with equal sets are one class from the start, and only classes are compared. A bucket of more than ``most``
classes is refined by a second, independent family of the same kind; buckets are compared in pairs of blocks, however large they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, materialize, ship
from .bases import canonical_sets, codes, mix64

#: Sets of fewer windows have two sketches.
SMALL = 240
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def covering_masks(radius: int) -> np.ndarray:
    """Boolean masks (tables x coordinates) that miss any ``radius`` of the 2^(radius+1)-1 coordinates in at least one table."""
    n = 1 << radius + 1
    return np.array([[bin(i & v).count("1") & 1 for i in range(1, n)] for v in range(1, n)], bool)


def sketches(values: np.ndarray, starts: np.ndarray, size: int, family: int) -> np.ndarray:
    """For each set (``values`` from one of ``starts`` to the next) ``size`` minimum hashes; those of an empty set are all the same."""
    n = len(starts) - 1
    h = mix64(values ^ mix64(np.array([family + 1], np.uint64)))
    cell = np.repeat(np.arange(n), np.diff(starts)) * size + ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, h = cell[order], mix64(h[order] + np.uint64(1))
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    out = np.full(n * size, _NONE)
    if len(first):
        out[cell[first]] = np.minimum.reduceat(h, first)
    out = out.reshape(n, size)
    full = out != _NONE
    row, column = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        other = (mix64(column.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(size)).astype(np.int64)
        found = full[row, other]
        out[row[found], column[found]] = mix64(out[row[found], other[found]] + column[found].astype(np.uint64))
        row, column = row[~found], column[~found]
    return out


def independent_sketches(values: np.ndarray, starts: np.ndarray, size: int, family: int) -> np.ndarray:
    """For each set ``size`` minimum hashes, each of a hash function of its own; no set may be empty."""
    rng = np.random.default_rng(1000 + family)
    odd = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, size, np.uint64)
    x = mix64(values + np.uint64(1))
    return np.stack([np.minimum.reduceat(x * o + a, starts[:-1]) for o, a in zip(odd, add)], axis=1)


def keys_of(values: np.ndarray, starts: np.ndarray, groups: int, radius: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all sets, one after another, and where those of each begin."""
    size = groups * ((2 << radius) - 1)
    first = table_keys(sketches(values, starts, size, family), groups, radius, 2 * family)
    n = np.diff(starts)
    small = np.flatnonzero((n > 0) & (n < SMALL))
    counts = np.full(len(n), first.shape[1])
    counts[small] *= 2
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(begin[-1], np.int64)
    out[begin[:-1, None] + np.arange(first.shape[1])] = first
    if len(small):
        own = np.concatenate([values[starts[i] : starts[i + 1]] for i in small])
        again = table_keys(independent_sketches(own, np.concatenate([[0], np.cumsum(n[small])]), size, family), groups, radius, 2 * family + 1)
        out[begin[small, None] + first.shape[1] + np.arange(first.shape[1])] = again
    return out, begin


def table_keys(coords: np.ndarray, groups: int, radius: int, family: int = 0) -> np.ndarray:
    """The keys of sketches (rows) in every table (columns)."""
    masks = covering_masks(radius)
    c = coords.reshape(len(coords), groups, 1, masks.shape[1])
    h = np.arange(groups * len(masks), dtype=np.uint64).reshape(1, groups, len(masks)) + np.uint64(family << 32)
    h = np.broadcast_to(h, (len(coords), groups, len(masks))).copy()
    for i in range(masks.shape[1]):
        h = np.where(masks[:, i], mix64(h ^ c[..., i]), h)
    return h.reshape(len(coords), -1).view(np.int64)


def pack(seq: str) -> bytes:
    """Half a byte a base; all letters but A, C, G, T are alike."""
    c = codes(seq)
    if len(c) & 1:
        c = np.append(c, np.uint8(4))
    return (c[::2] << 4 | c[1::2]).tobytes()


_LETTERS = [f"{a}{b}" for a in "ACGTN" for b in "ACGTN"]
_PAIR = np.zeros(256, np.uint16)
for _i, _p in enumerate(_LETTERS):
    _PAIR[_i // 5 << 4 | _i % 5] = ord(_p[0]) | ord(_p[1]) << 8


def unpack(packed: bytes) -> str:
    return _PAIR[np.frombuffer(packed, np.uint8)].astype("<u2").tobytes().decode("ascii")


def _with_keys(df: DataFrame, k: int, groups: int, radius: int, family: int) -> DataFrame:
    """``uid``, ``packed`` to ``uid``, ``keys``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0)
            for lo, hi, values, starts in canonical_sets([unpack(p) for p in batch.column(1).to_pylist()], k):
                keys, begin = keys_of(values, starts, groups, radius, family)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([uid.slice(lo, hi - lo), lists], ["uid", "keys"])

    return df.select("uid", "packed").mapInArrow(run, "uid bigint, keys array<bigint>")


def _block_pairs(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Pairs ``a`` < ``b`` within buckets (``key``, ``uid``) of ``sizes`` (``key``, ``n``): a task gets pairs of blocks of about ``block`` members."""
    s = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    left = rows.join(s, "key").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks").cast("bigint")).cast("int"))
    right = left.select("key", F.col("own").alias("other"), F.col("uid").alias("b"))
    left = left.select("key", F.col("uid").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return left.join(right, ["key", "other"]).where("a < b").select("a", "b")


def candidates(classes: DataFrame, k: int, groups: int, radius: int, most: int) -> tuple[DataFrame, list[str]]:
    """Pairs of classes (``a`` < ``b``) that collide in a table, and the tables written on the way, to be dropped when they have been read.

    Count, least, greatest and exclusive-or of a bucket's members, summed before the shuffle, give the pairs of buckets of two or three; only members of larger buckets are shuffled.
    """
    exploded = _with_keys(classes, k, groups, radius, 0).select(F.explode("keys").alias("key"), "uid")
    keys, keys_path = materialize(exploded, "keys")
    state = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.bit_xor("uid").alias("x")).where("n > 1")
    state, state_path = materialize(state, "buckets")
    mid = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    pairs = state.where("n <= 3").select(F.explode(F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, mid), pair(mid, hi)))).alias("p")).select("p.a", "p.b")
    paths = [keys_path, state_path]
    more = state.where("n > 3").select("key", "n")
    if not more.isEmpty():
        pairs = pairs.unionByName(_block_pairs(keys, more.where(f"n <= {most}"), most))
    large = more.where(f"n > {most}").select("key")
    if not large.isEmpty():
        held, held_path = materialize(keys.join(large, "key"), "large")
        again = _with_keys(classes.join(held.select("uid").distinct(), "uid"), k, groups, radius, 1)
        finer, finer_path = materialize(held.join(again, "uid").select(F.explode("keys").alias("k2"), "key", "uid").select(F.xxhash64("key", "k2").alias("key"), "uid"), "finer")
        pairs = pairs.unionByName(_block_pairs(finer, finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), most))
        paths += [held_path, finer_path]
    return pairs.distinct(), paths


def near_duplicates(
    df: DataFrame, id_col: str, seq_col: str, k: int = 21, similarity: tuple[int, int] = (1, 2), groups: int = 20, radius: int = 1, most: int = 256
) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal window sets, and the members of the classes.

    ``links``: ``class_a`` < ``class_b`` with at least ``similarity`` (numerator, denominator) of the joint windows shared, and ``single``, whether either class has one member only.
    ``members``: ``class_id`` (its smallest id), ``id`` and ``single``, for every sequence with a window. Null ids, null and empty sequences and
    those without a window of ``k`` bases of A, C, G, T are in neither; repeated rows count once; other columns are not read.
    A digest of 128 bits stands for a set. A pair in buckets of more than ``most`` classes only has to collide in the second family as well, so
    it's missed at most twice as often.
    """
    import pyarrow as pa

    spark = df.sparkSession
    ship(spark)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            for lo, hi, values, starts in canonical_sets(seqs, k):
                some = np.flatnonzero(np.diff(starts))
                if len(some):
                    h = mix64(values + np.uint64(1))
                    d1 = np.add.reduceat(h, starts[some])
                    d2 = np.add.reduceat(mix64(h ^ np.uint64(0x9E3779B97F4A7C15)), starts[some])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(some + lo)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([pack(seqs[i + lo]) for i in some], pa.binary())], ["id", "d1", "d2", "packed"]
                    )

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(seq_col).alias("seq")).where("id is not null and seq <> ''")
    rows, rows_path = materialize(rows.mapInArrow(classify, "id string, d1 bigint, d2 bigint, packed binary"), "windows")
    classes = rows.groupBy("d1", "d2").agg(F.min_by("packed", "id").alias("packed"), F.min("id").alias("class_id"), (F.min("id") == F.max("id")).alias("single"))
    classes, classes_path = materialize(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")  # once written, uid is fixed
    members, _ = materialize(rows.select("d1", "d2", "id").distinct().join(classes.select("d1", "d2", "class_id", "single"), ["d1", "d2"]).select("class_id", "id", "single"), "members")
    pairs, paths = candidates(classes, k, groups, radius, most)
    num, den = similarity

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep: list[int] = []
            for p in range(0, len(a), 512):
                seqs = {**dict(zip(a[p : p + 512], x[p : p + 512])), **dict(zip(b[p : p + 512], y[p : p + 512]))}
                names, sets = list(seqs), {}
                for lo, hi, values, starts in canonical_sets([unpack(seqs[n]) for n in names], k):
                    sets.update((names[i + lo], values[starts[i] : starts[i + 1]]) for i in range(hi - lo))
                for i in range(p, min(p + 512, len(a))):
                    s, t = sets[a[i]], sets[b[i]]
                    if min(len(s), len(t)) * den < max(len(s), len(t)) * num:
                        continue
                    both = np.sort(np.concatenate([s, t]))
                    both = int((both[1:] == both[:-1]).sum())
                    if both * den >= (len(s) + len(t) - both) * num:
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(4).take(at)], ["class_a", "class_b", "single"])

    one = lambda side: classes.select(F.col("uid").alias(side), F.col("class_id").alias(f"c{side}"), F.col("packed").alias(f"s{side}"), F.col("single").alias(f"one{side}"))
    full = pairs.join(one("b"), "b").join(one("a"), "a").select("ca", "cb", "sa", "sb", F.expr("onea and oneb").alias("single"))
    links = full.mapInArrow(verify, "class_a string, class_b string, single boolean")
    links, _ = materialize(links.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "single"), "pairs")
    for path in (rows_path, classes_path, *paths):
        drop(spark, path)
    return links, members


def expand_pairs(links: DataFrame, members: DataFrame, block: int = 1000) -> DataFrame:
    """All pairs ``id_a`` < ``id_b`` of members of linked classes and of one class.

    A link of two classes of one member is a pair as it is. The others are cut into blocks of about ``block`` members, and a task gets a pair of blocks, however large a class is.
    """
    single = links.where("single").select(F.col("class_a").alias("id_a"), F.col("class_b").alias("id_b")).where("id_a < id_b")
    many, _ = materialize(members.where("not single").select("class_id", "id"), "many")
    sizes = many.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).select("class_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    sizes, _ = materialize(sizes, "sizes")
    cut = many.join(sizes, "class_id").select("class_id", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int").alias("block"), "id")
    own = sizes.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.col("blocks").alias("blocks_a"), F.col("blocks").alias("blocks_b"))
    s = lambda side: sizes.select(F.col("class_id").alias(f"class_{side}"), F.col("blocks").alias(f"blocks_{side}"))
    one = lambda side: F.coalesce(f"blocks_{side}", F.lit(1)).alias(f"blocks_{side}")
    across = links.where("not single").select("class_a", "class_b").join(s("a"), "class_a", "left").join(s("b"), "class_b", "left").select("class_a", "class_b", one("a"), one("b"))
    each = (
        across.unionByName(own)
        .withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
        .withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    )
    m = lambda side: cut.select(F.col("class_id").alias(f"class_{side}"), F.col("block").alias(f"block_{side}"), F.col("id").alias(f"id_{side}"))
    p = each.join(m("a"), ["class_a", "block_a"], "left").join(m("b"), ["class_b", "block_b"], "left")
    p = p.select("class_a", "class_b", F.coalesce("id_a", "class_a").alias("id_a"), F.coalesce("id_b", "class_b").alias("id_b"))  # a class of one member is named by it
    p = p.where((F.col("class_a") != F.col("class_b")) & (F.col("id_a") != F.col("id_b")) | (F.col("id_a") < F.col("id_b")))
    return p.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(single).distinct()


def class_report(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per sequence: ``id``, ``class_id`` and ``links``, the number of other classes similar to its own."""
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
