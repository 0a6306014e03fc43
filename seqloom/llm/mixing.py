"""Mixing sources to target shares by raking (iterative proportional fitting).

Documents fall into cells of source, language and topic. The token weight of each cell is fitted to the marginals in
turn until it meets the source targets; within the caps, language and topic keep their shares of what is available. A
cell's weight over its tokens is the mean number of times its documents are used; each document gets its whole part
and, with the probability of the rest, one more, drawn from a hash of its id; a histogram of the draws of each cell calibrates the
last step, so every cell reaches its weight but for about half a document.

Topics come with the documents or are fitted: groups of documents with like words (spherical k-means over hashed word
counts, the mean of each language taken off so that topics aren't languages). Every document without a topic takes part in every round of the fit: their word counts are
written once, and each round is a scan of these. Sums are of whole numbers, so the same documents give the same model however they are spread.
"""

from __future__ import annotations

import base64
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, materialize, ship

#: Languages that are cells of their own; all others, null and ``und`` fall under ``other``.
LANGUAGES = ("en", "de", "fr", "es", "ru", "zh", "ja", "th", "hi", "ar")
#: Split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, ``_`` for ``-``."""
    return F.translate(F.lower(F.trim(source)), "-", "_")


def word_vector(text: str | None, size: int = 1024) -> np.ndarray:
    """Square roots of a text's word counts by hash of the lower-case word, at length 1; zeros for none."""
    v = np.zeros(size, np.float32)
    if text:
        found = _WORD.findall(text.lower())
        v = np.sqrt(np.bincount(np.fromiter(map(_BINS.__getitem__, found), np.int64, len(found)) % size, minlength=size)).astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v


class _Bins(dict):
    """Hashes of words met before, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


_BINS = _Bins()
_WORD = re.compile(r"[^\W\d_]{3,}|[\u3040-\u30ff\u4e00-\u9fff]{2}")


_SIZE = 1024
#: Sums of directions are of whole multiples of one over this.
_UNIT = float(1 << 26)


def word_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words below 1024 and how often each occurs."""
    found = _WORD.findall(text.lower()) if text else []
    return np.unique(np.fromiter(map(_BINS.__getitem__, found), np.int64, len(found)) % _SIZE, return_counts=True)


@dataclass(frozen=True)
class Documents:
    """Word vectors of some documents: ``at`` and ``value`` of all in a row, those of a document from ``starts`` on; ``h`` orders documents."""

    at: np.ndarray
    value: np.ndarray
    sizes: np.ndarray
    langs: list[str]
    h: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of ``x``, a row per value, over the values of each document."""
        out = np.zeros((len(self.sizes), *x.shape[1:]))
        some = self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(x, (np.cumsum(self.sizes) - self.sizes)[some], axis=0)
        return out

    def row(self, i: int) -> tuple[int, str, list[int], list[float]]:
        """What tells a document from others, smaller ones first, and suffices to build its vector."""
        end = int(self.sizes[: i + 1].sum())
        part = slice(end - int(self.sizes[i]), end)
        return int(self.h[i]), self.langs[i], self.at[part].tolist(), self.value[part].tolist()


def _dense(vectors: np.ndarray, langs: list[str]) -> Documents:
    rows, at = np.nonzero(vectors)
    return Documents(at, vectors[rows, at].astype(float), np.bincount(rows, minlength=len(vectors)), list(langs), np.arange(len(vectors)))


def _numbers(column, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary Arrow column in a row, and how many each row has; null is none."""
    parts = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(parts), kind), np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize


def _counted(at, counts, langs, h) -> Documents:
    """Documents from Arrow columns of word hashes, their counts, languages and the order."""
    where, sizes = _numbers(at, np.uint16)
    d = Documents(where.astype(np.int64), np.sqrt(_numbers(counts, np.uint32)[0].astype(float)), sizes, langs.to_pylist(), np.array(h.to_pylist(), np.int64))
    norm = np.sqrt(np.maximum(d.sums(d.value * d.value), 1e-300))
    return Documents(d.at, d.value / np.repeat(norm, sizes), sizes, d.langs, d.h)


class TopicModel:
    """Means of languages and centres of topics."""

    def __init__(self, means: dict[str, np.ndarray], centres: np.ndarray):
        self.means, self.centres = means, centres
        self.names = {x: i for i, x in enumerate(sorted(means))}
        self.table = np.array([*(means[x] for x in sorted(means)), np.zeros(_SIZE)])  # the last is for other languages

    def places(self, d: Documents) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document its cosines to the centres, the number of its language, and one over its distance from the language's mean; 0 for a document at its mean."""
        lang = np.array([self.names.get(x, len(self.names)) for x in d.langs], np.int64)
        mean = self.table[np.repeat(lang, d.sizes), d.at]
        square = d.sums((d.value - 2 * mean) * d.value) + (self.table**2).sum(axis=1)[lang]
        scale = np.where(square > 1e-8, 1 / np.sqrt(np.maximum(square, 1e-8)), 0.0)
        near = d.sums(d.value[:, None] * self.centres.T[d.at]) - (self.table @ self.centres.T)[lang]
        return np.round(near * scale[:, None], 9), lang, scale

    def direction(self, row: tuple) -> np.ndarray:
        """The vector of a :meth:`Documents.row` from the mean of its language, at length 1."""
        _, lang, at, value = row
        v = -self.means[lang]
        v[at] += value
        n = np.linalg.norm(v)
        return v / n if n > 1e-4 else np.zeros(_SIZE)

    def topics(self, vectors: np.ndarray, langs: list[str]) -> np.ndarray:
        """The number of the nearest centre for each row; 0 if there is none."""
        return self.topics_of(_dense(vectors, langs)) if len(vectors) else np.zeros(0, np.int64)

    def topics_of(self, d: Documents) -> np.ndarray:
        return self.places(d)[0].argmax(axis=1) if len(self.centres) else np.zeros(len(d.sizes), np.int64)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT)


def _sums_of_languages(d: Documents) -> tuple[dict, tuple | None]:
    """Documents and sums of vectors of each language, and the first document."""
    out = {}
    own = np.array(d.langs)
    each = np.repeat(own, d.sizes) if len(own) else own
    for x in sorted(set(d.langs)):
        out[x] = (int((own == x).sum()), np.bincount(d.at[each == x], _whole(d.value[each == x]), _SIZE).astype(np.int64))
    return out, d.row(int(d.h.argmin())) if len(d.h) else None


def _join_sums(a: tuple, b: tuple) -> tuple:
    sums = {x: tuple(m + n for m, n in zip(a[0].get(x, (0, 0)), b[0].get(x, (0, 0)))) for x in a[0] | b[0]}
    return sums, min((r for r in (a[1], b[1]) if r), default=None)


def _farthest(model: TopicModel) -> Callable[[Documents], tuple | None]:
    """The document that is farthest from all centres, of equal ones the first."""

    def run(d: Documents) -> tuple | None:
        near = model.places(d)[0].max(axis=1)
        best = np.flatnonzero(near == near.min()) if len(near) else []
        return min(((float(near[i]), *d.row(int(i))) for i in best[np.argsort(d.h[best], kind="stable")][:1]), default=None) if len(best) else None

    return run


def _moved(model: TopicModel) -> Callable[[Documents], np.ndarray]:
    """Of every centre's documents: sums of vectors over their distance, of one over it by language, and the number."""

    def run(d: Documents) -> np.ndarray:
        near, lang, scale = model.places(d)
        own, k, n = near.argmax(axis=1), len(model.centres), len(model.table)
        sums = np.bincount(np.repeat(own, d.sizes) * _SIZE + d.at, _whole(d.value * np.repeat(scale, d.sizes)), k * _SIZE).reshape(k, _SIZE)
        by_lang = np.bincount(own * n + lang, _whole(scale), k * n).reshape(k, n)
        return np.hstack([sums, by_lang, np.bincount(own, minlength=k)[:, None]]).astype(np.int64)

    return run


def _fit(scan: Callable[[Callable, Callable], object], topics: int, rounds: int) -> TopicModel:
    """k-means by direction; ``scan`` calls a function with all documents, part by part, and joins what it gives two at a time.

    The first centre is the first document, each further one the document farthest from those before; the same documents give the same model.
    """
    sums, first = scan(_sums_of_languages, _join_sums) or ({}, None)
    if first is None:
        return TopicModel({}, np.empty((0, _SIZE)))
    means = {x: s / _UNIT / n for x, (n, s) in sums.items()}
    c = np.array([TopicModel(means, np.empty((0, _SIZE))).direction(first)])
    while len(c) < min(topics, sum(n for n, _ in sums.values())):
        model = TopicModel(means, c)
        c = np.vstack([c, model.direction(scan(_farthest(model), min)[1:])])
    for _ in range(rounds):
        model = TopicModel(means, c)
        moved = scan(_moved(model), np.add)
        new = (moved[:, :_SIZE] - moved[:, _SIZE:-1] @ model.table) / _UNIT
        new = np.where(moved[:, -1:] > 0, new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9), c)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return TopicModel(means, c)


def fit_topics(vectors: np.ndarray, langs: list[str], topics: int, rounds: int = 30) -> TopicModel:
    """The topics of these vectors, in one process."""
    d = _dense(vectors, langs)
    return _fit(lambda run, _: run(d), topics, rounds)


def fit_documents(counted: DataFrame, topics: int, rounds: int = 30) -> TopicModel:
    """The topics of all documents of a stored table ``at``, ``counts``, ``lang``, ``h``: every step is a scan of it whose tasks give sums or one document each; those of many tasks are joined in groups of 64 first."""
    import pyarrow as pa

    table = counted.select("at", "counts", "lang", "h")
    tasks = table.rdd.getNumPartitions()

    def scan(run: Callable, join: Callable):
        def joined(parts: Iterator) -> list[bytes]:
            out = None
            for x in parts:
                if x is not None:
                    out = x if out is None else join(out, x)
            return [] if out is None else [pickle.dumps(out)]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(joined(run(_counted(*b.columns)) for b in batches if b.num_rows), pa.binary())], ["x"])

        def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(joined(pickle.loads(x) for b in batches for x in b.column(0).to_pylist()), pa.binary())], ["x"])

        d = table.mapInArrow(part, "x binary")
        if tasks > 64:
            d = d.repartition(tasks // 64).mapInArrow(several, "x binary")
        found = joined(pickle.loads(r.x) for r in d.collect())
        return pickle.loads(found[0]) if found else None

    return _fit(scan, topics, rounds)


def _encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def with_sizes(df: DataFrame, vocabulary: str, topics: int) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``topic`` (null) and ``text`` to the same without text, with ``tokens``, the length of the text in tokens of a tiktoken vocabulary file (0 for null).

    The file must be readable on every executor. A null topic is set to one of ``topics`` fitted ones, ``t0``, ``t1``, ..., by a model of all documents without a topic that have a text.
    """
    import pyarrow as pa

    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            own, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            tokens = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            words = [word_counts(t) if o is None else None for o, t in zip(own, texts)]
            at = pa.array([w and w[0].astype(np.uint16).tobytes() for w in words], pa.binary())
            counts = pa.array([w and w[1].astype(np.uint32).tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], tokens, at, counts, pa.array([bool(t) for t in texts], pa.bool_()), batch.column(5)], ["doc_id", "source", "lang", "topic", "tokens", "at", "counts", "filled", "h"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3).to_pylist()
            some = pa.array([i for i, t in enumerate(own) if t is None], pa.int64())
            if len(some):
                d = _counted(*(batch.column(i).take(some) for i in (5, 6, 2, 7)))
                for i, t in zip(some.to_pylist(), sent.value.topics_of(d).tolist()):
                    own[i] = f"t{t}"
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), batch.column(4)], ["doc_id", "source", "lang", "topic", "tokens"])

    kind = df.schema["doc_id"].dataType.simpleString()
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("h")
    d = df.select("doc_id", "source", "lang", "topic", "text", h).mapInArrow(count, f"doc_id {kind}, source string, lang string, topic string, tokens bigint, at binary, counts binary, filled boolean, h bigint")
    counted, path = materialize(d, "counted")  # the tokenizer and the words run once
    sent = df.sparkSession.sparkContext.broadcast(fit_documents(counted.where("topic is null and filled"), topics))
    sized, _ = materialize(counted.drop("filled").mapInArrow(assign, f"doc_id {kind}, source string, lang string, topic string, tokens bigint"), "sized")
    drop(df.sparkSession, path)
    return sized


def rake(cells: pd.DataFrame, shares: dict[str, float], caps: dict[str, int], rounds: int = 500, tolerance: float = 1e-9) -> pd.DataFrame:
    """Fits ``weight`` (tokens to use) of cells with source, lang, topic, tokens to the source shares.

    The total is the largest that all caps allow: the least of cap * tokens / share over the sources with a share. Language and topic
    marginals are those of the available tokens. A cell's weight is its tokens times a factor for each of its three values, or its cap where that is less; in turn,
    every value's factor is set so that its cells' weights sum to its target, the sources' last, so their shares are met exactly. Where the caps leave no room for a
    language or topic, its factor stays at its bound and its share differs.
    """
    c = cells[cells["tokens"] > 0].copy()
    own = c.groupby("source")["tokens"].sum()
    total = min((caps[s] * own.get(s, 0) / share for s, share in shares.items() if share > 0), default=0.0)
    most = c["tokens"].to_numpy(float) * c["source"].map(caps).to_numpy(float)
    c["weight"] = 0.0
    if not len(c) or total <= 0:
        return c
    start = np.log(c["tokens"].to_numpy(float) * total / c["tokens"].sum())
    groups, targets, factors = {}, {}, {}
    for m in ("lang", "topic", "source"):
        groups[m], names = pd.factorize(c[m], sort=True)
        have = np.bincount(groups[m], c["tokens"])
        targets[m] = np.array([shares[n] for n in names]) * total if m == "source" else have / have.sum() * total
        factors[m] = np.zeros(len(names))
    weight = np.minimum(np.exp(start), most)
    for _ in range(rounds):
        old = weight
        for m, g in groups.items():
            rest = start + sum(factors[o][groups[o]] for o in groups if o != m)
            low, high = np.full(len(targets[m]), -40.0), np.full(len(targets[m]), 40.0)
            for _ in range(60):  # bisection of all factors at once
                mid = (low + high) / 2
                enough = np.bincount(g, np.minimum(np.exp(np.minimum(rest + mid[g], 700)), most)) >= targets[m] * (1 - 1e-12)
                low, high = np.where(enough, low, mid), np.where(enough, mid, high)
            factors[m] = np.where(np.bincount(g, most) <= targets[m] * (1 + 1e-9), 40.0, high)  # all at their caps, whatever the other factors
            weight = np.minimum(np.exp(np.minimum(rest + factors[m][g], 700)), most)
        if np.abs(weight - old).max() <= tolerance * total:
            break
    c["weight"] = weight
    return c


def mix_sources(
    docs: DataFrame, targets: DataFrame, vocabulary: str, topic_col: str | None = None, topics: int = 8, sample: int | None = None, seed: int = 7, most_sources: int = 10_000
) -> DataFrame:
    """How often to use each document: ``doc_id``, ``source``, ``lang``, ``topic``, ``tokens``, ``weight`` (tokens that its cell is to have in all), ``repeats``.

    ``docs`` has doc_id, text, lang, source, and the column ``topic_col`` if given, of few values; null topics, or all, are fitted, to all documents (``sample`` has no effect any more). ``targets`` has source, target_share,
    max_repeats, at most ``most_sources`` rows (more raise: that bounds the cells on the driver). Documents of a null or other source, and texts without
    tokens, get 0 repeats, as do all if a source with a share has no tokens; no row is dropped, and none is used more than its source's cap. Null ids are drawn alike.
    """
    spark = docs.sparkSession
    lang = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    topic = F.col(topic_col).cast("string") if topic_col else F.lit(None).cast("string")
    d = docs.select("doc_id", source_key(F.col("source")).alias("source"), lang.alias("lang"), topic.alias("topic"), "text")
    sized = with_sizes(d, vocabulary, topics)
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources have a target")
    shares, caps = {r.source: float(r.target_share) for r in rows}, {r.source: int(r.max_repeats or 0) for r in rows}
    fitted = []
    if shares:
        wanted = F.broadcast(spark.createDataFrame([(s,) for s in shares], "source string"))
        cells = sized.join(wanted, "source", "left_semi").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).toPandas()
        fitted = [(r.source, r.lang, r.topic, float(r.weight), float(r.weight / r.tokens)) for r in rake(cells, shares, caps).sort_values(["source", "lang", "topic"]).itertuples()]
    rates = spark.createDataFrame(fitted, "source string, lang string, topic string, weight double, rate double")
    cell = ["source", "lang", "topic"]
    rate = F.coalesce(F.col("rate"), F.lit(0.0))
    uniform = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    send = lambda t: F.broadcast(t) if len(fitted) <= 100_000 else t  # noqa: E731 - a row per cell
    whole = F.floor(rate + F.lit(1e-12))
    drawn = sized.join(send(rates), cell, "left").withColumns({"whole": whole, "part": F.greatest(rate - whole, F.lit(0.0)), "u": uniform})
    # the draws of a cell stop where its tokens come nearest to what its probability promises
    bins = drawn.where("part > 1e-9").groupBy(*cell, F.floor(F.col("u") * 65536).cast("int").alias("bin")).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("part")).alias("need"))
    up = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    stop = bins.select(*cell, "bin", "t", F.sum("t").over(up).alias("reached"), F.sum("need").over(Window.partitionBy(*cell)).alias("need"))
    stop = stop.where("reached - t / 2.0 <= need").groupBy(*cell).agg(F.max("bin").alias("last_bin"))
    n = F.col("whole") + F.when(F.col("part") > 1e-9, F.coalesce((F.floor(F.col("u") * 65536) <= F.col("last_bin")).cast("bigint"), F.lit(0))).otherwise(0)
    return drawn.join(send(stop), cell, "left").select("doc_id", *cell, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), n.cast("bigint").alias("repeats"))


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``target_share``, ``actual_share``, ``documents``, ``used``, ``tokens``, ``used_tokens``, ``most_repeats``, ``max_repeats``."""
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("repeats").alias("used"), F.sum("tokens").alias("tokens"),
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"),
    )
    total = got.agg(F.sum("used_tokens").alias("n")).scalar()
    return t.join(got, "source", "left").withColumn("actual_share", F.coalesce(F.col("used_tokens") / total, F.lit(0.0)))


def margin_report(mixed: DataFrame) -> DataFrame:
    """For every source, language and topic of the mixture: ``dimension``, ``value``, ``available_share`` (of the tokens of sources with a target), ``fitted_share`` (that raking reached), ``actual_share`` (that the draws reached), ``used_tokens``.

    Language and topic were raked to their available shares; where the caps or the sources' shares leave no room for these, fitted and available shares differ.
    """
    cells = mixed.groupBy("source", "lang", "topic").agg(F.max("weight").alias("weight"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    cells = cells.where("weight > 0")
    each = cells.select("weight", "tokens", "used", F.explode(F.create_map(*[x for c in ("source", "lang", "topic") for x in (F.lit(c), F.col(c))])).alias("dimension", "value"))
    sums = each.groupBy("dimension", "value").agg(F.sum("weight").alias("w"), F.sum("tokens").alias("t"), F.sum("used").alias("used_tokens"))
    whole = Window.partitionBy("dimension")  # a row per value
    part = lambda c: F.col(c) / F.sum(c).over(whole)
    return sums.select("dimension", "value", part("t").alias("available_share"), part("w").alias("fitted_share"), part("used_tokens").alias("actual_share"), "used_tokens")
