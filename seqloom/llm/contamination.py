"""Test passages inside a corpus: rare n-gram seeds, then alignment.

A first scan counts the items' n-grams and pairs of neighbours in all documents; from every window of an item its rarest
n-gram becomes a seed, so that any shared window holds a seed; a second scan looks the seeds up, and passage and text are
aligned around every hit (Smith-Waterman). Alignment decides: a run of w equal tokens scores 2w at least, so what scores less holds none.
The corpus is never shuffled, and nothing grows with it but the scans.

Items are read in blocks of bounded size, put together on the executors and sent to all tasks; a task reads the tokens of its documents
once and takes them through all blocks, so there are two scans however many items there are. Tokens are compared by hashes of 64 bits.

Edited copies need not share a rare n-gram, as the rarest ones may stand in another copy only. They are found by pairs of
neighbouring tokens, without loss: an alignment of m equal tokens and x other columns scores 2m - x, so one of at least s
has x <= 2m - s. Its equal tokens form at most x + 1 runs and so hold m - x - 1 >= s - m - 1 >= t = s - L - 1 pairs of
neighbours, where L >= m is the length of the item. Gaps are among the x <= 2L - s other columns, so the places in text and item of the shared pairs differ by amounts within
2L - s of each other. A score of 0.8 of the highest is s = 1.6 L, hence t = 0.6 L - 1 of the item's L - 1 pairs, with differences within 0.4 L. Of any L - 1 - t + c places
of the item at least c are thus shared: the rarest such places are looked up (c is half of t), and for documents that hold c of them, all
pairs of the item are placed; where t of them have differences within that width, passage and text are aligned.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .bases import groups_of

# Combining marks of TeX accent commands.
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303"}
_COMMAND = re.compile(
    r"""\\(?:(?P<key>(?:cite|ref|eqref|label)\s*(?:\[[^\]]*\])?\{[^{}]*\})|[A-Za-z]+|(?P<soft>-)
    |(?P<accent>['`^"~])\s*(?:\{\s*\\?(?P<braced>[^\W\d_])\s*\}|\\?(?P<bare>[^\W\d_]))|.)""",
    re.X | re.S,
)
_WORD = re.compile(r"[^\W_]+")
_HAN_KANA = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)

#: Token kinds: tokens that must match in a row, and tokens of a seed.
KINDS = {"word": (13, 4), "char": (26, 8)}

#: Share of the highest score from which an edited copy is certain to be found.
SIMILAR = (4, 5)


def _plain(m: re.Match) -> str:
    if m["soft"]:
        return ""
    if m["accent"]:
        return unicodedata.normalize("NFC", (m["braced"] or m["bare"]) + _ACCENTS[m["accent"]])
    return " "


def read_plain(text: str) -> str:
    """A text without commands: their places are blanks, accent commands are accented letters, soft hyphens vanish."""
    return _COMMAND.sub(_plain, text) if "\\" in text else text


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; none for null."""
    return _WORD.findall(read_plain(text).lower()) if text else []


def han_kana(text: str | None) -> str:
    """The Han characters and kana of a text, all others removed."""
    return "".join(_HAN_KANA.findall(read_plain(text))) if text else ""


class _Hashes(dict):
    """Hashes of tokens, none of them 0; what was met before is remembered, up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 2_000_000:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1 or 1
        return h


_HASHES = _Hashes()


def token_hashes(text: str | None, kind: str) -> np.ndarray:
    """The tokens of a text, of the kind ``word`` or ``char``, as hashes."""
    found = words(text) if kind == "word" else han_kana(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.int64, len(found))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams in order; those with token 0 equal no other."""
    m = len(ids) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    h, x = np.zeros(m, np.uint64), ids.view(np.uint64)
    for k in range(n):
        h = (h ^ x[k : k + m]) * _MULT
        h ^= h >> np.uint64(29)
    return h


class _Lookup:
    """Places of hashes in a sorted array; a bit map turns most away first."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(12, int(len(keys) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.map = np.zeros(1 << bits, bool)
        self.map[keys & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and where."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.map[h & self.mask])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        on = self.keys[k] == h[at]
        return at[on], k[on]


def _spread(starts: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries k of lists that begin at ``starts``: number of the entry, and place in the lists, of each element."""
    n = starts[k + 1] - starts[k]
    return np.repeat(np.arange(len(k)), n), np.repeat(starts[k] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _lists(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where the list of each begins, and the order that makes the lists."""
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return distinct, np.append(first, len(keys)), order


def alignment_scores(a: np.ndarray, texts: list[np.ndarray], cells: int = 1 << 15) -> np.ndarray:
    """Best local alignment score of a token array with each of several: 2 for a match, -1 for a mismatch or a gap; token 0 matches nothing.

    Texts of like length are aligned side by side, with zeros behind the shorter ones.
    """
    out = np.zeros(len(texts), np.int64)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    while order:
        n = max(1, cells // (len(texts[order[-1]]) + 1))
        some, order = order[-n:], order[:-n]
        b = np.zeros((len(some), len(texts[some[-1]])), np.int64)
        for k, i in enumerate(some):
            b[k, : len(texts[i])] = texts[i]
        ramp = np.arange(b.shape[1] + 1, dtype=np.int32)
        row, best = np.zeros((len(some), b.shape[1] + 1), np.int32), np.zeros(len(some), np.int32)
        two, one = np.int32(2), np.int32(-1)
        for x in a:
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + (np.where(b == x, two, one) if x else one), row[:, 1:] - 1, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + ramp, axis=1) - ramp
            np.maximum(best, row.max(axis=1), out=best)
        out[some] = best
    return out


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The same with one text."""
    return int(alignment_scores(a, [b])[0])


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Most equal tokens in a row of two token arrays; token 0 matches nothing."""
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        row[1:] = np.where((b == x) & (b != 0), row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def bounds(n: int) -> tuple[int, int]:
    """For an item of n tokens: the pairs of neighbours that any alignment of similarity ``SIMILAR`` shares with it, and the most columns of it that aren't equal tokens."""
    least = -(-2 * n * SIMILAR[0] // SIMILAR[1])
    return least - n - 1, 2 * n - least


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def longest_equal(a: np.ndarray, b: np.ndarray) -> int:
    """Most equal tokens in a row of two token arrays of one length, place by place."""
    wrong = np.flatnonzero(np.concatenate([[True], a != b, [True]]))
    return int(np.diff(wrong).max()) - 1


class _Items:
    """The items of one block and kind: names, tokens with a 0 behind each item, and their n-grams."""

    def __init__(self, names: list[int], tokens: list[np.ndarray], kind: str):
        self.kind, self.names, self.own = kind, names, tokens
        self.length = np.array([len(t) for t in tokens], np.int64)

    def grams(self, n: int) -> list[np.ndarray]:
        return [gram_hashes(t, n) for t in self.own]

    def asked(self) -> dict[int, np.ndarray]:
        """Sorted distinct hashes of everything that is to be counted, by n: seeds' n-grams, pairs, and tokens of items of one token."""
        n = KINDS[self.kind][1]
        one = lambda x: np.unique(np.concatenate([np.empty(0, np.uint64), *x]))
        return {n: one(self.grams(n)), 2: one(self.grams(2)), 1: one([gram_hashes(t, 1) for t in self.own if len(t) == 1])}

    def choose(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Keep of every window its rarest n-gram that the corpus holds, of equal ones the smallest hash; n-grams that it lacks can find nothing. Keep of every item its rarest pairs."""
        window, n = KINDS[self.kind]

        def count(h: np.ndarray, of: int) -> np.ndarray:
            keys, sums = counts.get(of, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            if not len(keys):
                return np.zeros(len(h), np.int64)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[k] == h, sums[k], 0)

        seed_h, seed_item, seed_at = [], [], []
        pair_h, pair_item = [], []
        self.own_pairs = [_lists(gram_hashes(t, 2)) for t in self.own]
        self.need = np.ones(len(self.own), np.int64)
        for i, t in enumerate(self.own):
            h = gram_hashes(t, n)
            if len(h):
                c = count(h, n)
                order = np.lexsort((h, c))
                rank = np.empty(len(h), np.int64)
                rank[order] = np.concatenate([[0], np.cumsum(h[order[1:]] != h[order[:-1]])])
                rank[c == 0] = len(h)
                wide = min(window, len(t)) - n + 1
                view = np.lib.stride_tricks.sliding_window_view(rank, wide)
                at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
                at = at[c[at] > 0]
                seed_h.append(h[at])
                seed_at.append(at)
                seed_item.append(np.full(len(at), i))
            must = bounds(len(t))[0]
            h = gram_hashes(t, 1 if len(t) == 1 else 2)
            self.need[i] = c = max(1, -(-must // 2))
            order = np.lexsort((h, count(h, 1 if len(t) == 1 else 2)))[: len(t) - 1 - must + c]
            pair_h.append(h[order])
            pair_item.append(np.full(len(order), i))
        join = lambda x, kind: np.concatenate([np.empty(0, kind), *x])
        h, item, at = join(seed_h, np.uint64), join(seed_item, np.int64), join(seed_at, np.int64)
        keys, self.seed_starts, order = _lists(h)
        self.seeds, self.seed_item, self.seed_at = _Lookup(keys), item[order], at[order]
        h, item = join(pair_h, np.uint64), join(pair_item, np.int64)
        alone = self.length[item] == 1
        self.pairs, self.ones = {}, {}
        for name, on in (("pairs", ~alone), ("ones", alone)):
            keys, starts, order = _lists(h[on])
            setattr(self, name, (_Lookup(keys), starts, item[on][order]))

    def edited(self, tokens: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Spans of the documents (one after another in ``tokens``, each with a 0 behind it) that hold every alignment of similarity ``SIMILAR``, by document and item."""
        two = gram_hashes(tokens, 2)
        codes = []
        for (lookup, own, items), h in ((self.pairs, two), (self.ones, gram_hashes(tokens, 1))):
            at, k = lookup.find(h)
            doc = np.searchsorted(starts, at, "right") - 1
            both = np.unique(doc * max(1, len(lookup.keys)) + k)  # a document's place counts as often as the item has it
            doc, k = both // max(1, len(lookup.keys)), both % max(1, len(lookup.keys))
            row, place = _spread(own, k)
            codes.append(doc[row] * len(self.own) + items[place])
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        code = code[n >= self.need[code % max(1, len(self.own))]]
        out = {}
        for doc, i in zip((code // max(1, len(self.own))).tolist(), (code % max(1, len(self.own))).tolist()):
            lo, hi = int(starts[doc]), int(starts[doc + 1]) - 1
            own = self.own[i]
            if len(own) <= 2:  # the whole item
                out[doc, i] = [(lo, hi)]
                continue
            must, wide = bounds(len(own))
            lookup_keys, first, order = self.own_pairs[i]
            h = two[lo : hi - 1]
            k = np.minimum(np.searchsorted(lookup_keys, h), len(lookup_keys) - 1)
            on = np.flatnonzero(lookup_keys[k] == h)
            row, place = _spread(first, k[on])
            diagonal = np.sort(on[row] - order[place])
            if len(diagonal) >= must:
                near = np.flatnonzero(diagonal[must - 1 :] - diagonal[: len(diagonal) - must + 1] <= wide)
                spans = merge([(lo + max(0, int(diagonal[x]) - wide), min(hi, lo + int(diagonal[x + must - 1]) + wide + len(own))) for x in near])
                if spans:
                    out[doc, i] = spans
        return out

    def hits(self, tokens: np.ndarray, starts: np.ndarray, edits: bool) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(document, item, tokens of the item, window, longest equal run, alignment score) of what :func:`find_passages` gives."""
        window, n = KINDS[self.kind]
        at, k = self.seeds.find(gram_hashes(tokens, n))
        row, place = _spread(self.seed_starts, k)
        doc, item = np.searchsorted(starts, at, "right")[row] - 1, self.seed_item[place]
        diagonal = at[row] - self.seed_at[place]
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        found: dict[tuple[int, int], np.ndarray] = {}
        edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]])) if len(doc) else []
        for a, b in zip(edges, edges[1:]):
            found[int(doc[a]), int(item[a])] = np.unique(diagonal[a:b])
        edited = self.edited(tokens, starts) if edits else {}
        keys = sorted(found.keys() | edited.keys())
        known: dict[tuple[int, int], tuple[int, int]] = {}  # longest run, score
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}  # by item: document and text to align
        for d, i in keys:
            own, lo, hi = self.own[i], int(starts[d]), int(starts[d + 1]) - 1
            size = len(own)
            longest, around = size if size <= 2 and (d, i) in edited else 0, []
            for g in found.get((d, i), np.empty(0, np.int64)).tolist():
                a, b = max(g, lo), min(g + size, hi)
                longest = max(longest, longest_equal(tokens[a:b], own[a - g : b - g]))
                around.append((max(lo, g - size // 2), min(hi, g + size + size // 2)))
            known[d, i] = longest, 2 * size if longest == size else 0
            if longest < size:
                for a, b in merge(around + edited.get((d, i), [])):
                    part = tokens[a:b]
                    if 2 * int(np.isin(part, own).sum()) >= self.wanted(i, edits):  # an alignment has no more equal tokens
                        parts.setdefault(i, []).append((d, part))
        for i, some in parts.items():
            for (d, part), score in zip(some, alignment_scores(self.own[i], [p for _, p in some]).tolist()):
                longest, best = known[d, i]
                if longest < window and score >= self.wanted(i, edits):
                    longest = max(longest, longest_run(self.own[i], part))
                known[d, i] = longest, max(best, score)
        for d, i in keys:
            longest, score = known[d, i]
            if score >= 2 * window and longest >= window or edits and score >= self.least(i):
                yield d, self.names[i], len(self.own[i]), window, longest, score

    def least(self, i: int) -> int:
        """The score of an item from which a copy is similar."""
        return -(-2 * len(self.own[i]) * SIMILAR[0] // SIMILAR[1])

    def wanted(self, i: int, edits: bool) -> int:
        """The least score that can give a row."""
        window = KINDS[self.kind][0]
        return min(self.least(i), 2 * window) if edits else 2 * window


def _document_tokens(texts: list[str], kind: str, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of texts: the first, their tokens with a 0 behind each text, and where each begins (one more at the end)."""
    for lo, hi in groups_of([len(t) for t in texts], most):
        parts = []
        for t in texts[lo:hi]:
            parts += [token_hashes(t, kind), np.zeros(1, np.int64)]
        starts = np.concatenate([[0], np.cumsum([len(parts[i]) + 1 for i in range(0, len(parts), 2)])])
        yield lo, np.concatenate(parts), starts


def _read_blocks(sent: list) -> Iterator[dict[str, _Items]]:
    """The blocks one after another; of several, none is kept."""
    for b in sent:
        if isinstance(b.value, bytes):
            block = pickle.loads(b.value)
            if len(sent) == 1:
                b._value = block
        else:
            block = b.value
        yield block
        if len(sent) > 1:
            b.__dict__.pop("_value", None)


def find_passages(docs: DataFrame, items: DataFrame, edits: bool = True, block_chars: int = 4_000_000) -> DataFrame:
    """Items that documents hold, wholly, partly or, with ``edits``, edited.

    ``docs`` has doc_id and text, ``items`` item_id, lang and passage; null texts and passages match nothing, an empty table
    gives no row, repeated rows count once. Columns: ``item_id``, ``doc_id``, ``item_tokens``, ``run`` (longest stretch of
    equal tokens where they were aligned), ``window`` (tokens in a row that count as a verbatim copy), ``score`` and ``similarity`` (alignment
    score, and its share of the highest possible). Any document with ``window`` equal tokens in a row is found, with
    its longest run, and with ``edits`` any of a similarity of 0.8 or more, with its score, whatever else the corpus holds; no other row is given. Other scores
    are those around the seeds. Items of any number of tokens are searched. Blocks hold about ``block_chars`` characters of items each.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text").where(F.length("text") > 0)
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "lang", "passage").where(F.length("passage") > 0).distinct()
    items, _ = materialize(items, "items")
    total = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)).cast("int"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def put_together(part: pd.DataFrame) -> dict[str, _Items]:
        rows: dict[str, tuple[list, list]] = {"word": ([], []), "char": ([], [])}
        for item, lang, passage in zip(part["item_id"], part["lang"], part["passage"]):
            kind = "char" if lang in ("zh", "ja") else "word"
            t = token_hashes(passage, kind)
            if len(t):
                rows[kind][0].append(int(item))
                rows[kind][1].append(t)
        return {k: _Items(names, tokens, k) for k, (names, tokens) in rows.items() if names}

    def asked(part: pd.DataFrame) -> pd.DataFrame:
        own = {k: {n: _Lookup(h) for n, h in i.asked().items()} for k, i in put_together(part).items()}
        return pd.DataFrame({"block": part["block"].iloc[:1], "data": [pickle.dumps(own)]})

    def send(blobs: DataFrame) -> list:
        return [spark.sparkContext.broadcast(bytes(r.data)) for r in blobs.toLocalIterator()]  # one block of items at a time

    grams = send(items.groupBy("block").applyInPandas(asked, "block int, data binary"))
    most = 2_000_000 if len(grams) == 1 else 64_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str, int], np.ndarray] = {}
        keys: dict[tuple[int, str, int], np.ndarray] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for kind in KINDS:
                for _, tokens, _ in _document_tokens(texts, kind, most):
                    for b, block in enumerate(_read_blocks(grams)):
                        for n, lookup in block.get(kind, {}).items():
                            if len(lookup.keys):
                                _, k = lookup.find(gram_hashes(tokens, n))
                                if (b, kind, n) not in sums:
                                    sums[b, kind, n] = np.zeros(len(lookup.keys), np.int64)
                                    keys[b, kind, n] = lookup.keys
                                sums[b, kind, n] += np.bincount(k, minlength=len(lookup.keys))
        for (b, kind, n), s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), b, np.int32)), pa.array([kind] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(keys[b, kind, n][at].view(np.int64)), pa.array(s[at])], ["sent", "kind", "n", "gram", "times"]
            )

    counted = docs.select("text").mapInArrow(count, "sent int, kind string, n int, gram bigint, times bigint")
    counted = counted.groupBy("kind", "n", "gram", "sent").agg(F.sum("times").alias("times")).groupBy("kind", "n", "gram").agg(F.max("times").alias("times"))  # alike in all blocks that hold it
    counted, _ = materialize(counted, "counts")
    want = items.groupBy("block").applyInPandas(lambda part: _wanted(put_together(part), part), "block int, kind string, n int, gram bigint")
    counted = want.join(counted, ["kind", "n", "gram"])

    def choose(part: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        own = put_together(part)
        for kind, i in own.items():
            known = {}
            for n, c in counts[counts["kind"] == kind].groupby("n"):
                keys, sums = c["gram"].to_numpy().view(np.uint64), c["times"].to_numpy()
                order = np.argsort(keys)
                known[int(n)] = keys[order], sums[order]
            i.choose(known)
        return pd.DataFrame({"block": part["block"].iloc[:1], "data": [pickle.dumps(own)]}) if len(part) else pd.DataFrame({"block": [], "data": []})

    chosen = send(items.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(choose, "block int, data binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for kind in KINDS:
                for first, tokens, starts in _document_tokens(texts, kind, most):
                    for block in _read_blocks(chosen):
                        if kind in block:
                            rows += [(first + hit[0], *hit[1:]) for hit in block[kind].hits(tokens, starts, edits)]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "item_id", "item_tokens", "window", "run", "score"])

    out = docs.mapInArrow(search, f"doc_id {doc_type}, item_id bigint, item_tokens bigint, window bigint, run bigint, score bigint")
    return out.withColumn("similarity", F.col("score") / (F.col("item_tokens") * 2)).distinct()


def _wanted(own: dict[str, _Items], part: pd.DataFrame) -> pd.DataFrame:
    """What a block has counted: block, kind, n, gram."""
    rows = [pd.DataFrame({"block": part["block"].iloc[0], "kind": k, "n": n, "gram": h.view(np.int64)}) for k, i in own.items() for n, h in i.asked().items()]
    return pd.concat(rows) if rows else pd.DataFrame({"block": [], "kind": [], "n": [], "gram": []})
