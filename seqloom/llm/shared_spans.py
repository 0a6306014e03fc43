"""Stretches that stand verbatim in more than one sequence.

A log-structured index holds the fingerprints of everything read so far: sorted immutable runs, bucketed by
fingerprint, each with the smallest and largest text that holds it, listed in a manifest in the shared folder, so an index can be
opened again and take in further batches. A new batch is merge-joined with every run, which
moves none of the history; runs of one level are compacted into one of the next. The fingerprint of a window of
``length`` bases is its smallest k-mer, which depends on the window's content alone, so equal windows have
equal fingerprints, and a text has few different ones: windows in a row mostly share theirs. Each such row of windows is one
occurrence, with the bases it covers at two bits a base; occurrences of a shared fingerprint meet, and
their windows are compared base by base.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop, materialize, new_path, ship
from .bases import groups_of, joined_codes, mix64, valid_starts, window_codes


class FingerprintIndex:
    """Runs of (``h``, ``lo``, ``hi``): a fingerprint and the smallest and largest id that hold it.

    It is kept at ``path``, on any file system that Spark reads: its manifest is written anew after every batch, as a folder
    of the next number, and the latest complete one counts when the index is opened again.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout, self.path = spark, fanout, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str, int]] = []  # level, path, buckets
        self.tables: dict[str, str] = {}
        self.version = 0
        for v in self._versions():
            self.version = v
            self.runs = [(r.level, r.path, r.buckets) for r in spark.read.parquet(f"{self.path}/manifest-{v}").collect() if r.level >= 0]  # a row per run, a few for each level

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        """Numbers of the complete manifests, in order."""
        fs, p = self._fs()
        names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n.getName() for n in names if n.getName().startswith("manifest-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return sorted(int(n.split("-")[1]) for n in done)

    def _table(self, run: tuple[int, str, int]) -> DataFrame:
        """A run as a bucketed table, registered for this session only."""
        _, path, buckets = run
        if path not in self.tables:
            name = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BIGINT, lo BIGINT, hi BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{path}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path])

    def _write(self, df: DataFrame, level: int) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}"
        df.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).format("parquet").saveAsTable(name)
        self.tables[path] = name
        self.runs.append((level, path, self.buckets))
        return self.spark.table(name)

    def add(self, batch: DataFrame, found_path: str) -> None:
        """Take in rows ``h``, ``id`` (bigint). What the batch holds and more than one id holds, in it or in history, is written to ``found_path``: ``h``."""
        older = list(self.runs)
        run = self._write(batch.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), 0)
        found = run.where("lo <> hi").select("h")
        for r in older:
            both = run.alias("n").hint("merge").join(self._table(r).alias("o"), F.col("n.h") == F.col("o.h")).where("o.lo <> n.lo or o.hi <> n.hi or n.lo <> n.hi")
            found = found.unionByName(both.select("n.h"))
        found.write.mode("overwrite").parquet(found_path)
        gone = self._compact()
        self._save()
        for r in gone:
            self._drop(r)

    def _compact(self) -> list[tuple[int, str, int]]:
        level, gone = 0, []
        while len(same := [r for r in self.runs if r[0] == level]) >= self.fanout:
            rows = None
            for r in same:
                rows = self._table(r) if rows is None else rows.unionByName(self._table(r))
            self._write(rows.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), level + 1)
            self.runs = [r for r in self.runs if r not in same]
            gone += same
            level += 1
        return gone

    def _save(self) -> None:
        old, self.version = self.version, self.version + 1
        rows = [(level, path, buckets) for level, path, buckets in self.runs] or [(-1, "", 0)]
        self.spark.createDataFrame(rows, "level int, path string, buckets int").coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")
        if old:
            drop(self.spark, f"{self.path}/manifest-{old}")

    def _drop(self, run: tuple[int, str, int]) -> None:
        if run[1] in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run[1])}")
        drop(self.spark, run[1])

    def close(self) -> None:
        """Forget the session's tables; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def window_fingerprints(c: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``length`` bases without another letter, and the fingerprint of each."""
    at = valid_starts(c, length)
    if not len(at):
        return at, np.empty(0, np.uint64)
    h = mix64(window_codes(c, k))
    wide, size = length - k + 1, 1
    while size * 2 <= wide:  # minima over 1, 2, 4, ... windows, then two that overlap
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return at, np.minimum(h[at], h[at + wide - size])


def occurrences(c: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Rows of windows with one fingerprint in joined texts: text number, fingerprint, first window, number of windows."""
    at, h = window_fingerprints(c, length, k)
    if not len(at):
        return at, h, at, at
    own = np.searchsorted(starts, at, "right") - 1
    new = np.concatenate([[True], (np.diff(at) != 1) | (h[1:] != h[:-1])])
    first = np.flatnonzero(new)
    return own[first], h[first], at[first], np.diff(np.append(first, len(at)))


def packed(c: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a base of the stretches from ``at``, each from a byte of its own, and where each begins (one more at the end)."""
    c = np.concatenate([c & 3, np.zeros(3, np.uint8)])
    four = (c[:-3] << 6) | (c[1:-2] << 4) | (c[2:-1] << 2) | c[3:]
    n = (sizes + 3) // 4
    begin = np.concatenate([[0], np.cumsum(n)])
    return four[np.repeat(at - 4 * begin[:-1], n) + 4 * np.arange(begin[-1])], begin


def window_words(data: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All windows of packed occurrences with ``n`` windows each: occurrence, number within it, and the content in words of up to 32 bases."""
    c = (data[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()
    own = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = 4 * begin[own] + within
    wide = min(32, length)
    codes = window_codes(c, wide)
    return own, within, [codes[at + o] for o in sorted({*range(0, length - wide + 1, wide), length - wide})]


def _arrow_packed(data: np.ndarray, begin: np.ndarray):
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _from_arrow(column) -> tuple[np.ndarray, np.ndarray]:
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    return data, begin - begin[0]


def _mixed(h: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    for w in words:
        h = mix64(h ^ w)
    return h


def _common_windows(tid: np.ndarray, h: np.ndarray, n: np.ndarray, data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups of occurrences of one fingerprint: rows of windows whose content more than one text has, as occurrence, first and last number within."""
    own, within, words = window_words(data, begin, n, length)
    mixed = _mixed(h[own], words)
    order = np.argsort(mixed, kind="stable")
    same = np.ones(max(len(order) - 1, 0), bool)
    for w in (mixed, *words):
        same &= w[order[1:]] == w[order[:-1]]
    edges = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.empty(0, np.int64)
    t = tid[own[order]]
    shared = np.zeros(len(order), bool)
    if len(edges):
        many = np.minimum.reduceat(t, edges) != np.maximum.reduceat(t, edges)
        shared[order] = np.repeat(many, np.diff(np.append(edges, len(order))))
    at = np.flatnonzero(shared)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) != 1) | (own[at[1:]] != own[at[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return own[at[first]], within[at[first]], within[at[last]]


def common_runs(occ: DataFrame, length: int, many: int) -> DataFrame:
    """``tid``, ``first``, ``last``: rows of window starts whose content stands in another text, from occurrences ``h``, ``tid``, ``start``, ``n``, ``bases``.

    Occurrences of a fingerprint meet in one task, sorted; those of fingerprints held more than ``many`` times are cut into windows instead, which are
    compared by a digest of 128 bits, summed up before the shuffle.
    """
    import pyarrow as pa

    schema = "tid bigint, first bigint, last bigint"

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in (*parts, None):
            if part is not None:
                rest = part if rest is None else pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
                h = rest.column(0).to_numpy()
                cut = len(h) if not len(h) else int(np.searchsorted(h, h[-1], "left"))
                if cut < 20_000:  # at least so many and at most twice as many occurrences and a batch are held
                    continue
                whole, rest = rest.slice(0, cut), rest.slice(cut)
            else:
                whole, rest = rest, None
            if whole is None or not whole.num_rows:
                continue
            h, tid, start, n = (whole.column(i).to_numpy() for i in range(4))
            own, first, last = _common_windows(tid, h.view(np.uint64), n, *_from_arrow(whole.column(4)), length)
            yield pa.RecordBatch.from_arrays([pa.array(tid[own]), pa.array(start[own] + first), pa.array(start[own] + last)], ["tid", "first", "last"])

    frequent, _ = materialize(occ.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > many).select("h"), "frequent")
    usual = occ
    if not (none := frequent.isEmpty()):
        usual = occ.join(frequent, "h", "left_anti")
    runs = usual.repartition("h").sortWithinPartitions("h").mapInArrow(together, schema)
    if none:
        return runs

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi in groups_of(part.column(3).to_pylist(), 200_000):
                some = part.slice(lo, hi - lo)
                h, tid, start, n = (some.column(i).to_numpy() for i in range(4))
                own, within, words = window_words(*_from_arrow(some.column(4)), n, length)
                one = _mixed(h.view(np.uint64)[own], words)
                two = _mixed(one ^ np.uint64(0x9E3779B97F4A7C15), words)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(tid[own]), pa.array(start[own] + within)], ["d1", "d2", "tid", "first"])

    each, _ = materialize(occ.join(frequent, "h", "left_semi").mapInArrow(windows, "d1 bigint, d2 bigint, tid bigint, first bigint"), "contents")
    twice = each.groupBy("d1", "d2").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("d1", "d2")
    return runs.unionByName(each.join(twice, ["d1", "d2"], "left_semi").select("tid", "first", F.col("first").alias("last")))


def shared_spans(df: DataFrame, id_col: str, seq_col: str, length: int = 100, k: int = 24, batches: int = 2, many: int = 5000) -> DataFrame:
    """Maximal runs of positions that lie in a window of ``length`` bases which stands in a sequence of another id.

    Case is ignored, only A, C, G, T count, strands are not turned. Null ids, null, empty and shorter sequences give no row; repeated
    rows of an id don't make it shared; other columns are not read. Columns ``id``, ``span_start``, ``span_end`` (half-open, 0-based).
    ``length`` must be at least ``k``. Equal texts (by MD5) are read once; those of several ids are shared throughout. The table goes through the index in ``batches``
    parts by hash of its texts; :class:`SpanStore` keeps the index for batches that come later.
    """
    spark = df.sparkSession
    store = SpanStore(spark, None, length, k, many)
    try:
        rows, path = materialize(store.rows(df, id_col, seq_col), "texts")
        for b in range(batches):
            store.add_rows(rows.where(F.pmod(F.xxhash64("text_key"), F.lit(batches)) == b))
        drop(spark, path)
        return store.spans()
    finally:
        store.close()


class SpanStore:
    """The occurrences of all sequences met so far and the index of their fingerprints, in a folder; takes in batches and gives the spans shared among all of them.

    A batch has a part of its own in every table, which counts once the index has taken it in; one that was broken off is written again. A 64-bit hash
    stands for a text's MD5.
    """

    def __init__(self, spark: SparkSession, path: str | None, length: int = 100, k: int = 24, many: int = 5000):
        if not 4 <= k <= min(31, length):
            raise ValueError("k must be from 4 to 31 and at most length")
        ship(spark)
        self.spark, self.length, self.k, self.many, self.kept = spark, length, k, many, path is not None
        self.path = path or new_path(spark, "spans")
        self.index = FingerprintIndex(spark, f"{self.path}/index")

    def rows(self, df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
        """The rows that count: ``id``, ``seq`` in upper case, ``text_key``."""
        r = df.select(F.col(id_col).cast("string").alias("id"), F.upper(F.col(seq_col)).alias("seq")).where(F.col("id").isNotNull() & (F.length("seq") >= self.length))
        return r.withColumn("text_key", F.md5(F.col("seq")))

    def add(self, df: DataFrame, id_col: str, seq_col: str) -> None:
        """Take in a batch; ids and sequences met before may come again."""
        rows, path = materialize(self.rows(df, id_col, seq_col), "texts")
        self.add_rows(rows)
        drop(self.spark, path)

    def _all(self, name: str) -> DataFrame | None:
        """A table's parts of all batches taken in."""
        parts = [f"{self.path}/{name}-{v}" for v in range(1, self.index.version + 1)]
        return self.spark.read.parquet(*parts) if parts else None

    def _part(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{self.index.version + 1}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add_rows(self, rows: DataFrame) -> None:
        import pyarrow as pa

        length, k, old = self.length, self.k, self._all("members")
        texts = rows.groupBy("text_key").agg(F.max("seq").alias("seq"))
        members = rows.select(F.xxhash64("text_key").alias("tid"), "text_key", "id").distinct()
        if old is not None:
            texts = texts.join(old.select("text_key").distinct(), "text_key", "left_anti")
            members = members.join(old.select("text_key", "id"), ["text_key", "id"], "left_anti").select("tid", "text_key", "id")

        def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                seqs = part.column(1).to_pylist()
                for lo, hi in groups_of([len(s) for s in seqs], 1 << 18):
                    c, starts = joined_codes(seqs[lo:hi])
                    own, h, at, n = occurrences(c, starts, length, k)
                    if len(own):
                        bases = _arrow_packed(*packed(c, at, n + (length - 1)))
                        tid = part.column(0).slice(lo, hi - lo).take(pa.array(own))
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), tid, pa.array(at - starts[own]), pa.array(n), bases], ["h", "tid", "start", "n", "bases"])

        self._part(members, "members")
        occ = texts.select(F.xxhash64("text_key").alias("tid"), "seq").mapInArrow(read, "h bigint, tid bigint, start bigint, n bigint, bases binary")
        occ = self._part(occ, "occurrences")
        version = self.index.version + 1
        self.index.add(occ.select("h", F.col("tid").alias("id")), f"{self.path}/shared-{version}")

    def spans(self) -> DataFrame:
        """``id``, ``span_start``, ``span_end`` of everything taken in so far."""
        members, occ, shared = self._all("members"), self._all("occurrences"), self._all("shared")
        if occ is None:
            return self.spark.createDataFrame([], "id string, span_start bigint, span_end bigint")
        length = self.length
        copied = members.groupBy("tid").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("tid")
        runs = common_runs(occ.join(shared.distinct(), "h", "left_semi"), length, self.many)
        whole = occ.select("tid", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")).join(copied, "tid", "left_semi")
        order = Window.partitionBy("tid").orderBy("first", "last")  # bounded by one text
        reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) + length
        marked = runs.unionByName(whole).withColumn("new", (F.col("first") > F.coalesce(reach, F.lit(-1))).cast("int"))
        marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        spans = marked.groupBy("tid", "run").agg(F.min("first").alias("span_start"), (F.max("last") + length).alias("span_end"))
        found = spans.join(members.select("tid", "id"), "tid").select("id", "span_start", "span_end")
        return materialize(found, "found")[0]

    def close(self) -> None:
        """Forget the session's tables; the folder stays if its path was given."""
        self.index.close()
        if not self.kept:
            drop(self.spark, self.path)

    def __enter__(self) -> SpanStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
