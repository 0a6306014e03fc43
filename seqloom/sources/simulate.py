"""Random genomes and reads with known truth, one genome per task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .files import READS


@dataclass(frozen=True)
class SimulationConfig:
    """Reads of ``read_len`` every ``step`` bases, or, with all four ranges given, of random lengths and overlaps."""

    read_len: int = 400
    step: int = 200
    length_range: tuple[int, int] | None = None
    overlap_range: tuple[float, float] | None = None
    least_overlap: int | None = None
    mismatch_rate: float = 0.02
    insertion_rate: float = 0.01
    deletion_rate: float = 0.01
    gc_fraction: float = 0.5
    shuffle: bool = True

    def check(self) -> None:
        if self.read_len <= 0 or self.step <= 0:
            raise ValueError("read_len and step must be positive")
        if any(not 0 <= r <= 1 for r in (self.mismatch_rate, self.insertion_rate, self.deletion_rate, self.gc_fraction)):
            raise ValueError("rates and gc_fraction must lie between 0 and 1")
        if (self.length_range is None) != (self.overlap_range is None):
            raise ValueError("a random layout needs both ranges")
        if self.length_range is not None:
            (a, b), (x, y) = self.length_range, self.overlap_range
            if not 1 < a <= b or not 0 < x <= y <= 1:
                raise ValueError("ranges must be positive and in order")
            if self.least_overlap is not None and not 0 < self.least_overlap <= round(a * y):
                raise ValueError("least_overlap can't be met by the shortest read")


def fixed_layout(genomes: DataFrame, c: SimulationConfig) -> DataFrame:
    """``genome_id``, ``rid``, ``true_start``, ``true_end`` of reads at every ``step``; genomes (``genome_id``, ``length``) shorter than a read have none."""
    last = F.col("length") - c.read_len
    at = genomes.where(last >= 0).select("genome_id", F.posexplode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(c.step).cast("bigint"))).alias("i", "true_start"))
    return at.select("genome_id", F.concat("genome_id", F.lit("_read_"), "i").alias("rid"), "true_start", (F.col("true_start") + c.read_len).alias("true_end"))


def random_bases(rng: np.random.Generator, n: int, gc: float) -> np.ndarray:
    """Letters with A and T sharing ``1 - gc``, C and G sharing ``gc``."""
    return np.array(list("ATCG"))[np.searchsorted(np.cumsum([(1 - gc) / 2, (1 - gc) / 2, gc / 2]), rng.random(n), side="right")]


def mutate(rng: np.random.Generator, bases: np.ndarray, start: int, c: SimulationConfig) -> tuple[str, list[int]]:
    """A read with errors, and the reference coordinate of each of its bases (-1 for an inserted one)."""
    n = len(bases)
    inserted, deleted = rng.random(n + 1) < c.insertion_rate, rng.random(n) < c.deletion_rate
    changed = (rng.random(n) < c.mismatch_rate) & ~deleted
    out = bases.copy()
    while (same := changed & (out == bases)).any():
        out[same] = random_bases(rng, int(same.sum()), c.gc_fraction)
        if c.gc_fraction in (0.0, 1.0) and (changed & (out == bases)).any():
            fix = changed & (out == bases)
            out[fix] = [rng.choice([x for x in "ACGT" if x != b]) for b in bases[fix]]
    extra = random_bases(rng, n + 1, c.gc_fraction)
    letters, coords = np.empty(2 * n + 1, dtype="<U1"), np.full(2 * n + 1, -1)
    letters[0::2], letters[1::2], coords[1::2] = extra, out, np.arange(start, start + n)
    keep = np.empty(2 * n + 1, bool)
    keep[0::2], keep[1::2] = inserted, ~deleted
    return "".join(letters[keep]), coords[keep].tolist()


def _random_layout(rng: np.random.Generator, length: int, c: SimulationConfig) -> Iterator[tuple[int, int]]:
    (a, b), (x, y) = c.length_range, c.overlap_range
    start, size = 0, int(rng.integers(a, b + 1))
    while start + size <= length:
        yield start, size
        for _ in range(1000):
            nxt = int(rng.integers(a, b + 1))
            short = min(size, nxt)
            low, high = max(1, round(short * x), c.least_overlap or 1), min(round(short * y), short - 1)
            if low > high:
                continue
            begin = start + size - int(rng.integers(low, high + 1))
            if begin > start and begin + nxt <= length:
                start, size = begin, nxt
                break
        else:
            return


def simulate_reads(genomes: DataFrame, c: SimulationConfig) -> DataFrame:
    """Reads of random genomes (``genome_id``, ``length``, ``seed``), in the reads schema with ``genome_id``. Equal seeds give equal reads, wherever they run."""
    c.check()
    ship(genomes.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for g in p.itertuples():
                rng = np.random.default_rng(int(g.seed) & ((1 << 63) - 1))
                genome = random_bases(rng, int(g.length), c.gc_fraction)
                places = _random_layout(rng, int(g.length), c) if c.length_range else ((s, c.read_len) for s in range(0, int(g.length) - c.read_len + 1, c.step))
                own = []
                for i, (s, n) in enumerate(places):
                    seq, coords = mutate(rng, genome[s : s + n], s, c)
                    own.append((g.genome_id, f"{g.genome_id}_read_{i}", seq, s, s + n, 1, coords))
                if c.shuffle:
                    rng.shuffle(own)
                rows += own
            yield pd.DataFrame(rows, columns=["genome_id", "rid", "seq", "true_start", "true_end", "strand", "ref_coords"])

    return genomes.select("genome_id", "length", "seed").mapInPandas(run, "genome_id string, " + READS)
