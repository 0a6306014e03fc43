"""From reads to layouts, with every step a function that can be replaced.

A step is any callable with the signature of its protocol; the defaults are this package's own operators. Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import align, layout, overlap, paf, qubo, scoring
from .session import materialize


class CandidateFinder(Protocol):
    """Reads (``rid``, ``seq``) to candidates as made by :func:`seqloom.operators.paf.candidates`."""

    def __call__(self, reads: DataFrame) -> DataFrame: ...


class Refiner(Protocol):
    """Candidates and reads to edges with alignment statistics and ``accepted``, as made by :func:`seqloom.operators.align.refine`."""

    def __call__(self, candidates: DataFrame, reads: DataFrame) -> DataFrame: ...


class ModelBuilder(Protocol):
    """Numbered reads and edges to the terms of their models (``model``, ``i``, ``j``, ``coeff``)."""

    def __call__(self, nodes: DataFrame, edges: DataFrame) -> DataFrame: ...


class LayoutSolver(Protocol):
    """Numbered reads, edges and terms to layouts, as made by :func:`seqloom.operators.layout.solve_layouts`."""

    def __call__(self, nodes: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame: ...


def seed_candidates(reads: DataFrame, config: paf.PafConfig | None = None) -> DataFrame:
    """Candidates of the native finder through the filter chain of alignment records."""
    config = config or paf.PafConfig(min_overlap=100, max_error_hint=1.0, tolerance=25)
    records = overlap.seed_chains(reads).withColumns({"malformed": F.lit(False), "tags": F.expr("cast(map() as map<string,string>)"), "line_no": F.xxhash64("q_id", "t_id", "strand")})
    return paf.candidates(paf.with_outcomes(records, config))


def path_cover_terms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return qubo.path_cover_model(nodes, edges).terms()


def tabu_path_covers(nodes: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    return layout.solve_layouts(nodes, edges, terms, "path_cover", "tabu")


@dataclass(frozen=True)
class Pipeline:
    """Find candidates, align them, keep the best edge of every oriented pair, group reads into models, build and solve."""

    find: CandidateFinder = seed_candidates
    refine: Refiner = align.refine
    build: ModelBuilder = path_cover_terms
    solve: LayoutSolver = tabu_path_covers
    score: str = "overlap_len"

    def edges(self, reads: DataFrame) -> DataFrame:
        """Accepted edges, the best of every oriented pair: ``source``, ``target`` (signed reads), ``reward`` and the columns of the refiner."""
        from .functions.seq import reward, sign_token

        found, _ = materialize(self.refine(self.find(reads), reads).where("accepted").withColumn("ordinal", F.xxhash64("left_id", "right_id", "left_start", "right_end")), "refined")
        best = scoring.best_edges(found.withColumn("weight_dp", F.col("dp_score")), "ordinal")
        token = lambda side: F.concat(f"{side}_id", sign_token(f"{side}_orientation"))
        return best.withColumns({"source": token("left"), "target": token("right"), "reward": reward(self.score)})

    def layouts(self, reads: DataFrame, places: DataFrame) -> DataFrame:
        """Layouts of the reads of every model: ``places`` has ``model``, ``node`` (a signed read) and ``pos``, by which reads are numbered; edges lead to later places."""
        e, _ = materialize(self.edges(reads), "edges")
        at = lambda x, y: places.select("model", F.col("node").alias(x), F.col("pos").alias(y))
        pairs = e.select("source", "target", "reward").join(at("source", "a"), "source").join(at("target", "b"), ["model", "target"]).where("a < b")
        pairs = pairs.groupBy("model", F.col("source").alias("left"), F.col("target").alias("right")).agg(F.max("reward").alias("reward"))
        nodes, edges = (materialize(d, "numbered")[0] for d in qubo.number_graph(places.select("model", "node", "pos"), pairs))
        return self.solve(nodes, edges, self.build(nodes, edges))
