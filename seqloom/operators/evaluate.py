"""Edges, layouts and circular orders against the truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import periods_and_gaps
from .ranking import entity_rank, global_rank, running_before


def truth_ranks(reads: DataFrame) -> DataFrame:
    """``rid``, ``true_start``, ``true_end`` and ``rank``, the position by true start (ties by id)."""
    return global_rank(reads.select("rid", "true_start", "true_end"), [F.col("true_start"), F.col("rid")])


def true_adjacent(ranks: DataFrame) -> DataFrame:
    """Pairs next to each other by true start that overlap: ``left_id``, ``right_id``."""
    a = ranks.select(F.col("rid").alias("left_id"), F.col("true_end").alias("e"), F.col("rank"))
    b = ranks.select(F.col("rid").alias("right_id"), F.col("true_start").alias("s"), (F.col("rank") - 1).alias("rank"))
    return a.join(b, "rank").where("e > s").select("left_id", "right_id")


def label_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds ``label``, ``true_shift`` and ``true_overlap``: edges forward between overlapping reads are correct, to the next read or by a jump; edges of unknown reads are left out."""
    side = lambda s: ranks.select(F.col("rid").alias(f"{s}_id"), F.col("true_start").alias(f"_{s}s"), F.col("true_end").alias(f"_{s}e"), F.col("rank").alias(f"_{s}r"))
    d = edges.join(side("left"), "left_id").join(side("right"), "right_id")
    ok = (F.col("_leftr") < F.col("_rightr")) & (F.col("_lefte") > F.col("_rights")) & (F.col("_righte") > F.col("_lefts"))
    label = F.when(ok & (F.col("_rightr") == F.col("_leftr") + 1), "adjacent_correct").when(ok, "jump_correct").otherwise("wrong_edge")
    overlap = F.greatest(F.lit(0), F.least("_lefte", "_righte") - F.greatest("_lefts", "_rights"))
    return d.withColumns({"label": label, "true_shift": F.col("_rights") - F.col("_lefts"), "true_overlap": overlap}).drop(*[f"_{s}{x}" for s in ("left", "right") for x in "ser"])


def edge_report(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: counts of labels, precision, recall of adjacent pairs, and shift errors of the correct edges (null without any)."""
    d = label_edges(edges, ranks)
    wrong = F.col("label") == "wrong_edge"
    err = F.when(~wrong, F.abs(F.col("shift") - F.col("true_shift")))
    g = d.agg(
        F.count(F.lit(1)).alias("total_edges"), F.count_if(F.col("label") == "adjacent_correct").alias("adjacent_correct"), F.count_if(F.col("label") == "jump_correct").alias("jump_correct"),
        F.count_if(wrong).alias("wrong_edges"), F.avg(err).alias("mean_shift_error"), F.median(err).alias("median_shift_error"), F.max(err).alias("max_shift_error"),
    )
    adj = true_adjacent(ranks)
    missing = adj.join(edges.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    total = adj.agg(F.count(F.lit(1)).alias("n")).scalar()
    correct = F.col("adjacent_correct") + F.col("jump_correct")
    return g.withColumns({
        "missing_adjacent_edges": missing, "edge_precision": F.when(F.col("total_edges") > 0, correct / F.col("total_edges")).otherwise(0.0),
        "adjacent_recall": F.when(total > 0, F.col("adjacent_correct") / total).otherwise(0.0),
    })


def refinement_report(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """One row of error rates, identities and overlap errors of refined edges, and totals of their edits."""
    side = lambda s: reads.select(F.col("rid").alias(f"{s}_id"), F.col("true_start").alias(f"_{s}s"), F.col("true_end").alias(f"_{s}e"))
    d = edges.join(side("left"), "left_id").join(side("right"), "right_id")
    err = F.abs(F.col("overlap_len") - F.greatest(F.lit(0), F.least("_lefte", "_righte") - F.greatest("_lefts", "_rights")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = d.agg(
        F.count(F.lit(1)).alias("total_edges"), F.avg("error_rate").alias("mean_error_rate"), F.median("error_rate").alias("median_error_rate"), F.max("error_rate").alias("max_error_rate"),
        F.avg("identity").alias("mean_identity"), F.avg(err).alias("mean_overlap_error"), F.median(err).alias("median_overlap_error"), F.max(err).alias("max_overlap_error"),
        *[total(c).alias(f"total_{c}") for c in ("mismatches", "insertions", "deletions", "edit_distance")], total("overlap_len").alias("total_alignment_length"),
    )
    n = F.col("total_alignment_length")
    return g.withColumns({"total_gaps": F.col("total_insertions") + F.col("total_deletions"), "aggregate_error_rate": F.when(n > 0, F.col("total_edit_distance") / n)})


def gap_truth(edges: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds counts of alignment columns against the reads' reference coordinates.

    A gap is supported where the base opposite is an insertion (-1), or lies within the gapped read's true span but has no base there. Two bases are homologous where
    both have the same coordinate. Edges without alignment or coordinates have nulls. Indices are into the reads as stored.
    """
    side = lambda s, c: reads.select(F.col("rid").alias(f"{s}_id"), F.col("ref_coords").alias(c), F.col("true_start").alias(f"{c}s"), F.col("true_end").alias(f"{c}e"))
    d = edges.join(side("left", "_x"), "left_id", "left").join(side("right", "_y"), "right_id", "left")
    known = F.col("aligned_left").isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull()
    # running indices: bases of a side up to a column
    index = lambda text, start: F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.col(start) + F.length(F.translate(F.substring(F.col(text), F.lit(1), i), "-", "")))
    letters = F.arrays_zip(
        F.split("aligned_left", "").alias("a"), F.split("aligned_right", "").alias("b"), index("aligned_left", "left_start").alias("i"), index("aligned_right", "right_start").alias("j")
    )
    at = lambda arr, k: F.try_element_at(F.col(arr), k.cast("int"))

    def kind(c: Column) -> Column:
        l, r = at("_x", c["i"]), at("_y", c["j"])
        held = lambda v, arr: F.when(v < 0, True).otherwise((v >= F.col(f"{arr}s")) & (v < F.col(f"{arr}e")) & ~F.array_contains(F.col(arr), v))
        return (
            F.when(c["a"] == "-", F.when(held(r, "_x"), "supported").otherwise("unsupported"))
            .when(c["b"] == "-", F.when(held(l, "_y"), "supported").otherwise("unsupported"))
            .when((l >= 0) & (r >= 0) & (l == r), "homologous")
            .otherwise("misaligned")
        )

    d = d.withColumn("_k", F.when(known & (F.length("aligned_left") > 0), F.transform(letters, kind)))
    n = lambda *names: F.when(known, F.size(F.filter(F.coalesce("_k", F.array().cast("array<string>")), lambda k: k.isin(*names))).cast("bigint"))
    d = d.withColumns({"gap_columns": n("supported", "unsupported"), "supported_gap_columns": n("supported"), "homologous_columns": n("homologous"), "misaligned_columns": n("misaligned")})
    return d.drop("_k", "_x", "_xs", "_xe", "_y", "_ys", "_ye")


def inversions(order: DataFrame, position: str, value: str, size: int) -> DataFrame:
    """Number of pairs of an order (``position``, ``value`` a permutation of 0..size-1) that stand the wrong way round: one row ``inversions``.

    Bit by bit, values with the same higher bits are an entity; a 0 behind a 1 is an inversion, counted by running sums over buckets of positions.
    """
    bits = max(1, math.ceil(math.log2(max(2, size))))
    v = F.col(value)
    d = order.select(F.col(position).alias("pos"), v.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    d = d.select("pos", "bit", F.shiftright("v", 0).alias("v"), F.expr("shiftright(v, bit + 1)").alias("high"), F.expr("shiftright(v, bit) & 1").alias("one"))
    r = running_before(d, ["bit", "high"], "pos", "one")
    return r.agg(F.coalesce(F.sum(F.when(F.col("one") == 0, F.col("before"))), F.lit(0)).cast("bigint").alias("inversions"))


def layout_report(layout: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """One row for a layout (``position`` from 0, ``rid``): length, right and wrong neighbours, inversions."""
    d = layout.join(ranks.select("rid", "rank"), "rid", "left")
    nxt = d.select((F.col("position") - 1).alias("position"), F.col("rank").alias("next_rank"), F.lit(True).alias("there"))
    j = d.join(nxt, "position", "left")
    right = F.coalesce(F.col("next_rank") == F.col("rank") + 1, F.lit(False))
    g = j.agg(F.count(F.lit(1)).alias("order_length"), F.count_if(F.col("there") & right).alias("adjacent_correct"), F.count_if(F.col("there") & ~right).alias("wrong_adjacencies"))
    inv = inversions(d.where("rank is not null"), "position", "rank", size)
    return g.crossJoin(inv)  # one row each


def best_placements(p: DataFrame) -> DataFrame:
    """One placement per read: longest span, then identity (null last), mapq, contig and start."""
    span = F.col("reference_end") - F.col("reference_start")
    key = F.struct(span.alias("span"), F.coalesce("identity", F.lit(-1.0)).alias("i"), F.coalesce("mapq", F.lit(-1)).alias("q"), "contig", (-F.col("reference_start")).alias("s"))
    d = p.where("read_id is not null and contig is not null and reference_start >= 0 and reference_start < reference_end")
    b = d.groupBy("read_id").agg(F.max_by(F.struct("contig", "orientation", "reference_start", "reference_end", "identity", "mapq"), key).alias("b"))
    return b.select("read_id", "b.*")


def cyclic_successors(df: DataFrame, entity: str, pos: str, item: str) -> DataFrame:
    """``entity``, ``item`` and ``successor``: the next item of the entity by ``pos`` (ties by item), behind the last one the first."""
    r = entity_rank(df.select(entity, pos, item), [entity], pos, [item])
    nxt = r.select(entity, F.pmod(F.col("rank") - 1, F.col("rank_n")).alias("rank"), F.col(item).alias("successor"))
    return r.join(nxt, [entity, "rank"]).select(entity, item, "successor")


def circular_report(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per entity: predicted items, neighbours that are right forwards and backwards, and whether the whole order equals the truth up to rotation.

    Both inputs have entity, item and successor as made by :func:`cyclic_successors`.
    """
    t = truth.select("entity", "item", F.col("successor").alias("true_next"))
    b = truth.select("entity", F.col("successor").alias("item"), F.col("item").alias("true_back"))
    j = predicted.join(t, ["entity", "item"], "left").join(b, ["entity", "item"], "left")
    g = j.groupBy("entity").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("successor") == F.col("true_next")).alias("forward"), F.count_if(F.col("successor") == F.col("true_back")).alias("backward")
    )
    sizes = truth.groupBy("entity").agg(F.count(F.lit(1)).alias("true_items"))
    n = F.col("items")
    return g.join(sizes, "entity", "left").select(
        "entity", "items", (F.col("forward") / n).alias("forward_accuracy"), (F.col("backward") / n).alias("backward_accuracy"),
        F.coalesce((n == F.col("true_items")) & (F.col("forward") == n), F.lit(False)).alias("exact_forward"), F.coalesce((n == F.col("true_items")) & (F.col("backward") == n), F.lit(False)).alias("exact_backward"),
    )


def circle_coverage(intervals: DataFrame) -> DataFrame:
    """Positions covered per entity, from unwrapped intervals."""
    p = periods_and_gaps(intervals).where("kind = 'covered'")
    return p.groupBy("entity").agg(F.sum(F.col("pos_end") - F.col("pos_start")).alias("covered"))


def compare_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs found by both, only by the first, only by the second: ``kind``, ``n``."""
    x, y = a.select("left_id", "right_id").distinct().withColumn("a", F.lit(1)), b.select("left_id", "right_id").distinct().withColumn("b", F.lit(1))
    j = x.join(y, ["left_id", "right_id"], "full_outer")
    return j.groupBy(F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").otherwise("common").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def recoverability_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds ``direction``: ``backward``, ``gap`` (the left read ends before the right one begins) or ``contiguous``."""
    side = lambda s: ranks.select(F.col("rid").alias(f"{s}_id"), F.col("true_start").alias(f"_{s}s"), F.col("true_end").alias(f"_{s}e"), F.col("rank").alias(f"{s}_rank"))
    d = edges.join(side("left"), "left_id").join(side("right"), "right_id")
    return d.withColumn("direction", F.when(F.col("left_rank") >= F.col("right_rank"), "backward").when(F.col("_lefte") < F.col("_rights"), "gap").otherwise("contiguous")).drop("_lefts", "_lefte", "_rights", "_righte")


def cycle_laps(nodes: DataFrame) -> DataFrame:
    """A circle's nodes (contig, length, node, start) as a cycle by start: ``contig``, ``nodes``, ``shift`` (the sum of the ways from each node to the next), ``laps`` (the nearest whole ones) and ``beyond`` (the shift less these)."""
    from .ranking import entity_rank

    r = entity_rank(nodes, ["contig"], "start", ["node"])
    nxt = r.select("contig", F.col("rank").alias("at"), F.col("start").alias("next"))
    j = r.withColumn("at", F.pmod(F.col("rank") + 1, F.col("rank_n"))).join(nxt, ["contig", "at"])
    last = F.col("rank") + 1 == F.col("rank_n")
    step = F.col("next") - F.col("start") + F.when(last & (F.col("rank_n") > 1), F.col("length")).otherwise(0)
    g = j.groupBy("contig", "length").agg(F.count(F.lit(1)).alias("nodes"), F.sum(step).alias("shift"))
    laps = F.round(F.col("shift") / F.col("length")).cast("bigint")
    return g.select("contig", "nodes", "shift", laps.alias("laps"), (F.col("shift") - laps * F.col("length")).alias("beyond"))


#: Causes of a missing side, the first that applies to any neighbour counts (fixed values).
SIDE_CAUSES = (
    "unexpected_final_edge", "paf_edge_removed_after_projection", "candidate_deduplicated", "paf_only_opposite_or_other_orientation", "candidate_only_opposite_or_other_orientation",
    "directed_candidate_geometry", "no_positive_shift_dovetail", "above_error_hint", "below_identity", "below_min_overlap", "no_paf_record",
)
_STAGES = {"passes": "directed_candidate_geometry", "geometry": "no_positive_shift_dovetail", "error_hint": "above_error_hint", "identity": "below_identity", "overlap": "below_min_overlap"}


def missing_side_causes(sides: DataFrame, neighbours: DataFrame, candidates: DataFrame, projected: DataFrame, final: DataFrame, audit: DataFrame) -> DataFrame:
    """Why nodes have no edge on a side: ``node``, ``side`` (``in`` or ``out``), ``neighbours`` (looked at), ``cause``.

    For each of a node's ``neighbours`` (node, other) the edge that should be there is looked for among the ``final``, ``projected`` and ``candidates`` edges (source, target), then any edge of the two reads among the
    latter two, then the alignments' ``audit`` (first_id, second_id, status); the cause is the first of ``SIDE_CAUSES`` that any neighbour gives, or ``no_nearby_retained_read``. ``sides`` has node and side.
    """
    read = lambda c: F.regexp_replace(c, "[+-]$", "")
    d = sides.join(neighbours, "node").withColumns({
        "source": F.when(F.col("side") == "in", F.col("other")).otherwise(F.col("node")), "target": F.when(F.col("side") == "in", F.col("node")).otherwise(F.col("other")),
        "a": F.least(read("node"), read("other")), "b": F.greatest(read("node"), read("other")),
    })
    keys = lambda e, name: e.select("source", "target").distinct().withColumn(name, F.lit(True))
    pairs = lambda e, name: e.select(F.least(read("source"), read("target")).alias("a"), F.greatest(read("source"), read("target")).alias("b")).distinct().withColumn(name, F.lit(True))
    for e, name in ((final, "f"), (projected, "p"), (candidates, "c")):
        d = d.join(keys(e, name), ["source", "target"], "left")
    for e, name in ((projected, "pp"), (candidates, "cp")):
        d = d.join(pairs(e, name), ["a", "b"], "left")
    d = d.join(audit.select(F.col("first_id").alias("a"), F.col("second_id").alias("b"), "status"), ["a", "b"], "left")
    stage = F.lit("no_paf_record")
    for status, cause in _STAGES.items():
        stage = F.when(F.col("status") == status, cause).otherwise(stage)
    found = F.when(F.col("f"), SIDE_CAUSES[0]).when(F.col("p"), SIDE_CAUSES[1]).when(F.col("c"), SIDE_CAUSES[2]).when(F.col("pp"), SIDE_CAUSES[3]).when(F.col("cp"), SIDE_CAUSES[4]).otherwise(stage)
    rank = F.array_position(F.lit(list(SIDE_CAUSES)), found)
    best = d.groupBy("node", "side").agg(F.count(F.lit(1)).alias("neighbours"), F.min_by(found, rank).alias("cause"))
    zero = F.lit(0).cast("bigint")
    return sides.join(best, ["node", "side"], "left").select("node", "side", F.coalesce("neighbours", zero).alias("neighbours"), F.coalesce("cause", F.lit("no_nearby_retained_read")).alias("cause"))
