"""Queries of scalar functions, scores, rewards and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import align as A
from ..operators import evaluate as E
from ..operators import overlap as O
from ..operators import paf as P
from ..operators import scoring as C
from ..operators.ranking import entity_rank
from ..session import materialize, table
from . import inputs
from .overlap_plans import _UNGAPPED, seed_chain_candidates
from .overlap_plans import SQL as _OVERLAP_SQL
from .paf_plans import _BASE as _PAF_BASE
from .paf_plans import paf_candidates, paf_direct_edges


def revcomp_reads(spark, sf_dir):
    r = inputs.reads(spark, sf_dir)
    o = F.when(F.length("rid") % 2 == 0, 1).otherwise(-1)
    return r.select("rid", S.revcomp("seq").alias("revcomp"), S.revcomp_upper("seq").alias("upper"), S.oriented("seq", o).alias("oriented"))


def gc_by_read(spark, sf_dir):
    r = inputs.reads(spark, sf_dir)
    hot = F.transform(S.one_hot("seq"), lambda ch: F.aggregate(ch, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return r.select("rid", S.gc_count("seq").alias("gc"), F.round(S.gc_fraction("seq"), 9).alias("share"), hot[0].alias("n_a"), hot[1].alias("n_c"), hot[2].alias("n_g"), hot[3].alias("n_t"))


def scalar_functions(spark, sf_dir):
    """Tokens, slices, merging, bits, margins and CIGAR lengths over every edge."""
    e = inputs.edges(spark, sf_dir)
    cigar = F.concat(F.col("matches").cast("string"), F.lit("="), F.col("mismatches").cast("string"), F.lit("X3I2D"))
    return e.select(
        "paf_line", "source", "target", S.unsigned("source").alias("id"), S.orientation_of("source").alias("orientation"), S.sign_token("right_orientation").alias("sign"), S.dot_escape(F.concat(F.lit('"'), "target")).alias("dot"),
        S.clamp_slice("target", F.lit(2), F.col("overlap_len")).alias("slice"), S.merge_overlap("left_id", "right_id", F.lit(2)).alias("merged"), S.position_bits("overlap_len").alias("bits"),
        S.margin_weight("matches", "mismatches", 0.98).alias("margin"), S.cigar_lengths(cigar, "=XD").alias("cigar_target"), S.cigar_lengths(cigar, "=XI").alias("cigar_query"),
        F.round(S.identity("matches", "block"), 9).alias("identity"), F.round(S.error_rate("mismatches", "block"), 9).alias("error_rate"),
        S.spell_path(F.array("left_id", "right_id", "source"), F.array(F.lit(1), F.lit(2))).alias("path"),
    )


def likelihood_weights(spark, sf_dir):
    """Likelihood weight of each pair of overlap length and errors that occurs; distinct pairs are computed once and joined by value."""
    e = inputs.edges(spark, sf_dir).groupBy(F.col("matches").alias("length"), F.col("mismatches").alias("distance")).agg(F.count(F.lit(1)).alias("edges"))
    w = F.pandas_udf(lambda a, b: __import__("pandas").Series([S.likelihood_weight(int(x), int(y)) for x, y in zip(a, b)]), "double")
    return e.select("length", "distance", "edges", F.round(w("length", "distance"), 6).alias("weight"))


def edge_dedup(spark, sf_dir):
    return C.best_edges(inputs.edges(spark, sf_dir), "paf_line").select("source", "target", "paf_line", "weight_dp", "dp_score")


_MODES = ["overlap_len", "overlap_len_power2", "overlap_len_power:1.5", "overlap_len_power3", "identity", "dp", "matches", "quality", "quality_margin"]


def edge_rewards(spark, sf_dir):
    """Best normalised reward of each pair, for nine modes."""
    return C.all_pair_rewards(inputs.edges(spark, sf_dir), _MODES).select("mode", "left_id", "right_id", F.round("reward", 9).alias("reward"))


def mutual_information_rewards(spark, sf_dir):
    """The information-based reward modes over the ungapped overlaps."""
    m = C.mutual_information(_ungapped_columns(spark, sf_dir), ["left_id", "right_id", "overlap_len"])
    m = m.withColumn("weight_mi", F.col("overlap_len") * F.col("nmi"))
    return m.select("left_id", "right_id", *[F.round(S.reward(x), 6).alias(x) for x in ("mi", "raw_mi", "nmi", "weighted_nmi")])


def extension_costs(spark, sf_dir):
    return C.extension_costs(inputs.edges(spark, sf_dir), inputs.reads(spark, sf_dir))


def topk_edges(spark, sf_dir):
    e = inputs.edges(spark, sf_dir)
    return C.top_per_node(e, 3, F.col("identity") * 1000 + F.col("overlap_len")).select("source", "target", "paf_line")


def _ungapped_columns(spark, sf_dir):
    r = inputs.reads(spark, sf_dir)
    o = O.ungapped_overlaps(r, 100, 0.97)
    a, b = r.select(F.col("rid").alias("left_id"), F.col("seq").alias("x")), r.select(F.col("rid").alias("right_id"), F.col("seq").alias("y"))
    j = o.join(a, "left_id").join(b, "right_id")
    return j.select("left_id", "right_id", F.col("overlap").alias("overlap_len"), F.expr("substring(x, length(x) - int(overlap) + 1)").alias("aligned_left"), F.expr("substring(y, 1, int(overlap))").alias("aligned_right"))


def mi_scores(spark, sf_dir):
    m = C.mutual_information(_ungapped_columns(spark, sf_dir), ["left_id", "right_id"])
    return m.select("left_id", "right_id", "columns", *[F.round(x, 6).alias(x) for x in ("mi", "nmi", "mi_distance", "h_left", "h_right")])


def top_mi_edges(spark, sf_dir):
    """The ten edges of the highest mutual information."""
    return mi_scores(spark, sf_dir).orderBy(F.desc("mi"), "left_id", "right_id").limit(10).select("left_id", "right_id", "mi")


def overlap_gc(spark, sf_dir):
    r = inputs.reads(spark, sf_dir)
    e = P.direct_edges(_cands(spark, sf_dir)).select("line_no", "left_id", "right_id", "left_start", "left_end", "right_start", "right_end", "overlap_len")
    out = None
    for m in ("average", "left", "right"):
        d = C.overlap_composition(e, r, m).select("line_no", F.lit(m).alias("method"), F.round("gc_length", 6).alias("gc_length"), F.round("gc", 6).alias("gc"), F.round("gc_share", 9).alias("gc_share"), "gc_source")
        out = d if out is None else out.unionByName(d)
    return out


def _cands(spark, sf_dir):
    from .paf_plans import CONFIG, _records

    return P.candidates(_records(spark, sf_dir, CONFIG))


def align_semiglobal(spark, sf_dir):
    """Alignments of the natively found candidates."""
    r = inputs.reads(spark, sf_dir)
    c = seed_chain_candidates(spark, sf_dir).withColumns({"left_start_hint": F.greatest(F.lit(0), F.col("rough_shift")), "right_end_hint": F.col("rough_overlap_len")})
    return A.refine(c, r)


def pipeline_report(spark, sf_dir):
    """Find, refine, keep the best, evaluate: one row."""
    e = align_semiglobal(spark, sf_dir).where("accepted").withColumn("ordinal", F.xxhash64("aligned_left", "aligned_right"))
    # the report reads the edges more than once; they are aligned once
    e, _ = materialize(e.select("left_id", "right_id", "left_orientation", "right_orientation", "shift", "weight_dp", "dp_score", "ordinal"), "refined")
    best, _ = materialize(C.best_edges(e, "ordinal"), "best")
    return E.edge_report(best, E.truth_ranks(inputs.reads(spark, sf_dir)))


def alignment_gap_truth(spark, sf_dir):
    """Gap columns of the alignments against the reference coordinates of the reads."""
    coords = table(spark, sf_dir, "reads").where("rid is not null and ref_coords is not null").groupBy("rid").agg(F.max("ref_coords").alias("ref_coords"))
    r = inputs.reads(spark, sf_dir).join(coords, "rid", "left")
    return E.gap_truth(align_semiglobal(spark, sf_dir), r).select("left_id", "right_id", "gap_columns", "supported_gap_columns", "homologous_columns", "misaligned_columns")


def _ranks(spark, sf_dir):
    return E.truth_ranks(inputs.reads(spark, sf_dir).where("true_start >= 0 and true_end > true_start"))


def truth_rank(spark, sf_dir):
    return _ranks(spark, sf_dir).select("rid", F.col("rank").cast("bigint").alias("rank"))


def true_adjacent(spark, sf_dir):
    return E.true_adjacent(_ranks(spark, sf_dir))


def _shifted(spark, sf_dir):
    return inputs.edges(spark, sf_dir).withColumn("shift", F.col("block") - F.col("overlap_len"))


def edge_labels(spark, sf_dir):
    return E.label_edges(_shifted(spark, sf_dir), _ranks(spark, sf_dir)).select("source", "target", "paf_line", "label", "true_shift", "true_overlap")


def edge_eval_report(spark, sf_dir):
    g = E.edge_report(_shifted(spark, sf_dir).join(_ranks(spark, sf_dir).select(F.col("rid").alias("left_id")), "left_id", "left_semi"), _ranks(spark, sf_dir))
    return g.select("total_edges", "adjacent_correct", "jump_correct", "wrong_edges", "missing_adjacent_edges", *[F.round(x, 9).alias(x) for x in ("edge_precision", "adjacent_recall", "mean_shift_error", "median_shift_error")], "max_shift_error")


def candidate_eval_report(spark, sf_dir):
    """Raw candidates against the truth, before any alignment."""
    c = _cands(spark, sf_dir).select("left_id", "right_id", F.col("rough_shift").alias("shift"))
    g = E.edge_report(c, _ranks(spark, sf_dir))
    return g.select("total_edges", "adjacent_correct", "jump_correct", "wrong_edges", F.round("mean_shift_error", 6).alias("mean_shift_error"))


def refinement_report(spark, sf_dir):
    g = E.refinement_report(inputs.edges(spark, sf_dir), inputs.reads(spark, sf_dir))
    real = [c for c, t in g.dtypes if t == "double"]
    return g.withColumns({c: F.round(c, 9) for c in real})


def score_by_truth(spark, sf_dir):
    """Edges and mean weight per class of truth by rank alone."""
    d = E.recoverability_edges(inputs.edges(spark, sf_dir), _ranks(spark, sf_dir))
    gap = F.col("right_rank") - F.col("left_rank")
    return d.groupBy(F.when(gap == 1, "adjacent").when(gap > 1, "jump").otherwise("wrong").alias("truth")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("weight_dp"), 6).alias("mean_weight"))


def recoverability_classes(spark, sf_dir):
    return E.recoverability_edges(inputs.edges(spark, sf_dir), _ranks(spark, sf_dir)).groupBy("direction").agg(F.count(F.lit(1)).alias("edges"))


def layout_eval(spark, sf_dir):
    """The layout of all reads by id, against the truth."""
    from ..operators.ranking import global_rank

    k = _ranks(spark, sf_dir)
    layout = global_rank(k.select("rid"), [F.col("rid")], "position")
    return E.layout_report(layout, k, k.count())


def method_comparison(spark, sf_dir):
    r = inputs.reads(spark, sf_dir)
    exact = O.exact_overlaps(r, 100, allow_full_length=False).select(F.col("src").alias("left_id"), F.col("dst").alias("right_id"))
    return E.compare_methods(exact, O.ungapped_overlaps(r, 100, 0.97))


def best_placements(spark, sf_dir):
    b = E.best_placements(table(spark, sf_dir, "placements"))
    return b.select("read_id", "contig", "orientation", "reference_start", "reference_end", "identity", "mapq")


def _circle_orders(spark, sf_dir):
    ring = table(spark, sf_dir, "contigs").where("topology = 'circular' and length > 0").select("contig", "length")
    n = table(spark, sf_dir, "nodes").where("read_id is not null and contig is not null and start >= 0").groupBy("contig", "read_id").agg(F.min("start").alias("pos"))
    p = E.best_placements(table(spark, sf_dir, "placements")).select("contig", "read_id", F.col("reference_start").alias("pos"))
    p = p.join(ring, "contig").select("contig", "read_id", F.pmod("pos", "length").alias("pos"))
    both = n.join(p.select("contig", "read_id"), ["contig", "read_id"], "left_semi"), p.join(n.select("contig", "read_id"), ["contig", "read_id"], "left_semi")
    return [d.select(F.col("contig").alias("entity"), "pos", F.col("read_id").alias("item")) for d in both]


def cyclic_successors(spark, sf_dir):
    return E.cyclic_successors(_circle_orders(spark, sf_dir)[1], "entity", "pos", "item").select(F.col("entity").alias("contig"), F.col("item").alias("read_id"), "successor")


def circular_order_eval(spark, sf_dir):
    """Placed reads of circular contigs: the order of the nodes against that of the placements."""
    pred, truth = (E.cyclic_successors(d, "entity", "pos", "item") for d in _circle_orders(spark, sf_dir))
    g = E.circular_report(pred, truth)
    return g.select(F.col("entity").alias("contig"), "items", F.round("forward_accuracy", 9).alias("forward_accuracy"), F.round("backward_accuracy", 9).alias("backward_accuracy"), "exact_forward", "exact_backward")


def interval_union_cover(spark, sf_dir):
    """Positions of circular contigs that placements cover."""
    from ..operators.intervals import unwrap_circular

    ring = table(spark, sf_dir, "contigs").where("topology = 'circular' and length > 0").select(F.col("contig").alias("entity"), "length")
    p = table(spark, sf_dir, "placements").where("contig is not null and reference_start >= 0 and reference_start < reference_end")
    i = p.select(F.col("contig").alias("entity"), F.col("reference_start").alias("start"), F.col("reference_end").alias("end")).join(ring.select("entity"), "entity", "left_semi").distinct()
    return E.circle_coverage(unwrap_circular(i, ring)).select(F.col("entity").alias("contig"), "covered")


def selected_span(spark, sf_dir):
    """Per contig: first start, last end and number of its nodes."""
    n = table(spark, sf_dir, "nodes").where("contig is not null and start >= 0 and start < `end`")
    return n.groupBy("contig").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.count_distinct("node").alias("nodes"))


def circular_neighbours(spark, sf_dir):
    """Nearest reads on either side of every placed read of a circular contig, and the step to the next one around the circle."""
    truth = _circle_orders(spark, sf_dir)[1]
    s = E.cyclic_successors(truth, "entity", "pos", "item")
    back = s.select("entity", F.col("successor").alias("item"), F.col("item").alias("predecessor"))
    at = truth.select("entity", "item", "pos")
    ring = table(spark, sf_dir, "contigs").select(F.col("contig").alias("entity"), "length")
    j = s.join(back, ["entity", "item"]).join(at, ["entity", "item"]).join(at.select("entity", F.col("item").alias("successor"), F.col("pos").alias("next")), ["entity", "successor"]).join(ring, "entity")
    return j.select(F.col("entity").alias("contig"), F.col("item").alias("read_id"), "predecessor", "successor", F.pmod(F.col("next") - F.col("pos"), F.col("length")).alias("step"))


_FUNCTIONS = (
    revcomp_reads, gc_by_read, scalar_functions, likelihood_weights, edge_dedup, edge_rewards, mutual_information_rewards, extension_costs, topk_edges, mi_scores, top_mi_edges, overlap_gc, align_semiglobal,
    pipeline_report, alignment_gap_truth, truth_rank, true_adjacent, edge_labels, edge_eval_report, candidate_eval_report, refinement_report, score_by_truth, recoverability_classes, layout_eval,
    method_comparison, best_placements, cyclic_successors, circular_order_eval, interval_union_cover, selected_span, circular_neighbours,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_R = "WITH " + inputs.READS
_E = "WITH " + inputs.EDGES
_RE = "WITH " + inputs.READS + "," + inputs.EDGES
_RANKS = """, k AS (SELECT rid, true_start, true_end, row_number() OVER (ORDER BY true_start, rid) - 1 AS rank FROM r WHERE true_start >= 0 AND true_end > true_start),
    adj AS (SELECT a.rid AS left_id, b.rid AS right_id FROM k a JOIN k b ON b.rank = a.rank + 1 WHERE a.true_end > b.true_start)"""
_LABEL = """SELECT {0}, CASE WHEN a.rank < b.rank AND a.true_end > b.true_start AND b.true_end > a.true_start THEN CASE WHEN b.rank = a.rank + 1 THEN 'adjacent_correct' ELSE 'jump_correct' END ELSE 'wrong_edge' END AS label,
    b.true_start - a.true_start AS true_shift, greatest(0, least(a.true_end, b.true_end) - greatest(a.true_start, b.true_start)) AS true_overlap FROM {1} JOIN k a ON a.rid = left_id JOIN k b ON b.rid = right_id"""
_REWARD = {
    "overlap_len": "overlap_len", "overlap_len_power2": "overlap_len ** 2", "overlap_len_power:1.5": "CAST(overlap_len AS DOUBLE) ** 1.5", "overlap_len_power3": "overlap_len ** 3", "identity": "identity",
    "dp": "coalesce(weight_dp, dp_score, overlap_len * identity)", "matches": "matches", "quality": "overlap_len * identity * greatest(0, 1 - error_rate)", "quality_margin": "matches - 49 * mismatches",
}
_COLUMNS = "WITH " + inputs.READS + "," + _UNGAPPED.replace("{0}", "SELECT rid, 1 AS o, seq FROM r").split(inputs.READS + ",", 1)[1].rsplit("SELECT a AS left_id", 1)[0] + """,
    al AS (SELECT w.a, w.b, n, substr(p.seq, length(p.seq) - n + 1) AS x, substr(q.seq, 1, n) AS y FROM w JOIN r p ON p.rid = w.a JOIN r q ON q.rid = w.b WHERE w.k = 1),
    col AS (SELECT a, b, n AS len, substr(x, i, 1) AS x, substr(y, i, 1) AS y FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM al)),
    cxy AS (SELECT a, b, len, x, y, count(*) AS n FROM col GROUP BY ALL),
    cw AS (SELECT *, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny FROM cxy),
    cs AS (SELECT a AS left_id, b AS right_id, CAST(any_value(len) AS BIGINT) AS len, CAST(any_value(t) AS BIGINT) AS columns, sum(n / t * log2(n * t / (nx * ny))) AS mi, -sum(n / t * log2(nx / t)) AS h_left, -sum(n / t * log2(ny / t)) AS h_right FROM cw GROUP BY a, b),
    mi AS (SELECT *, CASE WHEN h_left + h_right > 0 THEN greatest(0.0, least(1.0, 2 * mi / (h_left + h_right))) ELSE 0 END AS nmi FROM cs)"""
_PLACED = """
    bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY reference_end - reference_start DESC, coalesce(identity, -1) DESC, coalesce(mapq, -1) DESC, contig DESC, reference_start) AS k
           FROM placements WHERE read_id IS NOT NULL AND contig IS NOT NULL AND reference_start >= 0 AND reference_start < reference_end) WHERE k = 1)"""
_CIRCLE = "WITH " + _PLACED + """,
    ring AS (SELECT contig, length FROM contigs WHERE topology = 'circular' AND length > 0),
    n0 AS (SELECT contig, read_id, min(start) AS pos FROM nodes WHERE read_id IS NOT NULL AND contig IS NOT NULL AND start >= 0 GROUP BY ALL),
    p0 AS (SELECT bp.contig, read_id, reference_start % length AS pos FROM bp JOIN ring USING (contig)),
    n1 AS (SELECT * FROM n0 SEMI JOIN p0 USING (contig, read_id)), p1 AS (SELECT * FROM p0 SEMI JOIN n0 USING (contig, read_id)),
    ns AS (SELECT contig, read_id, coalesce(lead(read_id) OVER w, first_value(read_id) OVER w) AS nxt FROM n1 WINDOW w AS (PARTITION BY contig ORDER BY pos, read_id)),
    ps AS (SELECT contig, read_id, pos, coalesce(lead(read_id) OVER w, first_value(read_id) OVER w) AS nxt FROM p1 WINDOW w AS (PARTITION BY contig ORDER BY pos, read_id))"""

SQL = {
    "revcomp_reads": _R + """ SELECT rid, reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) AS revcomp, reverse(translate(seq, 'ACGT', 'TGCA')) AS upper,
        CASE WHEN length(rid) % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) END AS oriented FROM r""",
    "gc_by_read": _R + """, c AS (SELECT rid, length(seq) AS n, length(seq) - length(replace(seq, 'A', '')) AS n_a, length(seq) - length(replace(seq, 'C', '')) AS n_c, length(seq) - length(replace(seq, 'G', '')) AS n_g, length(seq) - length(replace(seq, 'T', '')) AS n_t FROM r)
        SELECT rid, n_c + n_g AS gc, round((n_c + n_g) / n, 9) AS share, n_a, n_c, n_g, n_t FROM c""",
    "scalar_functions": _E + """ SELECT paf_line, source, target, left_id AS id, CAST(left_orientation AS INT) AS orientation, CASE WHEN right_orientation = 1 THEN '+' ELSE '-' END AS sign, '\\"' || replace(replace(target, '\\', '\\\\'), '"', '\\"') AS dot,
        substr(target, least(2, length(target)) + 1, greatest(0, least(overlap_len, length(target)) - 2)) AS slice, left_id || substr(right_id, 3) AS merged,
        CAST(greatest(1, ceil(log2(greatest(2, overlap_len)))) AS BIGINT) AS bits, matches - 49 * mismatches AS margin, matches + mismatches + 2 AS cigar_target, matches + mismatches + 3 AS cigar_query,
        round(CASE WHEN block > 0 THEN matches / block ELSE 0 END, 9) AS identity, round(CASE WHEN block > 0 THEN mismatches / block ELSE 1 END, 9) AS error_rate, left_id || substr(right_id, 2) || substr(source, 3) AS path FROM e""",
    "edge_dedup": _E + " SELECT source, target, paf_line, weight_dp, dp_score FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY coalesce(weight_dp, dp_score) DESC NULLS LAST, paf_line) AS k FROM e) WHERE k = 1",
    "edge_rewards": _E + ", b AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, left_id, right_id, max(CAST({x} AS DOUBLE)) AS v FROM e WHERE CAST({x} AS DOUBLE) >= 0 GROUP BY left_id, right_id" for m, x in _REWARD.items())
        + ") SELECT mode, left_id, right_id, round(CASE WHEN max(v) OVER (PARTITION BY mode) > 0 THEN v / max(v) OVER (PARTITION BY mode) ELSE 0 END, 9) AS reward FROM b",
    "mutual_information_rewards": _COLUMNS + " SELECT left_id, right_id, round(len * nmi, 6) AS mi, round(mi, 6) AS raw_mi, round(nmi, 6) AS nmi, round(len * nmi, 6) AS weighted_nmi FROM mi",
    "extension_costs": _RE + " SELECT left_id, right_id, min(greatest(0, length(seq) - overlap_len)) AS cost FROM e JOIN r ON rid = right_id GROUP BY left_id, right_id",
    "topk_edges": _E + """, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY identity * 1000 + overlap_len DESC, source, target, paf_line) AS k FROM e) WHERE k <= 3)
        SELECT source, target, paf_line FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY identity * 1000 + overlap_len DESC, source, target, paf_line) AS k2 FROM a) WHERE k2 <= 3""",
    "mi_scores": _COLUMNS + " SELECT left_id, right_id, columns, round(mi, 6) AS mi, round(nmi, 6) AS nmi, round(1 - nmi, 6) AS mi_distance, round(h_left, 6) AS h_left, round(h_right, 6) AS h_right FROM mi",
    "top_mi_edges": _COLUMNS + " SELECT left_id, right_id, round(mi, 6) AS mi FROM mi ORDER BY round(mi, 6) DESC, left_id, right_id LIMIT 10",
    "overlap_gc": _PAF_BASE + """,
        s AS (SELECT line_no, substr(a.seq, least(left_start_hint, length(a.seq)) + 1, least(left_end_hint, length(a.seq)) - least(left_start_hint, length(a.seq))) AS x, substr(b.seq, 1, least(right_end_hint, length(b.seq))) AS y FROM cand JOIN r a ON a.rid = left_id JOIN r b ON b.rid = right_id),
        g AS (SELECT line_no, length(x) AS nx, length(y) AS ny, length(x) - length(translate(x, 'GC', '')) AS gx, length(y) - length(translate(y, 'GC', '')) AS gy FROM s),
        m AS (SELECT line_no, 'average' AS method, (nx + ny) / 2 AS n, (gx + gy) / 2 AS g FROM g UNION ALL SELECT line_no, 'left', nx, gx FROM g UNION ALL SELECT line_no, 'right', ny, gy FROM g)
        SELECT line_no, method, round(CAST(n AS DOUBLE), 6) AS gc_length, round(CAST(g AS DOUBLE), 6) AS gc, round(g / n, 9) AS gc_share, 'coordinates' AS gc_source FROM m""",
    "truth_rank": _R + _RANKS + " SELECT rid, rank FROM k",
    "true_adjacent": _R + _RANKS + " SELECT left_id, right_id FROM adj",
    "edge_labels": _RE + _RANKS + " " + _LABEL.replace("{0}", "source, target, paf_line").replace("{1}", "e"),
    "edge_eval_report": _RE + _RANKS + ", l AS (" + _LABEL.replace("{0}", "left_id, right_id, block - overlap_len AS shift").replace("{1}", "e") + """)
        SELECT count(*) AS total_edges, count(*) FILTER (label = 'adjacent_correct') AS adjacent_correct, count(*) FILTER (label = 'jump_correct') AS jump_correct, count(*) FILTER (label = 'wrong_edge') AS wrong_edges,
        (SELECT count(*) FROM adj ANTI JOIN (SELECT left_id, right_id FROM e) USING (left_id, right_id)) AS missing_adjacent_edges, round(count(*) FILTER (label <> 'wrong_edge') / count(*), 9) AS edge_precision,
        round(count(*) FILTER (label = 'adjacent_correct') / (SELECT count(*) FROM adj), 9) AS adjacent_recall, round(avg(abs(shift - true_shift)) FILTER (label <> 'wrong_edge'), 9) AS mean_shift_error,
        round(median(abs(shift - true_shift)) FILTER (label <> 'wrong_edge'), 9) AS median_shift_error, max(abs(shift - true_shift)) FILTER (label <> 'wrong_edge') AS max_shift_error FROM l""",
    "candidate_eval_report": _PAF_BASE + _RANKS + ", l AS (" + _LABEL.replace("{0}", "rough_shift AS shift").replace("{1}", "cand") + """)
        SELECT count(*) AS total_edges, count(*) FILTER (label = 'adjacent_correct') AS adjacent_correct, count(*) FILTER (label = 'jump_correct') AS jump_correct, count(*) FILTER (label = 'wrong_edge') AS wrong_edges,
        round(avg(abs(shift - true_shift)) FILTER (label <> 'wrong_edge'), 6) AS mean_shift_error FROM l""",
    "refinement_report": _RE + """, j AS (SELECT e.*, abs(overlap_len - greatest(0, least(a.true_end, b.true_end) - greatest(a.true_start, b.true_start))) AS err FROM e JOIN r a ON a.rid = left_id JOIN r b ON b.rid = right_id)
        SELECT count(*) AS total_edges, round(avg(error_rate), 9) AS mean_error_rate, round(median(error_rate), 9) AS median_error_rate, round(max(error_rate), 9) AS max_error_rate, round(avg(identity), 9) AS mean_identity,
        round(avg(err), 9) AS mean_overlap_error, round(median(err), 9) AS median_overlap_error, max(err) AS max_overlap_error, CAST(sum(mismatches) AS BIGINT) AS total_mismatches, CAST(0 AS BIGINT) AS total_insertions,
        CAST(0 AS BIGINT) AS total_deletions, CAST(sum(mismatches) AS BIGINT) AS total_edit_distance, CAST(sum(overlap_len) AS BIGINT) AS total_alignment_length, CAST(0 AS BIGINT) AS total_gaps,
        round(sum(mismatches) / sum(overlap_len), 9) AS aggregate_error_rate FROM j""",
    "score_by_truth": _RE + _RANKS + """ SELECT CASE WHEN b.rank - a.rank = 1 THEN 'adjacent' WHEN b.rank > a.rank THEN 'jump' ELSE 'wrong' END AS truth, count(*) AS edges, round(avg(weight_dp), 6) AS mean_weight
        FROM e JOIN k a ON a.rid = left_id JOIN k b ON b.rid = right_id GROUP BY 1""",
    "recoverability_classes": _RE + _RANKS + """ SELECT CASE WHEN a.rank >= b.rank THEN 'backward' WHEN a.true_end < b.true_start THEN 'gap' ELSE 'contiguous' END AS direction, count(*) AS edges
        FROM e JOIN k a ON a.rid = left_id JOIN k b ON b.rid = right_id GROUP BY 1""",
    "layout_eval": _R + _RANKS + """, p AS (SELECT rid, rank, row_number() OVER (ORDER BY rid) - 1 AS position FROM k)
        SELECT (SELECT count(*) FROM p) AS order_length, (SELECT count(*) FROM p a JOIN p b ON b.position = a.position + 1 WHERE b.rank = a.rank + 1) AS adjacent_correct,
        (SELECT count(*) FROM p a JOIN p b ON b.position = a.position + 1 WHERE b.rank <> a.rank + 1) AS wrong_adjacencies, (SELECT count(*) FROM p a JOIN p b ON a.position < b.position AND a.rank > b.rank) AS inversions""",
    "best_placements": "WITH " + _PLACED + " SELECT read_id, contig, orientation, reference_start, reference_end, identity, mapq FROM bp",
    "cyclic_successors": _CIRCLE + " SELECT contig, read_id, nxt AS successor FROM ps",
    "circular_order_eval": _CIRCLE + """, f AS (SELECT ns.contig, count(*) AS items, count(*) FILTER (a.nxt = ns.nxt) AS f, count(*) FILTER (b.read_id = ns.nxt) AS b FROM ns LEFT JOIN ps a ON a.contig = ns.contig AND a.read_id = ns.read_id LEFT JOIN ps b ON b.contig = ns.contig AND b.nxt = ns.read_id GROUP BY ns.contig),
        t AS (SELECT contig, count(*) AS n FROM ps GROUP BY contig)
        SELECT f.contig, items, round(f / items, 9) AS forward_accuracy, round(b / items, 9) AS backward_accuracy, coalesce(items = n AND f = items, FALSE) AS exact_forward, coalesce(items = n AND b = items, FALSE) AS exact_backward FROM f LEFT JOIN t USING (contig)""",
    "circular_neighbours": _CIRCLE + " SELECT a.contig, a.read_id, p.read_id AS predecessor, a.nxt AS successor, ((n.pos - a.pos) % length + length) % length AS step FROM ps a JOIN ps p ON p.contig = a.contig AND p.nxt = a.read_id JOIN ps n ON n.contig = a.contig AND n.read_id = a.nxt JOIN contigs c ON c.contig = a.contig",
    "selected_span": """SELECT contig, min(start) AS first_start, max("end") AS last_end, count(DISTINCT node) AS nodes FROM nodes WHERE contig IS NOT NULL AND start >= 0 AND start < "end" GROUP BY contig""",
}
from .coverage import SQL as _COVERAGE_SQL  # noqa: E402

SQL["interval_union_cover"] = _COVERAGE_SQL["p4_coverage_report"].split("SELECT layer, contig, count(*) FILTER")[0] + " SELECT contig, CAST(sum(pos_end - pos_start) AS BIGINT) AS covered FROM found SEMI JOIN c USING (contig) WHERE layer = 'placements' AND kind = 'covered' GROUP BY contig"
SQL["method_comparison"] = (
    "WITH x AS (" + _OVERLAP_SQL["exact_overlap_best"].replace("60", "100").rsplit(" SELECT src, dst, overlap FROM (", 1)[0] + " SELECT src AS left_id, dst AS right_id FROM o), y AS (" + _OVERLAP_SQL["ungapped_best"]
    + ") SELECT CASE WHEN x.left_id IS NULL THEN 'only_right' WHEN y.left_id IS NULL THEN 'only_left' ELSE 'common' END AS kind, count(*) AS n FROM x FULL OUTER JOIN y ON x.left_id = y.left_id AND x.right_id = y.right_id GROUP BY 1"
)
SQL["likelihood_weights"] = "WITH " + inputs.EDGES + """, u AS (SELECT matches AS length, mismatches AS distance, count(*) AS edges FROM e GROUP BY ALL), i AS (SELECT length, distance, edges, unnest(range(distance + 1)) AS i FROM u),
    k AS (SELECT length, distance, edges, i, unnest(range(least(i, length + i) + 1)) AS k FROM i),
    b AS (SELECT length, distance, edges, i, max(v) + ln(sum(exp(v - m))) AS b FROM (SELECT *, max(v) OVER (PARTITION BY length, distance, i) AS m FROM (SELECT *, lgamma(length + i + 1) - lgamma(k + 1) - lgamma(length + i - k + 1) + k * ln(3) AS v FROM k)) GROUP BY length, distance, edges, i),
    p AS (SELECT x.length, x.distance, x.edges, x.b + y.b AS v FROM b x JOIN b y ON y.length = x.length AND y.distance = x.distance AND y.i = x.distance - x.i),
    t AS (SELECT length, distance, edges, max(m) + ln(sum(exp(v - m))) - ln(distance + 1) AS t FROM (SELECT *, max(v) OVER (PARTITION BY length, distance) AS m FROM p) GROUP BY length, distance, edges)
    SELECT length, distance, edges, round(length + distance - t / ln(4), 6) AS weight FROM t"""
