"""Queries of simulation, compression and solving of whole graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compress as K
from ..operators import evaluate as E
from ..operators import layout as L
from ..operators import scoring as C
from ..session import new_path, table
from ..sources import simulate as M
from . import inputs
from .graph_plans import SQL as _GRAPH_SQL
from .graph_plans import _best, _regions
from .qubo_plans import _graph, _numbered

_FIXED = M.SimulationConfig()


def _genomes(spark, sf_dir):
    return table(spark, sf_dir, "contigs").select(F.col("contig").alias("genome_id"), "length", F.xxhash64("contig").alias("seed"))


def simulated_layout(spark, sf_dir):
    return M.fixed_layout(_genomes(spark, sf_dir), _FIXED)


def simulated_reads(spark, sf_dir):
    """Noisy reads of a random genome for every contig: coordinates of each, and whether its bases' places rise within them and its length fits its inserted and placed bases."""
    r = M.simulate_reads(_genomes(spark, sf_dir), _FIXED)
    placed = F.filter("ref_coords", lambda x: x >= 0)
    rising = F.aggregate(placed, F.struct(F.col("true_start") - 1, F.lit(True)), lambda a, x: F.struct(x.alias("col1"), (a["col2"] & (x > a["col1"])).alias("col2")))["col2"]
    sound = rising & (F.size("ref_coords") == F.length("seq")) & (F.coalesce(F.array_max(placed), F.col("true_start")) < F.col("true_end"))
    return r.select("rid", "true_start", "true_end", sound.alias("sound"))


def simulated_random_reads(spark, sf_dir):
    """Reads of random length and overlap without errors: per contig of at least one read, whether lengths and overlaps keep to the limits and equal places have equal bases."""
    c = M.SimulationConfig(length_range=(300, 500), overlap_range=(0.2, 0.6), least_overlap=60, mismatch_rate=0.0, insertion_rate=0.0, deletion_rate=0.0)
    r = M.simulate_reads(_genomes(spark, sf_dir), c)
    order = Window.partitionBy("genome_id").orderBy("true_start")  # one genome
    r = r.select("genome_id", "true_start", "true_end", "seq", F.lag("true_end").over(order).alias("before"), F.lag("seq").over(order).alias("left"))
    over = F.col("before") - F.col("true_start")
    size = F.col("true_end") - F.col("true_start")
    joined = F.right("left", over.cast("int")) == F.left("seq", over.cast("int"))
    ok = size.between(300, 500) & (size == F.length("seq")) & (F.col("before").isNull() & (F.col("true_start") == 0) | F.coalesce((over >= 60) & joined, F.lit(False)))
    found = r.groupBy("genome_id").agg(F.bool_and(ok).alias("sound"))
    return _genomes(spark, sf_dir).select("genome_id").join(found, "genome_id", "left").select("genome_id", F.coalesce("sound", F.lit(True)).alias("sound"))


def _graph_tables(spark, sf_dir):
    e = inputs.edges(spark, sf_dir).select("source", "target", "overlap_len", "identity", (F.col("block") - F.col("overlap_len") > 4).alias("internal"), "paf_line")
    r = inputs.reads(spark, sf_dir).select("rid", "seq")
    n = e.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(r, F.regexp_replace("node", "[+-]$", "") == F.col("rid"))
    plus = F.endswith("node", F.lit("+"))
    from ..functions.seq import revcomp

    n = n.select("node", F.when(plus, F.col("seq")).otherwise(revcomp("seq")).alias("seq"), F.lit(1.0).alias("coverage"), F.array("node").alias("members"))
    return n, e.join(n.select(F.col("node").alias("source")), "source", "left_semi").join(n.select(F.col("node").alias("target")), "target", "left_semi")


def compression_stages(spark, sf_dir):
    """Nodes and edges after every stage of the compressor."""
    n, e = _graph_tables(spark, sf_dir)
    counts = K.compress(n, e, K.CompressConfig(min_overlap=60, min_identity=0.97, top_k=3, shift_tolerance=10, tip_length=300, repeat_degree=6))[2]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(counts)], "ord int, stage string, nodes bigint, edges bigint")


def merged_duplicates(spark, sf_dir):
    n, e = _graph_tables(spark, sf_dir)
    m, d = K.merge_duplicates(n, e)
    return m.select("node", F.size("members").cast("bigint").alias("members"), "coverage")


def region_scores(spark, sf_dir):
    s = K.region_scores(_best(spark, sf_dir), _regions(spark, sf_dir))
    return s.select("region", "n", "e", "a", "b", "edge_reduction", "gain", "benefit", F.round("score", 9).alias("score"))


def hierarchy_solutions(spark, sf_dir):
    """Heaviest path through all reads of every contig, cycles included: whether the path told is one, of that weight, and none is told otherwise."""
    nodes, edges = _graph(spark, sf_dir, False)

    def run(n, arcs):
        w = {}
        for u, v, x in arcs:
            w[u, v] = max(x, w.get((u, v), x))
        status, path, total = K.solve_hierarchy(n, arcs)
        steps = list(zip(path, path[1:]))
        fits = sorted(path) == list(range(n)) and all(a in w for a in steps) and abs(sum(w[a] for a in steps) - total) < 1e-9
        return n, fits if status.startswith("FEASIBLE") else not path

    return L.by_model(L.packed_graphs(nodes, edges), run, "reads bigint, sound boolean")


def two_terminal_counts(spark, sf_dir):
    """Regions with one edge in and one out, per contig graph, and the blocks of up to eight nodes they are packed into."""

    def run(n, arcs):
        pairs = [a[:2] for a in arcs]
        regions, largest = K.two_terminal_sizes(n, pairs)
        blocks = K.two_terminal_partition(n, pairs, 8)
        leaves, depth = K.block_summary(n, blocks)
        return regions, largest, len(blocks), len(leaves), depth

    return L.by_model(L.packed_graphs(*_graph(spark, sf_dir)), run, "regions bigint, largest bigint, blocks bigint, leaves bigint, depth bigint")


def unsupported_audit(spark, sf_dir):
    """Reads with few neighbours and where they are placed."""
    from .graph_plans import low_support

    p = E.best_placements(table(spark, sf_dir, "placements")).select(F.col("read_id").alias("rid"), "contig", "reference_start", "reference_end")
    return low_support(spark, sf_dir).join(p, "rid", "left").select("rid", "reason", "contig", "reference_start", "reference_end")


def circle_checks(spark, sf_dir):
    """Every circular contig's reads as a cycle by start: nodes, the sum of the shifts from each to the next, and how far it is from whole laps of the contig."""
    c = table(spark, sf_dir, "contigs").where("topology = 'circular' and length > 0").select("contig", "length")
    n = table(spark, sf_dir, "nodes").where("node is not null and start >= 0").select("contig", "node", "start").join(c, "contig").groupBy("contig", "length", "node").agg(F.min(F.col("start") % F.col("length")).alias("start"))
    return E.cycle_laps(n)


def orientation_agreement(spark, sf_dir):
    """Per contig: nodes with a placement, and the share whose sign agrees with it, as it is or turned, whichever is more."""
    p = E.best_placements(table(spark, sf_dir, "placements")).select("read_id", F.col("orientation").alias("placed"))
    n = table(spark, sf_dir, "nodes").where("contig is not null and read_id is not null and selected_sign in ('+', '-')").groupBy("contig", "read_id").agg(F.max("selected_sign").alias("sign"))
    same = (F.col("sign") == "+") == (F.col("placed") == 1)
    g = n.join(p, "read_id").where("placed is not null").groupBy("contig").agg(F.count(F.lit(1)).alias("reads"), F.avg(same.cast("int")).alias("s"))
    return g.select("contig", "reads", F.round(F.greatest("s", 1 - F.col("s")), 9).alias("agreement"))


def audit_tables(spark, sf_dir):
    """The audit written as tab-separated tables and read back: rows of each."""
    from .detail_plans import missing_side_causes
    from .paf_plans import CONFIG, _records

    from ..operators import paf as P

    reads, e = inputs.reads(spark, sf_dir), inputs.edges(spark, sf_dir)
    placed = E.best_placements(table(spark, sf_dir, "placements"))
    audit = P.pair_audit(_records(spark, sf_dir), CONFIG)
    low = unsupported_audit(spark, sf_dir)
    unmapped = low.where("contig is null").select("rid", "reason")
    pairs = audit.select(F.explode(F.array("first_id", "second_id")).alias("rid"), "status").groupBy("rid").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("status") == "passes").alias("passing"))
    near = e.select(F.explode(F.array(F.struct(F.col("left_id").alias("rid"), F.col("right_id").alias("other")), F.struct(F.col("right_id").alias("rid"), F.col("left_id").alias("other")))).alias("x")).select("x.*").distinct()
    tables = {
        "placements": placed.join(reads.select(F.col("rid").alias("read_id")), "read_id", "left_semi"), "unsupported_reads": low, "neighbours": near.join(low.select("rid"), "rid", "left_semi"),
        "missing_sides": missing_side_causes(spark, sf_dir), "unmapped": unmapped.join(pairs, "rid", "left"),
    }
    path, out = new_path(spark, "audit"), None
    for name, d in tables.items():
        d.write.mode("overwrite").csv(f"{path}/{name}", sep="\t", header=True)
        n = spark.read.csv(f"{path}/{name}", sep="\t", header=True, schema=d.schema).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


def placement_coverage_bias(spark, sf_dir):
    """Per contig: placed reads by orientation and their mean identity."""
    p = E.best_placements(table(spark, sf_dir, "placements"))
    return p.groupBy("contig").agg(F.count_if(F.col("orientation") == 1).alias("forward"), F.count_if(F.col("orientation") == -1).alias("reverse"), F.round(F.avg("identity"), 9).alias("identity"))


_FUNCTIONS = (simulated_layout, simulated_reads, simulated_random_reads, compression_stages, merged_duplicates, region_scores, hierarchy_solutions, two_terminal_counts, circle_checks, orientation_agreement, audit_tables, unsupported_audit, placement_coverage_bias)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_LOW = _GRAPH_SQL["low_support"]
_PLACED = """bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY reference_end - reference_start DESC, coalesce(identity, -1) DESC, coalesce(mapq, -1) DESC, contig DESC, reference_start) AS k
           FROM placements WHERE read_id IS NOT NULL AND contig IS NOT NULL AND reference_start >= 0 AND reference_start < reference_end) WHERE k = 1)"""
from .detail_plans import SQL as _DETAIL_SQL  # noqa: E402

_SIDES = _DETAIL_SQL["missing_side_causes"]
_LAID = "SELECT contig || '_read_' || i AS rid, CAST(i * 200 AS BIGINT) AS true_start, CAST(i * 200 + 400 AS BIGINT) AS true_end, true AS sound FROM (SELECT contig, unnest(range((length - 400) // 200 + 1)) AS i FROM contigs WHERE length >= 400)"
SQL = {
    "simulated_reads": _LAID,
    "simulated_random_reads": "SELECT contig AS genome_id, true AS sound FROM contigs",
    "hierarchy_solutions": _numbered(False) + " SELECT DISTINCT model, n AS reads, true AS sound FROM nd",
    "audit_tables": "WITH RECURSIVE ls AS (" + _LOW.replace("WITH RECURSIVE", "WITH", 1) + "), ms AS (" + _SIDES + "), " + _PLACED + ", " + inputs.READS + "," + inputs.EDGES + """
        SELECT 'placements' AS "table", count(*) AS rows FROM bp WHERE read_id IN (SELECT rid FROM r) UNION ALL SELECT 'unsupported_reads', count(*) FROM ls
        UNION ALL SELECT 'neighbours', count(*) FROM (SELECT left_id AS rid, right_id AS o FROM e UNION SELECT right_id, left_id FROM e) WHERE rid IN (SELECT rid FROM ls)
        UNION ALL SELECT 'missing_sides', count(*) FROM ms UNION ALL SELECT 'unmapped', count(*) FROM ls WHERE rid NOT IN (SELECT read_id FROM bp)""",
    "circle_checks": """WITH n AS (SELECT c.contig, c.length, node, min(start % c.length) AS s FROM nodes n JOIN contigs c ON c.contig = n.contig WHERE topology = 'circular' AND c.length > 0 AND node IS NOT NULL AND start >= 0 GROUP BY ALL)
        SELECT contig, count(*) AS nodes, CAST(CASE WHEN count(*) > 1 THEN max(length) ELSE 0 END AS BIGINT) AS shift, CAST(CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS BIGINT) AS laps, CAST(0 AS BIGINT) AS beyond FROM n GROUP BY contig""",
    "orientation_agreement": "WITH " + _PLACED + """, n AS (SELECT contig, read_id, max(selected_sign) AS sign FROM nodes WHERE contig IS NOT NULL AND read_id IS NOT NULL AND selected_sign IN ('+', '-') GROUP BY ALL),
        g AS (SELECT n.contig, count(*) AS reads, avg(CASE WHEN (sign = '+') = (orientation = 1) THEN 1 ELSE 0 END) AS s FROM n JOIN bp USING (read_id) WHERE orientation IS NOT NULL GROUP BY n.contig) SELECT contig, reads, round(greatest(s, 1 - s), 9) AS agreement FROM g""",
    "simulated_layout": "SELECT contig AS genome_id, contig || '_read_' || i AS rid, CAST(i * 200 AS BIGINT) AS true_start, CAST(i * 200 + 400 AS BIGINT) AS true_end FROM (SELECT contig, unnest(range((length - 400) // 200 + 1)) AS i FROM contigs WHERE length >= 400)",
    "merged_duplicates": "WITH " + inputs.READS + "," + inputs.EDGES + """, nd AS (SELECT source AS node FROM e UNION SELECT target FROM e), s AS (SELECT node, CASE WHEN node[-1] = '+' THEN seq ELSE reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) END AS seq FROM nd JOIN r ON rid = node[:-2])
        SELECT min(node) AS node, count(*) AS members, CAST(count(*) AS DOUBLE) AS coverage FROM s GROUP BY seq""",
    "region_scores": _GRAPH_SQL["boundary_edges"].rsplit(" SELECT region, source, target, kind FROM bk", 1)[0] + """, c AS (SELECT region, count(*) FILTER (kind = 'internal') AS e, count(*) FILTER (kind = 'incoming') AS a, count(*) FILTER (kind = 'outgoing') AS b FROM bk GROUP BY region),
        q AS (SELECT s.region, s.n, coalesce(e, 0) AS e, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT region, count(*) AS n FROM m GROUP BY region) s LEFT JOIN c USING (region)), v AS (SELECT *, e + a + b - a * b AS edge_reduction, e - a * b AS gain FROM q)
        SELECT *, CAST(n + edge_reduction + gain AS DOUBLE) AS benefit, round(greatest(1e-9, n + edge_reduction + gain) / (greatest(1, a * b) * greatest(1, n + e)), 9) AS score FROM v""",
    "unsupported_audit": "WITH ls AS (" + _LOW + "), " + _PLACED + " SELECT rid, reason, contig, reference_start, reference_end FROM ls LEFT JOIN bp ON read_id = rid",
    "placement_coverage_bias": "WITH " + _PLACED + " SELECT contig, count(*) FILTER (orientation = 1) AS forward, count(*) FILTER (orientation = -1) AS reverse, round(avg(identity), 9) AS identity FROM bp GROUP BY contig",
}
