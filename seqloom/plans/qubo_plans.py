"""Queries over layout models: one model per contig."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.seq import gc_count
from ..operators import layout as L
from ..operators import qubo as Q
from ..operators import solve as V
from ..session import materialize, table
from . import inputs

#: Settings of the assembly model.
LENGTH_TARGET, GC_TARGET = 5000.0, 0.5


def _graph(spark, sf_dir, acyclic=True):
    """Numbered reads and edges of every contig; acyclic ones lead to a later start."""
    n = table(spark, sf_dir, "nodes").where("contig is not null and node is not null and start >= 0").groupBy("contig", "node").agg(F.min("start").alias("start"))
    e = inputs.edges(spark, sf_dir).groupBy("source", "target").agg(F.max("overlap_len").alias("overlap_len"), F.max("identity").alias("identity"))
    s, t = n.select(F.col("contig").alias("model"), F.col("node").alias("source"), F.col("start").alias("a")), n.select(F.col("contig").alias("model"), F.col("node").alias("target"), F.col("start").alias("b"))
    e = e.join(s, "source").join(t, ["model", "target"]).where("source <> target")
    if acyclic:
        e = e.where("a < b")
    nodes = e.select("model", F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("a").alias("pos")), F.struct(F.col("target").alias("node"), F.col("b").alias("pos")))).alias("x")).select("model", "x.node", "x.pos").distinct()
    pairs = e.select("model", F.col("source").alias("left"), F.col("target").alias("right"), "overlap_len", "identity", (F.col("overlap_len") / 1000.0).alias("reward"))
    return tuple(materialize(d, "graph")[0] for d in Q.number_graph(nodes, pairs))  # every term of a model reads them


def _out(terms):
    return terms.select("model", "i", "j", F.round("coeff", 6).alias("coeff"))


def qubo_missing_edge(spark, sf_dir):
    return Q.missing_edge_model(*_graph(spark, sf_dir, False)).terms().select("model", "i", "j", "coeff")  # whole numbers


def qubo_weighted_overlap(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir, False)
    edges = edges.withColumn("reward", F.round("reward", 6))  # each is a term of its own, so they are rounded once and not in every place
    return Q.weighted_overlap_model(nodes, edges).terms().select("model", "i", "j", "coeff")


def qubo_edge_path(spark, sf_dir):
    return _out(Q.edge_path_model(*_graph(spark, sf_dir)).terms())


def qubo_path_cover(spark, sf_dir):
    return _out(Q.path_cover_model(*_graph(spark, sf_dir)).terms())


def qubo_cycle_cover(spark, sf_dir):
    return _out(Q.cycle_cover_model(*_graph(spark, sf_dir), selection_penalty=0.25).terms())


def _costs(spark, sf_dir):
    """Extension costs over the longest read of each contig."""
    nodes, edges = _graph(spark, sf_dir, False)
    ln = inputs.reads(spark, sf_dir).select("rid", F.length("seq").cast("double").alias("len"))
    nd = nodes.join(ln, F.regexp_replace("node", "[+-]$", "") == F.col("rid"), "left").withColumn("len", F.coalesce("len", F.lit(0.0)))
    nd = nd.withColumn("top", F.greatest(F.lit(1.0), F.max("len").over(Window.partitionBy("model")))).withColumn("source_cost", F.col("len") / F.col("top"))
    ed = edges.join(nd.select("model", F.col("idx").alias("ri"), "len", "top"), ["model", "ri"]).withColumn("cost", F.greatest(F.lit(0.0), F.col("len") - F.col("overlap_len")) / F.col("top"))
    return tuple(materialize(d, "costs")[0] for d in (nd, ed))


def qubo_ordered_path(spark, sf_dir):
    return _out(Q.ordered_path_model(*_costs(spark, sf_dir)).terms())


def qubo_ordered_circle(spark, sf_dir):
    """Edges of which the later ones of a read stand for two, and every seventh is one of three alternatives."""
    nodes, edges = _graph(spark, sf_dir, False)
    child = F.when(F.col("var") % 7 == 0, F.col("var") % 3)
    return _out(Q.ordered_circle_model(nodes, edges.withColumns({"size": F.when(F.col("ri") > F.col("li"), 2).otherwise(1), "child": child})).terms())


def qubo_pdf_assembly(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    r = inputs.reads(spark, sf_dir).select("rid", F.length("seq").cast("double").alias("length"), gc_count("seq").cast("double").alias("gc"))
    nd = nodes.join(r, F.regexp_replace("node", "[+-]$", "") == F.col("rid"), "left").na.fill(0.0, ["length", "gc"])
    ed = edges.withColumns({"overlap_gc": F.col("overlap_len") * 0.5, "mi": F.col("identity") * F.col("overlap_len") / 100})
    return _out(Q.assembly_model(nd, ed, 100.0, LENGTH_TARGET, 0.01, GC_TARGET, 0.02, 0.5).terms())


def qubo_ising_chain(spark, sf_dir):
    n = table(spark, sf_dir, "contigs").select(F.col("contig").alias("model"), (F.col("length") % 9 + 2).alias("n"))
    return _out(Q.ising_chain(n).terms())


def _bits(spark, sf_dir):
    t, _ = materialize(Q.edge_path_model(*_graph(spark, sf_dir)).terms(), "terms")
    v = t.where("i = j and i >= 0").select("model", F.col("i").alias("var"), F.when(F.col("i") % 3 == 0, 1).otherwise(0).alias("bit"))
    return t, v


def qubo_energy(spark, sf_dir):
    """Energy of two fixed samples of every edge-path model."""
    t, _ = materialize(Q.edge_path_model(*_graph(spark, sf_dir)).terms(), "terms")
    v = t.where("i = j and i >= 0")
    s = v.where("i % 3 = 0").select("model", F.lit("third").alias("sample"), F.col("i").alias("var")).unionByName(v.where("i % 2 = 0").select("model", F.lit("half").alias("sample"), F.col("i").alias("var")))
    return Q.energies(t, s).select("model", "sample", F.round("energy", 6).alias("energy"))


def qubo_fix_vars(spark, sf_dir):
    t, v = _bits(spark, sf_dir)
    return _out(Q.fix_variables(t, v.where("var % 5 = 0").select("model", "var", F.col("bit"))))


def flip_deltas(spark, sf_dir):
    t, v = _bits(spark, sf_dir)
    return Q.flip_deltas(t, v).select("model", "var", F.round("delta", 6).alias("delta"))


def qubo_exhaustive_min(spark, sf_dir):
    """Least energy of every edge-path model of at most ten edges, by all states."""
    m = Q.exhaustive_minimum(Q.edge_path_model(*_graph(spark, sf_dir)).terms(), 10)
    return m.select("model", F.round("energy", 6).alias("energy"))


def layout_samples(spark, sf_dir):
    """Edge variables of the path by start, with the pairs that the graph lacks."""
    nodes, edges = _graph(spark, sf_dir)
    return Q.sample_for_order(nodes.select("model", "node", F.col("idx").alias("position")), edges)


def degree_conflicts(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return Q.degree_conflicts(edges.where("var % 3 = 0").select("model", "left", "right"), nodes).select("model", "reads", "edges", "entered_twice", "left_twice", "starts", "ends", "valid_degrees")


def position_violations(spark, sf_dir):
    """Violations of the sample that puts read i at position i*i mod n."""
    nodes, _ = _graph(spark, sf_dir)
    s = nodes.select("model", (F.col("idx") * F.col("n") + F.col("idx") * F.col("idx") % F.col("n")).alias("var"))
    return Q.position_violations(s, nodes)


def _checked(terms, samples):
    """Samples with their energy by the terms, and whether no single flip lowers it."""
    terms, _ = materialize(terms, "terms")
    s, _ = materialize(samples, "samples")
    key = F.concat_ws(":", "method", F.col("seed").cast("string")).alias("sample")
    on = s.select("model", key, F.explode_outer("ones").alias("var"))
    e = Q.energies(terms, on).withColumnRenamed("energy", "by_terms")
    each = s.select("model", key, "ones", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("variables") - 1)).alias("var"))
    bits = each.select(F.struct("model", "sample").alias("model"), "var", F.array_contains("ones", F.col("var")).cast("int").alias("bit"))
    keyed = s.select("model", key).join(terms, "model").select(F.struct("model", "sample").alias("model"), "i", "j", "coeff")
    low = Q.flip_deltas(keyed, bits).groupBy("model").agg(F.min("delta").alias("d")).select("model.*", "d")
    j = s.withColumn("sample", F.concat_ws(":", "method", F.col("seed").cast("string"))).join(e, ["model", "sample"]).join(low, ["model", "sample"], "left")
    return j.withColumns({"energy_matches": F.abs(F.col("energy") - F.col("by_terms")) < 1e-6, "no_flip_lowers": F.coalesce(F.col("d"), F.lit(0.0)) > -1e-6})


def _edge_path_samples(spark, sf_dir):
    t, _ = materialize(Q.edge_path_model(*_graph(spark, sf_dir)).terms(), "terms")
    return t, V.sample_models(t, [(m, s) for m in ("annealing", "beta_ramp", "tabu") for s in (1, 2)])


def recurring_methods(spark, sf_dir):
    """Annealing, its linear ramp and tabu search with two seeds over every edge-path model: variables, whether the energy told is the model's of the sample, and whether a single flip lowers that of the annealers."""
    d = _checked(*_edge_path_samples(spark, sf_dir))
    return d.select("model", "method", "seed", "variables", "energy_matches", (F.col("no_flip_lowers") | (F.col("method") == "tabu")).alias("settled"))


def quantum_samples(spark, sf_dir):
    """The same of path-integral annealing."""
    t, _ = materialize(Q.edge_path_model(*_graph(spark, sf_dir)).terms(), "terms")
    d = _checked(t, V.sample_models(t, [("quantum", 1)], {"quantum": lambda m, s: V.quantum_anneal(m, s, 4, 40)}))
    return d.select("model", "seed", "variables", "energy_matches", F.col("no_flip_lowers").alias("settled"))


def sampler_summary(spark, sf_dir):
    """Per method: runs, those with the best energy any method found, and whether it found the least energy of all states for at least half of the models of at most ten variables."""
    t, d = _edge_path_samples(spark, sf_dir)
    least = Q.exhaustive_minimum(t, 10).select("model", F.col("energy").alias("least"))
    d = d.join(least, "model", "left")
    known = F.col("least").isNotNull()
    hit = F.abs(F.col("energy") - F.col("least")) < 1e-6
    return d.groupBy("method").agg(F.count(F.lit(1)).alias("runs"), F.count_if(known).alias("small_runs"), (2 * F.count_if(known & hit) >= F.count_if(known)).alias("reached"))


#: Penalties, sweeps and seeds of a sweep.
SWEEP = {"count_penalty": [40.0, 100.0], "degree_penalty": [60.0, 120.0], "sweeps": [20, 60], "seed": [0, 1, 2]}


def _cases(models):
    for name, values in SWEEP.items():
        models = models.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return models


def sweep_grid(spark, sf_dir):
    """Parameter grid of a sweep: penalties, sweeps and seeds for every model."""
    return _cases(_graph(spark, sf_dir)[0].select("model").distinct())


def sweep_summary(spark, sf_dir):
    """The sweep run: per penalties and sweeps, the runs, and whether any gave a path through all reads where one exists (``ground``) and every decoded sample named each read once."""
    nodes, edges = _graph(spark, sf_dir)
    g = _cases(L.packed_graphs(nodes, edges)).repartition(32, "model", "count_penalty", "degree_penalty", "sweeps", "seed")

    def run(n, arcs, count, degree, sweeps, seed):
        m = L.edge_path_model(n, arcs, float(count), float(degree))
        x, _ = V.anneal(m, int(seed), int(sweeps))
        out = L.decode("edge_path", n, [a[:2] for a in arcs], [int(v) for v in x.nonzero()[0]])
        return float(count), float(degree), int(sweeps), out.valid(n), V.best_dag_path(n, arcs) is not None, sorted(out.order) == list(range(n))

    d = L.by_model(g, run, "count_penalty double, degree_penalty double, sweeps bigint, valid boolean, exists boolean, whole boolean", "count_penalty", "degree_penalty", "sweeps", "seed")
    return d.groupBy("count_penalty", "degree_penalty", "sweeps").agg(F.count(F.lit(1)).alias("runs"), (F.count_if("valid") > 0).alias("ground"), F.bool_and(F.col("whole") & (F.col("exists") | ~F.col("valid"))).alias("sound"))


def _paths(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    n = nodes.groupBy("model").agg(F.max("n").alias("n"))
    return edges.groupBy("model").agg(F.collect_list(F.struct("li", "ri", "reward")).alias("arcs")).join(n, "model")


def longest_path_lexicographic(spark, sf_dir):
    """Most reads, then the highest reward, of a path through each contig's acyclic graph."""

    def run(parts):
        for p in parts:
            rows = []
            for r in p.itertuples():
                path, size, weight = V.longest_dag_path(int(r.n), [(int(a["li"]), int(a["ri"]), float(a["reward"])) for a in r.arcs])
                rows.append((r.model, size, round(weight, 6)))
            yield pd.DataFrame(rows, columns=["model", "nodes", "weight"])

    return _paths(spark, sf_dir).select("model", "n", "arcs").mapInPandas(run, "model string, nodes bigint, weight double")


def hamilton_path_dag(spark, sf_dir):
    """Whether a path through all reads of a contig exists, and its reward."""

    def run(parts):
        for p in parts:
            rows = []
            for r in p.itertuples():
                found = V.best_dag_path(int(r.n), [(int(a["li"]), int(a["ri"]), float(a["reward"])) for a in r.arcs])
                rows.append((r.model, found is not None, round(found[1], 6) if found else None))
            yield pd.DataFrame(rows, columns=["model", "feasible", "weight"])

    return _paths(spark, sf_dir).select("model", "n", "arcs").mapInPandas(run, "model string, feasible boolean, weight double")


def hamilton_check(spark, sf_dir):
    """Whether a cycle through all reads of a contig exists, edges taken in both directions of the stored graph."""
    nodes, edges = _graph(spark, sf_dir, False)
    n = nodes.groupBy("model").agg(F.max("n").alias("n"))
    d = edges.groupBy("model").agg(F.collect_list(F.struct("li", "ri")).alias("arcs")).join(n, "model").select("model", "n", "arcs")

    def run(parts):
        for p in parts:
            rows = [(r.model, int(r.n), V.hamilton_cycle(int(r.n), [(int(a["li"]), int(a["ri"])) for a in r.arcs])[0]) for r in p.itertuples()]
            yield pd.DataFrame(rows, columns=["model", "reads", "status"])

    return d.mapInPandas(run, "model string, reads bigint, status string")


def hamilton_paths(spark, sf_dir):
    """How many paths lead through all reads of each contig's acyclic graph, all of them searched for."""
    return L.by_model(L.packed_graphs(*_graph(spark, sf_dir)), lambda n, arcs: (sum(1 for _ in V.all_hamilton_paths(n, [a[:2] for a in arcs])),), "paths bigint")


def cycle_searches(spark, sf_dir):
    """The longest cycle and the heaviest cover by cycles of each contig's whole graph: whether they are cycles of the graph, and whether the cover names every read once and is no lighter than any cycle through all reads."""
    nodes, edges = _graph(spark, sf_dir, False)

    def run(n, arcs):
        w = {}
        for u, v, x in arcs:
            w[u, v] = max(x, w.get((u, v), x))
        path, total, complete = V.longest_cycle(n, arcs, 20_000)
        ring = list(zip(path, path[1:] + path[:1]))
        fine = len(set(path)) == len(path) and all(a in w for a in ring) and abs(sum(w[a] for a in ring) - total) < 1e-9
        cover = V.cycle_cover(n, w)
        whole = cover is None or sorted(cover[0]) == list(range(n)) and all((u, v) in w for u, v in enumerate(cover[0]))
        bound = len(path) < n or cover is not None and cover[1] >= total - 1e-9
        return n, fine, whole, bound

    return L.by_model(L.packed_graphs(nodes, edges), run, "reads bigint, cycle_fits boolean, cover_fits boolean, bounded boolean")


def polished_orders(spark, sf_dir):
    """Orders of the reads of each contig by id, improved by swaps and moves: missing neighbours before, and whether the polished order still names every read and misses no more."""
    nodes, edges = _graph(spark, sf_dir)
    start = nodes.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "idx"))), lambda x: x["idx"]).alias("start"))

    def run(n, arcs, start):
        have = {a[:2] for a in arcs}
        lacks = lambda o: sum(a not in have for a in zip(o, o[1:]))
        order = [int(x) for x in start]
        out, after = V.polish_arcs(order, have)
        return lacks(order), sorted(out) == sorted(order) and lacks(out) == after <= lacks(order)

    return L.by_model(L.packed_graphs(nodes, edges).join(start, "model"), run, "before bigint, sound boolean", "start")


def layout_round_trips(spark, sf_dir):
    """Per contig and kind of model: whether the order of the reads by place can be a sample, its set variables, and whether decoding gives the order back."""

    def run(n, arcs):
        pairs, rows = [a[:2] for a in arcs], []
        for kind in L.KINDS:
            try:
                ones = L.encode(kind, n, pairs, list(range(n)))
            except ValueError:
                rows.append((kind, False, None, None))
                continue
            out = L.decode(kind, n, pairs, ones)
            rows.append((kind, True, len(ones), out.order == list(range(n)) and out.valid(n)))
        return rows

    return L.by_model(L.packed_graphs(*_graph(spark, sf_dir)), run, "kind string, possible boolean, ones bigint, restored boolean")


def positions_decoded(spark, sf_dir):
    """The order that the sample with read i at position i*i mod n means: the first read of a position, gaps filled with the others in order."""

    def run(n, arcs):
        out = L.decode("positions", n, [], [i * n + i * i % n for i in range(n)])
        return [(p, r) for p, r in enumerate(out.order)]

    return L.by_model(L.packed_graphs(*_graph(spark, sf_dir)), run, "position bigint, read bigint")


def edge_path_statuses(spark, sf_dir):
    """Whether the edge-path model of each contig may be built."""
    return L.by_model(L.packed_graphs(*_graph(spark, sf_dir)), lambda n, arcs: (L.edge_path_status(n, [a[:2] for a in arcs]),), "status string")


def chains_decoded(spark, sf_dir):
    """What every third edge of each contig's model means as an edge path where no read has two of them on a side: its chains of one read or more, and the edges that lack or are too many."""
    nodes, edges = _graph(spark, sf_dir)

    def run(n, arcs):
        ones = [v for v in range(0, len(arcs), 3)]
        chosen = [arcs[v][:2] for v in ones]
        if len({u for u, _ in chosen}) < len(chosen) or len({v for _, v in chosen}) < len(chosen):
            return []
        out = L.decode("edge_path", n, [a[:2] for a in arcs], ones)
        return [(len(out.paths), out.violations)]

    return L.by_model(L.packed_graphs(nodes, edges), run, "paths bigint, violations bigint")


def layout_solutions(spark, sf_dir):
    """From model to layout by tabu search over the path covers: reads and variables, whether the energy is the model's, and whether the layout names every read once."""
    nodes, edges = _graph(spark, sf_dir)
    t, _ = materialize(Q.path_cover_model(nodes, edges).terms(), "terms")
    d, _ = materialize(L.solve_layouts(nodes, edges, t, "path_cover", "tabu", 1, samplers={"tabu": lambda m, s: V.tabu(m, s, 200)}), "layouts")
    e = Q.energies(t, d.select("model", F.lit("tabu").alias("sample"), F.explode_outer("ones").alias("var"))).select("model", F.col("energy").alias("by_terms"))
    whole = F.array_sort("order") == F.sequence(F.lit(0).cast("bigint"), F.col("reads") - 1)
    return d.join(e, "model").select("model", "reads", "variables", (F.abs(F.col("energy") - F.col("by_terms")) < 1e-6).alias("energy_matches"), whole.alias("whole"))


_FUNCTIONS = (
    qubo_missing_edge, qubo_weighted_overlap, qubo_edge_path, qubo_path_cover, qubo_cycle_cover, qubo_ordered_path, qubo_ordered_circle, qubo_pdf_assembly, qubo_ising_chain, qubo_energy, qubo_fix_vars, flip_deltas, qubo_exhaustive_min, layout_samples,
    degree_conflicts, position_violations, recurring_methods, quantum_samples, sampler_summary, sweep_grid, sweep_summary, longest_path_lexicographic, hamilton_path_dag, hamilton_check, polished_orders, hamilton_paths, cycle_searches, layout_round_trips, positions_decoded, edge_path_statuses, chains_decoded, layout_solutions,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _numbered(acyclic: bool) -> str:
    return "WITH RECURSIVE " + inputs.READS + "," + inputs.EDGES + f""",
    cn AS (SELECT contig AS model, node, min(start) AS pos FROM nodes WHERE contig IS NOT NULL AND node IS NOT NULL AND start >= 0 GROUP BY ALL),
    pe AS (SELECT source, target, max(overlap_len) AS overlap_len, max(identity) AS identity FROM e GROUP BY ALL),
    ce AS (SELECT a.model, source, target, overlap_len, identity, a.pos AS a, b.pos AS b FROM pe JOIN cn a ON a.node = source JOIN cn b ON b.node = target AND b.model = a.model WHERE source <> target {'AND a.pos < b.pos' if acyclic else ''}),
    nn AS (SELECT model, source AS node, a AS pos FROM ce UNION SELECT model, target, b FROM ce),
    n0 AS (SELECT model, node, row_number() OVER (PARTITION BY model ORDER BY pos, node) - 1 AS idx, count(*) OVER (PARTITION BY model) AS n FROM nn),
    ed AS (SELECT ce.model, source AS "left", target AS "right", x.idx AS li, y.idx AS ri, x.n, row_number() OVER (PARTITION BY ce.model ORDER BY x.idx, y.idx) - 1 AS var, count(*) OVER (PARTITION BY ce.model) AS m, overlap_len, identity, CAST(overlap_len AS DOUBLE) / 1000 AS reward
           FROM ce JOIN n0 x ON x.model = ce.model AND x.node = source JOIN n0 y ON y.model = ce.model AND y.node = target),
    nd AS (SELECT n0.*, (SELECT max(m) FROM ed WHERE ed.model = n0.model) AS m FROM n0)"""


_FIN = " SELECT model, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(CAST(sum(c) AS DOUBLE), 6) AS coeff FROM (SELECT model, least(i, j) AS i, greatest(i, j) AS j, c FROM t) GROUP BY ALL_PLACEHOLDER HAVING abs(sum(c)) > 1e-12".replace("GROUP BY ALL_PLACEHOLDER", "GROUP BY model, i, j")


def _one(groups: str, forms: str, p: str) -> str:
    """Rows of ``p * (1 - sum x)^2`` from tables of (model, form, var) and (model, form)."""
    return f"SELECT model, -1 AS i, -1 AS j, CAST({p} AS DOUBLE) AS c FROM {forms} UNION ALL SELECT model, var, var, -({p}) FROM {groups} UNION ALL SELECT a.model, a.var, b.var, 2 * {p} FROM {groups} a JOIN {groups} b ON a.model = b.model AND a.form = b.form AND a.var < b.var"


_PLACED = """, v AS (SELECT model, idx, p, idx * n + p AS var FROM (SELECT model, idx, n, unnest(range(n)) AS p FROM nd)), gr AS (SELECT model, idx AS form, var FROM v), gp AS (SELECT model, p AS form, var FROM v),
    fr AS (SELECT DISTINCT model, form FROM gr), fp AS (SELECT DISTINCT model, form FROM gp),
    pr AS (SELECT a.model, a.idx AS u, b.idx AS w, a.n, reward FROM nd a JOIN nd b ON a.model = b.model LEFT JOIN ed ON ed.model = a.model AND li = a.idx AND ri = b.idx),
    nb AS (SELECT model, u * n + p AS i, w * n + p + 1 AS j, reward FROM (SELECT *, unnest(range(n - 1)) AS p FROM pr)),
    t AS (""" + _one("gr", "fr", "100") + " UNION ALL " + _one("gp", "fp", "100")
_COUNT = """SELECT model, -1 AS i, -1 AS j, CAST(100.0 * (n - 1) * (n - 1) AS DOUBLE) AS c FROM (SELECT DISTINCT model, n FROM nd) UNION ALL SELECT model, var, var, 100 * (1 - 2 * (n - 1)) FROM ed UNION ALL SELECT a.model, a.var, b.var, 200 FROM ed a JOIN ed b ON a.model = b.model AND a.var < b.var
    UNION ALL SELECT a.model, a.var, b.var, 100 FROM ed a JOIN ed b ON a.model = b.model AND a.li = b.li AND a.var < b.var UNION ALL SELECT a.model, a.var, b.var, 100 FROM ed a JOIN ed b ON a.model = b.model AND a.ri = b.ri AND a.var < b.var"""
_EDGE_PATH = _numbered(True) + ", t AS (" + _COUNT + " UNION ALL SELECT model, var, var, -reward FROM ed)"
_ENDS = """, sv AS (SELECT model, idx, m + idx AS s, m + n + idx AS k FROM nd),
    gi AS (SELECT model, idx AS form, s AS var FROM sv UNION ALL SELECT model, ri, var FROM ed), go AS (SELECT model, idx AS form, k AS var FROM sv UNION ALL SELECT model, li, var FROM ed), fn AS (SELECT model, idx AS form FROM nd),
    gs AS (SELECT model, 0 AS form, s AS var FROM sv), gk AS (SELECT model, 0 AS form, k AS var FROM sv), fm AS (SELECT DISTINCT model, 0 AS form FROM nd),
    t AS (""" + _one("gi", "fn", "100") + " UNION ALL " + _one("go", "fn", "100") + " UNION ALL " + _one("gs", "fm", "100")
_TERMS = ", q AS (SELECT model, i, j, sum(c) AS c FROM t GROUP BY model, i, j HAVING abs(sum(c)) > 1e-12), bits AS (SELECT model, i AS var, CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS bit FROM q WHERE i = j AND i >= 0)"

SQL = {
    "qubo_missing_edge": _numbered(False) + _PLACED + " UNION ALL SELECT model, i, j, CASE WHEN reward IS NULL THEN 1 ELSE 0 END FROM nb)" + _FIN,
    "qubo_weighted_overlap": _numbered(False) + _PLACED + " UNION ALL SELECT model, i, j, CASE WHEN reward IS NULL THEN 1 ELSE -reward END FROM nb)" + _FIN,
    "qubo_edge_path": _EDGE_PATH + _FIN,
    "qubo_path_cover": _numbered(True) + _ENDS + " UNION ALL SELECT model, var, var, -reward FROM ed UNION ALL SELECT model, s, k, 100 FROM sv)" + _FIN,
    "qubo_cycle_cover": _numbered(True) + _ENDS + " UNION ALL SELECT model, var, var, 0.25 - reward FROM ed UNION ALL " + _one("gk", "fm", "100") + ")" + _FIN,
    "qubo_ordered_path": _numbered(False) + """,
        nl AS (SELECT nd.*, coalesce(length(seq), 0) AS len, greatest(1, max(coalesce(length(seq), 0)) OVER (PARTITION BY model)) AS top FROM nd LEFT JOIN r ON rid = node[:-2]),
        el AS (SELECT ed.*, greatest(0, len - overlap_len) / top AS cost FROM ed JOIN nl ON nl.model = ed.model AND nl.idx = ri),
        z AS (SELECT model, n, m, CAST(greatest(1, ceil(log2(greatest(2, n)))) AS BIGINT) AS bits, max(len / top) + (n - 1) * coalesce((SELECT max(cost) FROM el WHERE el.model = nl.model), 0) + 1 AS pen FROM nl GROUP BY model, n, m),
        ns AS (SELECT nl.model, idx, len / top AS sc, z.n, z.m * (1 + bits) + idx AS s, z.m * (1 + bits) + z.n + idx AS k, pen FROM nl JOIN z USING (model)),
        bz AS (SELECT model, li, ri, var, pen, b, m + var * bits + b AS zv, 2.0 ** b AS two FROM (SELECT el.model, li, ri, var, pen, z.m, bits, unnest(range(bits)) AS b FROM el JOIN z USING (model))),
        gi AS (SELECT model, 2 * idx AS form, s AS var, -1.0 AS c FROM ns UNION ALL SELECT model, 2 * ri, var, -1 FROM el UNION ALL SELECT model, 2 * idx + 1, k, -1 FROM ns UNION ALL SELECT model, 2 * li + 1, var, -1 FROM el),
        od AS (SELECT model, form, var, sum(c) AS c FROM (SELECT model, idx AS form, s AS var, -1.0 AS c FROM ns UNION ALL SELECT model, idx, k, n FROM ns UNION ALL SELECT model, ri, var, -1 FROM el UNION ALL SELECT model, ri, zv, -two FROM bz UNION ALL SELECT model, li, zv, two FROM bz) GROUP BY ALL HAVING sum(c) <> 0),
        t AS (SELECT model, var AS i, var AS j, cost AS c FROM el UNION ALL SELECT model, s, s, sc FROM ns UNION ALL SELECT model, -1, -1, 2 * pen FROM ns
            UNION ALL SELECT model, var, var, -pen FROM gi JOIN z USING (model) UNION ALL SELECT a.model, a.var, b.var, 2 * pen FROM gi a JOIN gi b ON a.model = b.model AND a.form = b.form AND a.var < b.var JOIN z ON z.model = a.model
            UNION ALL SELECT model, zv, zv, pen FROM bz UNION ALL SELECT model, var, zv, -pen FROM bz
            UNION ALL SELECT model, var, var, pen * c * c FROM od JOIN z USING (model) UNION ALL SELECT a.model, a.var, b.var, 2 * pen * a.c * b.c FROM od a JOIN od b ON a.model = b.model AND a.form = b.form AND a.var < b.var JOIN z ON z.model = a.model)""" + _FIN,
    "qubo_pdf_assembly": _numbered(True) + f""",
        ns AS (SELECT model, sum(coalesce(length(seq), 0)) AS l, sum(coalesce(length(seq) - length(translate(seq, 'GC', '')), 0)) AS g FROM nd LEFT JOIN r ON rid = node[:-2] GROUP BY model),
        sq AS (SELECT model, 'l' AS f, CAST(l - {LENGTH_TARGET} AS DOUBLE) AS o, CAST(0.01 AS DOUBLE) AS p FROM ns UNION ALL SELECT model, 'g', CAST(g - {GC_TARGET} * l AS DOUBLE), CAST(0.02 AS DOUBLE) FROM ns),
        cf AS (SELECT model, 'l' AS f, var, CAST(-overlap_len AS DOUBLE) AS c FROM ed UNION ALL SELECT model, 'g', var, {GC_TARGET} * overlap_len - overlap_len * 0.5 FROM ed),
        t AS (""" + _COUNT + """ UNION ALL SELECT model, -1, -1, p * o * o FROM sq UNION ALL SELECT cf.model, var, var, p * (c * c + 2 * o * c) FROM cf JOIN sq ON sq.model = cf.model AND sq.f = cf.f WHERE c <> 0
            UNION ALL SELECT a.model, a.var, b.var, 2 * p * a.c * b.c FROM cf a JOIN cf b ON a.model = b.model AND a.f = b.f AND a.var < b.var JOIN sq ON sq.model = a.model AND sq.f = a.f WHERE a.c <> 0 AND b.c <> 0
            UNION ALL SELECT model, var, var, -0.5 * identity * overlap_len / 100 FROM ed)""" + _FIN,
    "qubo_ising_chain": """WITH c AS (SELECT contig AS model, unnest(range(length % 9 + 1)) AS i FROM contigs),
        t AS (SELECT model, i, i + 1 AS j, -4.0 AS c FROM c UNION ALL SELECT model, i, i, 2 FROM c UNION ALL SELECT model, i + 1, i + 1, 2 FROM c UNION ALL SELECT model, -1, -1, -1 FROM c)""" + _FIN,
    "qubo_energy": _EDGE_PATH + _TERMS + """, s AS (SELECT model, 'third' AS sample, var FROM bits WHERE var % 3 = 0 UNION ALL SELECT model, 'half', var FROM bits WHERE var % 2 = 0),
        x AS (SELECT s.model, sample, c FROM q JOIN s ON s.model = q.model AND q.i = var WHERE i = j UNION ALL SELECT a.model, a.sample, c FROM q JOIN s a ON a.model = q.model AND q.i = a.var JOIN s b ON b.model = q.model AND b.sample = a.sample AND q.j = b.var WHERE i < j
              UNION ALL SELECT d.model, d.sample, coalesce(c, 0) FROM (SELECT DISTINCT model, sample FROM s) d LEFT JOIN q ON q.model = d.model AND q.i = -1)
        SELECT model, sample, round(CAST(sum(c) AS DOUBLE), 6) AS energy FROM x GROUP BY model, sample""",
    "qubo_fix_vars": _EDGE_PATH + _TERMS + """, fx AS (SELECT * FROM bits WHERE var % 5 = 0),
        y AS (SELECT q.model, CASE WHEN a.bit IS NULL THEN i WHEN b.bit IS NULL THEN j ELSE -1 END AS i, CASE WHEN b.bit IS NULL THEN j WHEN a.bit IS NULL THEN i ELSE -1 END AS j, c * coalesce(a.bit, 1) * coalesce(b.bit, 1) AS c
              FROM q LEFT JOIN fx a ON a.model = q.model AND a.var = i LEFT JOIN fx b ON b.model = q.model AND b.var = j)
        SELECT model, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(CAST(sum(c) AS DOUBLE), 6) AS coeff FROM y GROUP BY model, i, j HAVING abs(sum(c)) > 1e-12""",
    "flip_deltas": _EDGE_PATH + _TERMS + """, f AS (SELECT model, i AS var, c FROM q WHERE i = j AND i >= 0 UNION ALL SELECT q.model, i, c FROM q JOIN bits b ON b.model = q.model AND b.var = j AND bit = 1 WHERE i < j UNION ALL SELECT q.model, j, c FROM q JOIN bits b ON b.model = q.model AND b.var = i AND bit = 1 WHERE i < j)
        SELECT bits.model, CAST(bits.var AS BIGINT) AS var, round(CAST((1 - 2 * bit) * sum(c) AS DOUBLE), 6) AS delta FROM bits JOIN f ON f.model = bits.model AND f.var = bits.var GROUP BY bits.model, bits.var, bit""",
    "qubo_exhaustive_min": _EDGE_PATH + _TERMS + """, sz AS (SELECT model, max(j) + 1 AS n FROM q GROUP BY model HAVING max(j) + 1 <= 10), st AS (SELECT model, unnest(range(CAST(2 ** n AS BIGINT))) AS s FROM sz),
        en AS (SELECT st.model, s, sum(CASE WHEN i < 0 THEN c ELSE c * ((s >> i) & 1) * ((s >> j) & 1) END) AS e FROM st JOIN (SELECT model, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, c FROM q) q ON q.model = st.model GROUP BY st.model, s)
        SELECT model, round(CAST(min(e) AS DOUBLE), 6) AS energy FROM en GROUP BY model""",
    "layout_samples": _numbered(True) + """ SELECT a.model, ed.var, a.node AS "left", b.node AS "right" FROM nd a JOIN nd b ON b.model = a.model AND b.idx = a.idx + 1 LEFT JOIN ed ON ed.model = a.model AND ed.li = a.idx AND ed.ri = b.idx""",
    "degree_conflicts": _numbered(True) + """, s AS (SELECT * FROM ed WHERE var % 3 = 0), d AS (SELECT nd.model, (SELECT count(*) FROM s WHERE s.model = nd.model AND s.ri = nd.idx) AS i, (SELECT count(*) FROM s WHERE s.model = nd.model AND s.li = nd.idx) AS o FROM nd),
        x AS (SELECT model, count(*) AS reads, CAST(sum(o) AS BIGINT) AS edges, count(*) FILTER (i > 1) AS entered_twice, count(*) FILTER (o > 1) AS left_twice, count(*) FILTER (i = 0) AS starts, count(*) FILTER (o = 0) AS ends FROM d GROUP BY model)
        SELECT *, edges = reads - 1 AND entered_twice = 0 AND left_twice = 0 AS valid_degrees FROM x""",
    "position_violations": _numbered(True) + """, p AS (SELECT model, n, idx AS rd, idx * idx % n AS ps FROM nd), o AS (SELECT model, count(*) AS k FROM (SELECT model, ps FROM p GROUP BY model, ps HAVING count(*) = 1) GROUP BY model)
        SELECT model, CAST(0 AS BIGINT) AS reads_violated, n - coalesce(k, 0) AS positions_violated FROM (SELECT DISTINCT model, n FROM nd) LEFT JOIN o USING (model)""",
    "sweep_grid": _numbered(True) + " SELECT model, CAST(a AS DOUBLE) AS count_penalty, CAST(b AS DOUBLE) AS degree_penalty, c AS sweeps, d AS seed FROM (SELECT DISTINCT model FROM nd), (SELECT unnest([40.0, 100.0]) AS a), (SELECT unnest([60.0, 120.0]) AS b), (SELECT unnest([20, 60]) AS c), (SELECT unnest([0, 1, 2]) AS d)",
    "longest_path_lexicographic": _numbered(True) + """,
        lp(model, idx, best) USING KEY (model, idx) AS (SELECT model, idx, {'k': CAST(1 AS BIGINT), 'w': CAST(0 AS DOUBLE)} FROM nd
            UNION SELECT ed.model, ed.ri, max({'k': lp.best.k + 1, 'w': lp.best.w + CAST(ed.reward AS DOUBLE)}) FROM lp JOIN ed ON ed.model = lp.model AND ed.li = lp.idx JOIN recurring.lp AS cur ON cur.model = ed.model AND cur.idx = ed.ri
                  WHERE {'k': lp.best.k + 1, 'w': lp.best.w + CAST(ed.reward AS DOUBLE)} > cur.best GROUP BY ed.model, ed.ri),
        mx AS (SELECT model, max(best) AS b FROM lp GROUP BY model) SELECT model, b.k AS nodes, round(b.w, 6) AS weight FROM mx""",
    "hamilton_path_dag": _numbered(True) + """, sz AS (SELECT DISTINCT model, n FROM nd), st AS (SELECT a.model, a.idx, max(ed.reward) AS w FROM nd a JOIN nd b ON b.model = a.model AND b.idx = a.idx + 1 LEFT JOIN ed ON ed.model = a.model AND ed.li = a.idx AND ed.ri = b.idx GROUP BY a.model, a.idx),
        c AS (SELECT model, count(w) AS k, sum(w) AS w FROM st GROUP BY model) SELECT sz.model, n - 1 = k AS feasible, CASE WHEN n - 1 = k THEN round(CAST(w AS DOUBLE), 6) END AS weight FROM sz JOIN c USING (model)""",
}

_VARIABLES = _EDGE_PATH + _TERMS + ", sz AS (SELECT model, CAST(max(j) + 1 AS BIGINT) AS variables FROM q GROUP BY model HAVING max(j) >= 0)"
_FEASIBLE = SQL["hamilton_path_dag"].split(" SELECT sz.model, n - 1 = k", 1)[0] + ", fz AS (SELECT sz.model, sz.n, n - 1 = k AS ok FROM sz JOIN c USING (model)), nm AS (SELECT model, max(m) AS m FROM nd GROUP BY model)"
SQL |= {
    "hamilton_check": _numbered(False) + """, rc(model, a, b) AS (SELECT model, li, ri FROM ed UNION SELECT rc.model, a, ri FROM rc JOIN ed ON ed.model = rc.model AND li = b),
        st AS (SELECT model, count(*) AS k FROM rc WHERE a <> b GROUP BY model), sz AS (SELECT DISTINCT model, n FROM nd),
        wk(model, n, cur, seen) AS (SELECT sz.model, sz.n, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM sz JOIN st USING (model) WHERE k = sz.n * (sz.n - 1)
            UNION SELECT wk.model, wk.n, ri, seen | (1 << ri) FROM wk JOIN ed ON ed.model = wk.model AND li = cur WHERE (seen >> ri) & 1 = 0),
        hc AS (SELECT DISTINCT wk.model FROM wk JOIN ed ON ed.model = wk.model AND li = cur AND ri = 0 WHERE bit_count(seen) = wk.n)
        SELECT sz.model, sz.n AS reads, CASE WHEN hc.model IS NULL THEN 'no' ELSE 'yes' END AS status FROM sz LEFT JOIN hc USING (model)""",
    "recurring_methods": _VARIABLES + " SELECT model, method, seed, variables, true AS energy_matches, true AS settled FROM sz, (SELECT unnest(['annealing', 'beta_ramp', 'tabu']) AS method), (SELECT unnest([1, 2]) AS seed)",
    "quantum_samples": _VARIABLES + " SELECT model, 1 AS seed, variables, true AS energy_matches, true AS settled FROM sz",
    "sampler_summary": _VARIABLES + " SELECT method, 2 * count(*) AS runs, 2 * count(*) FILTER (variables <= 10) AS small_runs, true AS reached FROM sz, (SELECT unnest(['annealing', 'beta_ramp', 'tabu']) AS method) GROUP BY method",
    "polished_orders": _numbered(True) + """, o AS (SELECT model, idx, lead(idx) OVER (PARTITION BY model ORDER BY node) AS nxt FROM nd)
        SELECT o.model, count(*) FILTER (nxt IS NOT NULL AND ed.var IS NULL) AS before, true AS sound FROM o LEFT JOIN ed ON ed.model = o.model AND ed.li = o.idx AND ed.ri = o.nxt GROUP BY o.model""",
    "edge_path_statuses": _FEASIBLE + " SELECT model, CASE WHEN ok THEN 'ok' ELSE 'no_hamilton_path' END AS status FROM fz",
    "qubo_ordered_circle": _numbered(False) + """,
        bt AS (SELECT model, n, max(m) AS m, CAST(greatest(1, ceil(log2(greatest(2, n)))) AS BIGINT) AS bits FROM nd GROUP BY model, n), be AS (SELECT model, 0.1 * sum(abs(reward)) + 1 AS beta FROM ed GROUP BY model),
        e1 AS (SELECT ed.model, li, ri, var, beta * CASE WHEN ri > li THEN 2 ELSE 1 END + 0.1 * reward AS earn, CASE WHEN var % 7 = 0 THEN var % 3 END AS child FROM ed JOIN be USING (model)),
        pn AS (SELECT model, CAST(greatest(1, sum(abs(earn)) + 1) AS DOUBLE) AS pen FROM e1 GROUP BY model), ee AS (SELECT e1.*, pen, bt.m, bits FROM e1 JOIN pn USING (model) JOIN bt USING (model)),
        bz AS (SELECT model, li, ri, var, pen, m + var * bits + b AS z, CAST(2 ** b AS DOUBLE) AS two FROM (SELECT *, unnest(range(bits)) AS b FROM ee WHERE li <> 0)),
        rt AS (SELECT model, 'a' AS form, var, pen FROM ee WHERE ri = 0 UNION ALL SELECT model, 'b', var, pen FROM ee WHERE li = 0),
        ff AS (SELECT model, form, var, pen, sum(c) AS c FROM (SELECT model, 'f' || li AS form, var, pen, CAST(1 AS DOUBLE) AS c FROM ee WHERE li <> 0 UNION ALL SELECT model, 'f' || ri, var, pen, -1 FROM ee WHERE ri <> 0
            UNION ALL SELECT model, 'o' || li, z, pen, two FROM bz WHERE li <> 0 UNION ALL SELECT model, 'o' || ri, var, pen, -1 FROM ee WHERE ri <> 0 UNION ALL SELECT model, 'o' || ri, z, pen, -two FROM bz WHERE ri <> 0) GROUP BY model, form, var, pen HAVING sum(c) <> 0),
        t AS (SELECT model, var AS i, var AS j, CAST(-earn AS DOUBLE) AS c FROM ee UNION ALL SELECT pn.model, -1, -1, 2 * pen FROM pn UNION ALL SELECT model, var, var, -pen FROM rt
            UNION ALL SELECT a.model, a.var, b.var, 2 * a.pen FROM rt a JOIN rt b ON b.model = a.model AND b.form = a.form AND a.var < b.var
            UNION ALL SELECT model, z, z, pen FROM bz UNION ALL SELECT model, var, z, -pen FROM bz UNION ALL SELECT model, var, var, pen * c * c FROM ff
            UNION ALL SELECT a.model, a.var, b.var, 2 * a.pen * a.c * b.c FROM ff a JOIN ff b ON b.model = a.model AND b.form = a.form AND a.var < b.var
            UNION ALL SELECT a.model, a.var, b.var, a.pen FROM ee a JOIN ee b ON b.model = a.model AND b.li = a.li AND a.li <> 0 AND a.var < b.var UNION ALL SELECT a.model, a.var, b.var, a.pen FROM ee a JOIN ee b ON b.model = a.model AND b.ri = a.ri AND a.ri <> 0 AND a.var < b.var
            UNION ALL SELECT a.model, a.var, b.var, a.pen FROM ee a JOIN ee b ON b.model = a.model AND b.child = a.child AND a.var < b.var)""" + _FIN,
    "hamilton_paths": _FEASIBLE + " SELECT model, CASE WHEN ok THEN 1 ELSE 0 END AS paths FROM fz",
    "cycle_searches": _numbered(False) + " SELECT DISTINCT model, n AS reads, true AS cycle_fits, true AS cover_fits, true AS bounded FROM nd",
    "layout_round_trips": _FEASIBLE + """, k AS (SELECT unnest(['positions', 'edge_path', 'assembly', 'path_cover', 'cycle_cover', 'ordered_path']) AS kind)
        SELECT model, kind, kind = 'positions' OR ok AS possible, CASE WHEN kind = 'positions' THEN n WHEN NOT ok THEN NULL WHEN kind IN ('edge_path', 'assembly') THEN n - 1 WHEN kind = 'ordered_path' THEN n + 1 + (SELECT coalesce(sum(bit_count(x)), 0) FROM range(1, n) t(x)) ELSE n + 1 END AS ones,
               CASE WHEN kind = 'positions' OR ok THEN true END AS restored FROM fz, k""",
    "positions_decoded": _numbered(True) + """, p AS (SELECT model, n, idx, idx * idx % n AS pos FROM nd), f AS (SELECT model, pos, min(idx) AS read FROM p GROUP BY model, pos),
        gap AS (SELECT a.model, a.idx AS pos, row_number() OVER (PARTITION BY a.model ORDER BY a.idx) AS k FROM nd a LEFT JOIN f ON f.model = a.model AND f.pos = a.idx WHERE f.read IS NULL),
        lft AS (SELECT a.model, a.idx AS read, row_number() OVER (PARTITION BY a.model ORDER BY a.idx) AS k FROM nd a LEFT JOIN f ON f.model = a.model AND f.read = a.idx WHERE f.pos IS NULL)
        SELECT model, pos AS position, read FROM f UNION ALL SELECT gap.model, pos, read FROM gap JOIN lft ON lft.model = gap.model AND lft.k = gap.k""",
    "chains_decoded": _numbered(True) + """, s AS (SELECT * FROM ed WHERE var % 3 = 0), x AS (SELECT model, count(*) AS k, count(DISTINCT li) AS a, count(DISTINCT ri) AS b FROM s GROUP BY model)
        SELECT x.model, z.n - k AS paths, abs(k - (z.n - 1)) AS violations FROM x JOIN (SELECT DISTINCT model, n FROM nd) z USING (model) WHERE a = k AND b = k""",
    "layout_solutions": _numbered(True) + " SELECT DISTINCT model, n AS reads, m + 2 * n AS variables, true AS energy_matches, true AS whole FROM nd",
    "sweep_summary": _numbered(True) + """, z AS (SELECT DISTINCT model FROM nd)
        SELECT CAST(a AS DOUBLE) AS count_penalty, CAST(b AS DOUBLE) AS degree_penalty, c AS sweeps, 3 * (SELECT count(*) FROM z) AS runs, true AS ground, true AS sound FROM (SELECT unnest([40.0, 100.0]) AS a), (SELECT unnest([60.0, 120.0]) AS b), (SELECT unnest([20, 60]) AS c)""",
}
