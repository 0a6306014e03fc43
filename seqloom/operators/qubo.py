"""Binary quadratic models of layouts as coefficient tables.

A model is three tables, all with ``model``: ``linear`` (var, coeff), ``quadratic`` (i < j, coeff) and ``constant`` (value). Every penalty is a join that
emits rows; equal terms are summed at the end. Any number of models is built at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class Qubo:
    linear: DataFrame
    quadratic: DataFrame
    constant: DataFrame
    apart: bool = False  # no two rows are of the same term, and i < j

    def plus(self, other: Qubo) -> Qubo:
        return Qubo(self.linear.unionByName(other.linear), self.quadratic.unionByName(other.quadratic), self.constant.unionByName(other.constant))

    def terms(self, prune: float = 1e-12) -> DataFrame:
        """One table ``model``, ``i``, ``j``, ``coeff``: linear terms have i = j, the constant -1 for both; terms within ``prune`` of 0 are left out."""
        lin = self.linear.select("model", F.col("var").alias("i"), F.col("var").alias("j"), "coeff")
        quad = self.quadratic.select("model", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "coeff") if not self.apart else self.quadratic
        const = self.constant.select("model", F.lit(-1).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("j"), F.col("value").alias("coeff"))
        rows = lin.unionByName(quad).unionByName(const)
        if self.apart:
            return rows.where(F.abs("coeff") > prune)
        return rows.groupBy("model", "i", "j").agg(F.sum("coeff").alias("coeff")).where(F.abs("coeff") > prune)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def linear_part(terms: DataFrame) -> Qubo:
    """A model of linear terms ``model``, ``var``, ``coeff``."""
    kind = terms.schema["model"].dataType.simpleString()
    return Qubo(terms.select("model", F.col("var").cast("bigint").alias("var"), F.col("coeff").cast("double").alias("coeff")), _empty(terms, f"model {kind}, i bigint, j bigint, coeff double"), _empty(terms, f"model {kind}, value double"))


def quadratic_part(terms: DataFrame) -> Qubo:
    """A model of quadratic terms ``model``, ``i``, ``j``, ``coeff``."""
    kind = terms.schema["model"].dataType.simpleString()
    return Qubo(_empty(terms, f"model {kind}, var bigint, coeff double"), terms.select("model", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("coeff").cast("double").alias("coeff")), _empty(terms, f"model {kind}, value double"))


def square(forms: DataFrame, offsets: DataFrame, penalty: float | Column) -> Qubo:
    """``penalty * (offset + sum of c*x)^2`` for every form: ``forms`` has model, form, var, c (a variable once per form), ``offsets`` model, form, offset."""
    p = F.lit(penalty) if not isinstance(penalty, Column) else penalty
    f = forms.where("c <> 0").join(offsets, ["model", "form"])
    lin = f.select("model", F.col("var").cast("bigint").alias("var"), (p * (F.col("c") * F.col("c") + 2 * F.col("offset") * F.col("c"))).cast("double").alias("coeff"))
    other = forms.where("c <> 0").select("model", "form", F.col("var").alias("var2"), F.col("c").alias("c2"))
    quad = f.join(other, ["model", "form"]).where("var < var2").select("model", F.col("var").cast("bigint").alias("i"), F.col("var2").cast("bigint").alias("j"), (2 * p * F.col("c") * F.col("c2")).cast("double").alias("coeff"))
    const = offsets.select("model", (p * F.col("offset") * F.col("offset")).cast("double").alias("value"))
    return Qubo(lin, quad, const)


def exactly_one(groups: DataFrame, forms: DataFrame, penalty: float) -> Qubo:
    """``penalty * (1 - sum x)^2`` for every form; ``forms`` lists them all (model, form), also those without variables."""
    return square(groups.select("model", "form", "var", F.lit(-1.0).alias("c")), forms.select("model", "form", F.lit(1.0).alias("offset")), penalty)


def number_graph(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers reads and edges of each model: ``nodes`` (model, node, pos) get ``idx`` and ``n``, ``pairs`` (model, left, right, ...) get ``li``, ``ri``, ``var``, ``n`` and ``m``. Models must fit a solver, so windows per model are bounded."""
    w = Window.partitionBy("model")
    n = nodes.select("model", "node", (F.row_number().over(w.orderBy("pos", "node")) - 1).cast("bigint").alias("idx"), F.count(F.lit(1)).over(w).alias("n"))
    e = pairs.join(n.select("model", F.col("node").alias("left"), F.col("idx").alias("li"), "n"), ["model", "left"]).join(n.select("model", F.col("node").alias("right"), F.col("idx").alias("ri")), ["model", "right"])
    e = e.where("li <> ri").withColumns({"var": (F.row_number().over(w.orderBy("li", "ri")) - 1).cast("bigint"), "m": F.count(F.lit(1)).over(w)})
    sizes = e.groupBy("model").agg(F.max("m").alias("m"))
    return n.join(sizes, "model", "left").withColumn("m", F.coalesce("m", F.lit(0).cast("bigint"))), e


def _placed_model(nodes: DataFrame, pairs: DataFrame, read_penalty: float, position_penalty: float, missing_penalty: float) -> Qubo:
    """One variable ``idx * n + p`` per read and position: every read and every position is used once, and two reads at consecutive positions cost the ``coeff`` of their pair (model, li, ri; equal ones are summed), ``missing_penalty`` if it isn't listed.

    The terms of a read follow from its number and its costs with others, and no two of them meet in a pair of variables. So they are emitted where those are, none is shuffled or
    summed, and the reads of a large model are spread over as many tasks as its terms need. There are about ``2 * n^3`` of them. Generated code holds all rows that it makes of one:
    so what is spread is pairs, two of reads or a read and a place, of which each has at most ``n`` terms of a kind.
    """
    spark = nodes.sparkSession
    zero, n, u, v, p, q = F.lit(0).cast("bigint"), *map(F.col, "nuvpq")
    own = pairs.groupBy("model", "li", "ri").agg(F.sum("coeff").alias("coeff"))
    listed = lambda a, b, name: own.groupBy("model", F.col(a).alias("u")).agg(F.map_from_entries(F.collect_list(F.struct(b, "coeff"))).alias(name))
    costs = lambda name: F.transform(F.sequence(zero, n - 1), lambda x: F.coalesce(F.try_element_at(name, x), F.lit(float(missing_penalty)))).alias(name)
    each = nodes.select("model", F.col("idx").alias("u"), "n").join(listed("li", "ri", "out"), ["model", "u"], "left").join(listed("ri", "li", "into"), ["model", "u"], "left")
    each, _ = materialize(each.select("model", "u", "n", costs("out"), costs("into")), "pairs")
    total, rows = each.agg(F.coalesce(F.sum(2.0 * n * n), F.lit(0.0)), F.coalesce(F.sum("n"), zero)).first()
    least = 2 * spark.sparkContext.defaultParallelism
    each = each.repartition(max(least, min(20_000, int(rows / 2_000_000))), "model", "u")
    spread = lambda d: d.repartition(max(least, min(20_000, int(total / 20_000_000))), "model", "u")
    places = each.select("model", "u", "n", F.get("out", u.cast("int")).alias("s"), F.explode(F.sequence(zero, n - 1)).alias("p"))
    linear = places.select("model", (u * n + p).alias("var"), F.lit(-float(read_penalty) - float(position_penalty)).alias("coeff"))
    later = spread(places.where("p < n - 1")).select("model", "u", "n", "p", "s", F.explode(F.sequence(p + 1, n - 1)).alias("q"))
    same_read = later.select("model", (u * n + p).alias("i"), (u * n + q).alias("j"), (F.lit(2.0 * read_penalty) + F.when(q == p + 1, F.col("s")).otherwise(0.0)).alias("coeff"))
    above = each.where("u < n - 1").select("model", "u", "n", "out", "into", F.explode(F.sequence(u + 1, n - 1)).alias("v"))
    above = spread(above.select("model", "u", "n", "v", F.get("out", v.cast("int")).alias("forth"), F.get("into", v.cast("int")).alias("back")))
    same_place = above.select("model", "u", "n", "v", F.explode(F.sequence(zero, n - 1)).alias("p")).select("model", (u * n + p).alias("i"), (v * n + p).alias("j"), F.lit(2.0 * position_penalty).alias("coeff"))
    steps = lambda cost: above.where(F.col(cost) != 0).select("model", "u", "n", "v", F.col(cost).alias("coeff"), F.explode(F.sequence(zero, n - 2)).alias("p"))
    forth = steps("forth").select("model", (u * n + p).alias("i"), (v * n + p + 1).alias("j"), "coeff")
    back = steps("back").select("model", (u * n + p + 1).alias("i"), (v * n + p).alias("j"), "coeff")
    constant = nodes.groupBy("model").agg(((float(read_penalty) + float(position_penalty)) * F.max("n")).alias("value"))
    return Qubo(linear, same_read.unionByName(same_place).unionByName(forth).unionByName(back), constant, True)


def missing_edge_model(nodes: DataFrame, edges: DataFrame, read_penalty: float = 100.0, position_penalty: float = 100.0, missing_penalty: float = 1.0) -> Qubo:
    """One variable per read and position: each used once, and a penalty for neighbours without an edge."""
    return _placed_model(nodes, edges.select("model", "li", "ri", F.lit(0.0).alias("coeff")), read_penalty, position_penalty, missing_penalty)


def weighted_overlap_model(nodes: DataFrame, edges: DataFrame, read_penalty: float = 100.0, position_penalty: float = 100.0, missing_penalty: float = 1.0, scale: float = 1.0) -> Qubo:
    """As :func:`missing_edge_model`, with the ``reward`` of the edges between neighbours taken off."""
    cost = F.when(F.col("reward").isNull(), F.lit(float(missing_penalty))).otherwise(-scale * F.col("reward"))
    return _placed_model(nodes, edges.select("model", "li", "ri", cost.alias("coeff")), read_penalty, position_penalty, missing_penalty)


def _conflicts(edges: DataFrame, penalty: float) -> Qubo:
    """A penalty for every two edges with the same source, and with the same target."""
    out = None
    for side in ("li", "ri"):
        a, b = edges.select("model", side, F.col("var").alias("i")), edges.select("model", side, F.col("var").alias("j"))
        q = quadratic_part(a.join(b, ["model", side]).where("i < j").select("model", "i", "j", F.lit(penalty).alias("coeff")))
        out = q if out is None else out.plus(q)
    return out


def _edge_count(nodes: DataFrame, edges: DataFrame, penalty: float) -> Qubo:
    target = nodes.groupBy("model").agg((F.lit(1.0) - F.max("n")).alias("offset")).select("model", F.lit(0).alias("form"), "offset")
    return square(edges.select("model", F.lit(0).alias("form"), "var", F.lit(1.0).alias("c")), target, penalty)


def edge_path_model(nodes: DataFrame, edges: DataFrame, count_penalty: float = 100.0, degree_penalty: float = 100.0, scale: float = 1.0) -> Qubo:
    """One variable per edge of an acyclic graph: one edge less than reads, no two from or into a read, rewards taken off."""
    return _edge_count(nodes, edges, count_penalty).plus(_conflicts(edges, degree_penalty)).plus(linear_part(edges.select("model", "var", (-scale * F.col("reward")).alias("coeff"))))


def _ends(nodes: DataFrame, edges: DataFrame, offset: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source and sink variables of reads (behind ``offset``), and the groups of incoming edges with the source, outgoing ones with the sink."""
    v = nodes.select("model", "idx", (offset + F.col("idx")).alias("source"), (offset + F.col("n") + F.col("idx")).alias("sink"))
    into = v.select("model", (2 * F.col("idx")).alias("form"), F.col("source").alias("var")).unionByName(edges.select("model", (2 * F.col("ri")).alias("form"), "var"))
    out = v.select("model", (2 * F.col("idx") + 1).alias("form"), F.col("sink").alias("var")).unionByName(edges.select("model", (2 * F.col("li") + 1).alias("form"), "var"))
    return v, into.unionByName(out), v.select("model", F.explode(F.array(2 * F.col("idx"), 2 * F.col("idx") + 1)).alias("form"))


def path_cover_model(nodes: DataFrame, edges: DataFrame, degree_penalty: float = 100.0, isolate_penalty: float = 100.0, cap_penalty: float = 100.0, scale: float = 1.0) -> Qubo:
    """Edges, a source and a sink per read: each read is entered and left exactly once, isolated reads cost, and so does every number of paths but one, quadratically."""
    v, groups, forms = _ends(nodes, edges, F.col("m"))
    q = exactly_one(groups, forms, degree_penalty).plus(linear_part(edges.select("model", "var", (-scale * F.col("reward")).alias("coeff"))))
    q = q.plus(quadratic_part(v.select("model", F.col("source").alias("i"), F.col("sink").alias("j"), F.lit(isolate_penalty).alias("coeff"))))
    s = v.select("model", F.lit(0).alias("form"), F.col("source").alias("var"))
    return q.plus(exactly_one(s, s.select("model", "form").distinct(), cap_penalty))


def cycle_cover_model(nodes: DataFrame, edges: DataFrame, degree_penalty: float = 100.0, selection_penalty: float = 0.0, scale: float = 1.0) -> Qubo:
    """As the path cover, with a void node that is entered and left exactly once as well and an optional cost per edge."""
    v, groups, forms = _ends(nodes, edges, F.col("m"))
    q = exactly_one(groups, forms, degree_penalty).plus(linear_part(edges.select("model", "var", (selection_penalty - scale * F.col("reward")).alias("coeff"))))
    for c in ("source", "sink"):
        s = v.select("model", F.lit(0).alias("form"), F.col(c).alias("var"))
        q = q.plus(exactly_one(s, s.select("model", "form").distinct(), degree_penalty))
    return q


def ordered_path_model(nodes: DataFrame, edges: DataFrame, scale: float = 1.0, penalty: float | None = None) -> Qubo:
    """Edges with the bits of their position, a source and a sink per read; works for graphs with cycles.

    Costs are the normalised ``cost`` of edges and ``source_cost`` of reads; the penalties for degrees, order and bits of unselected edges are ``penalty``, by default the
    most that a path can cost plus one. The order residual of a read: what leaves it stands one behind what enters it.
    """
    size = nodes.groupBy("model").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("source_cost").alias("s"))
    top = edges.groupBy("model").agg(F.max("cost").alias("c"))
    z = size.join(top, "model", "left").select("model", "n", "m", F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(2), F.col("n")).cast("double")))).cast("bigint").alias("bits"), (F.lit(scale) * (F.col("s") + (F.col("n") - 1) * F.coalesce("c", F.lit(0.0))) + 1).alias("auto"))
    z, _ = materialize(z.withColumn("pen", F.col("auto") if penalty is None else F.lit(penalty)), "sizes")  # one row per model
    nd, ed = nodes.drop("n", "m").join(z, "model"), edges.drop("n", "m").join(z, "model")
    nd = nd.withColumns({"source": F.col("m") * (1 + F.col("bits")) + F.col("idx"), "sink": F.col("m") * (1 + F.col("bits")) + F.col("n") + F.col("idx")})
    q = linear_part(ed.select("model", "var", (scale * F.col("cost")).alias("coeff")).unionByName(nd.select("model", F.col("source").alias("var"), (scale * F.col("source_cost")).alias("coeff"))))
    into = nd.select("model", (2 * F.col("idx")).alias("form"), F.col("source").alias("var")).unionByName(ed.select("model", (2 * F.col("ri")).alias("form"), "var"))
    out = nd.select("model", (2 * F.col("idx") + 1).alias("form"), F.col("sink").alias("var")).unionByName(ed.select("model", (2 * F.col("li") + 1).alias("form"), "var"))
    one = into.unionByName(out).select("model", "form", "var", F.lit(-1.0).alias("c"))
    forms = nd.select("model", F.explode(F.array(2 * F.col("idx"), 2 * F.col("idx") + 1)).alias("form"), F.lit(1.0).alias("offset"), "pen")
    q = q.plus(square(one, forms, F.col("pen")))
    bits = ed.select("model", "li", "ri", "var", "pen", "m", "bits", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bits") - 1)).alias("b"))
    bits = bits.withColumns({"z": F.col("m") + F.col("var") * F.col("bits") + F.col("b"), "two": F.pow(F.lit(2.0), F.col("b"))})
    q = q.plus(linear_part(bits.select("model", F.col("z").alias("var"), F.col("pen").alias("coeff")))).plus(quadratic_part(bits.select("model", F.col("var").alias("i"), F.col("z").alias("j"), (-F.col("pen")).alias("coeff"))))
    order = (
        nd.select("model", F.col("idx").alias("form"), F.col("source").alias("var"), F.lit(-1.0).alias("c"))
        .unionByName(nd.select("model", F.col("idx").alias("form"), F.col("sink").alias("var"), F.col("n").cast("double").alias("c")))
        .unionByName(ed.select("model", F.col("ri").alias("form"), "var", F.lit(-1.0).alias("c")))
        .unionByName(bits.select("model", F.col("ri").alias("form"), F.col("z").alias("var"), (-F.col("two")).alias("c")))
        .unionByName(bits.select("model", F.col("li").alias("form"), F.col("z").alias("var"), F.col("two").alias("c")))
        .groupBy("model", "form", "var").agg(F.sum("c").alias("c"))
    )
    return q.plus(square(order, nd.select("model", F.col("idx").alias("form"), F.lit(0.0).alias("offset"), "pen"), F.col("pen")))


def assembly_model(nodes: DataFrame, edges: DataFrame, degree_penalty: float = 100.0, length_target: float | None = None, length_penalty: float = 0.0, gc_target: float | None = None, gc_penalty: float = 0.0, mi_scale: float = 0.0) -> Qubo:
    """The edge path with squared errors of assembled length and GC content and a reward for mutual information.

    ``nodes`` has length and gc, ``edges`` overlap_len, overlap_gc and mi besides.
    """
    q = _edge_count(nodes, edges, degree_penalty).plus(_conflicts(edges, degree_penalty))
    sums = nodes.groupBy("model").agg(F.sum("length").alias("l"), F.sum("gc").alias("g"))
    if length_target is not None and length_penalty > 0:
        q = q.plus(square(edges.select("model", F.lit(0).alias("form"), "var", (-F.col("overlap_len")).cast("double").alias("c")), sums.select("model", F.lit(0).alias("form"), (F.col("l") - length_target).alias("offset")), length_penalty))
    if gc_target is not None and gc_penalty > 0:
        c = gc_target * F.col("overlap_len") - F.col("overlap_gc")
        q = q.plus(square(edges.select("model", F.lit(0).alias("form"), "var", c.cast("double").alias("c")), sums.select("model", F.lit(0).alias("form"), (F.col("g") - gc_target * F.col("l")).alias("offset")), gc_penalty))
    if mi_scale:
        q = q.plus(linear_part(edges.select("model", "var", (-mi_scale * F.col("mi")).alias("coeff"))))
    return q


def ising_chain(model: DataFrame, coupling: float = 1.0) -> Qubo:
    """A ferromagnetic chain (``model``, ``n``) of spins s = 2x-1: ``-coupling`` for every two equal neighbours, ``+coupling`` for different ones; its least energy is ``-coupling*(n-1)``."""
    at = model.where("n > 1").select("model", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 2)).alias("i"))
    q = quadratic_part(at.select("model", "i", (F.col("i") + 1).alias("j"), F.lit(-4.0 * coupling).alias("coeff")))
    q = q.plus(linear_part(at.select("model", F.explode(F.array("i", F.col("i") + 1)).alias("var"), F.lit(2.0 * coupling).alias("coeff"))))
    return Qubo(q.linear, q.quadratic, at.select("model", F.lit(-1.0 * coupling).alias("value")))


def energies(terms: DataFrame, samples: DataFrame) -> DataFrame:
    """``model``, ``sample``, ``energy`` of samples given by their set variables (``model``, ``sample``, ``var``); samples without any are listed with a null ``var``."""
    one = samples.where("var is not null")
    single = terms.where("i = j and i >= 0").join(one.select("model", "sample", F.col("var").alias("i")), ["model", "i"]).select("model", "sample", "coeff")
    pair = terms.where("i < j").join(one.select("model", "sample", F.col("var").alias("i")), ["model", "i"]).join(one.select("model", "sample", F.col("var").alias("j")), ["model", "sample", "j"]).select("model", "sample", "coeff")
    const = samples.select("model", "sample").distinct().join(terms.where("i < 0").select("model", "coeff"), "model", "left").select("model", "sample", F.coalesce("coeff", F.lit(0.0)).alias("coeff"))
    return single.unionByName(pair).unionByName(const).groupBy("model", "sample").agg(F.sum("coeff").alias("energy"))


def fix_variables(terms: DataFrame, fixed: DataFrame) -> DataFrame:
    """Terms of the model left when variables (``model``, ``var``, ``bit``) are fixed: quadratic terms become linear, linear ones constant."""
    f = lambda x: fixed.select("model", F.col("var").alias(x), F.col("bit").alias(f"b{x}"))
    d = terms.join(f("i"), ["model", "i"], "left").join(f("j"), ["model", "j"], "left")
    bi, bj = F.col("bi"), F.col("bj")
    none = F.lit(-1).cast("bigint")
    d = d.select(
        "model", F.when(bi.isNull(), F.col("i")).when(bj.isNull(), F.col("j")).otherwise(none).alias("x"), F.when(bj.isNull(), F.col("j")).when(bi.isNull(), F.col("i")).otherwise(none).alias("y"),
        (F.col("coeff") * F.coalesce(bi, F.lit(1)) * F.coalesce(bj, F.lit(1))).alias("coeff"),
    )
    return d.groupBy("model", F.col("x").alias("i"), F.col("y").alias("j")).agg(F.sum("coeff").alias("coeff")).where(F.abs("coeff") > 1e-12)


def flip_deltas(terms: DataFrame, bits: DataFrame) -> DataFrame:
    """``model``, ``var``, ``delta``: how the energy changes when one variable of a sample (``model``, ``var``, ``bit``, all variables) flips."""
    lin = terms.where("i = j and i >= 0").select("model", F.col("i").alias("var"), "coeff")
    q = terms.where("i < j")
    both = q.select("model", F.explode(F.array(F.struct(F.col("i").alias("var"), F.col("j").alias("o")), F.struct(F.col("j").alias("var"), F.col("i").alias("o")))).alias("p"), "coeff").select("model", "p.var", "p.o", "coeff")
    field = both.join(bits.where("bit = 1").select("model", F.col("var").alias("o")), ["model", "o"]).select("model", "var", "coeff")
    sums = lin.unionByName(field).groupBy("model", "var").agg(F.sum("coeff").alias("f"))
    return bits.join(sums, ["model", "var"], "left").select("model", "var", ((1 - 2 * F.col("bit")) * F.coalesce("f", F.lit(0.0))).alias("delta"))


def exhaustive_minimum(terms: DataFrame, max_variables: int = 12) -> DataFrame:
    """``model``, ``energy``, ``state`` (bits as a number) of the least energy of every model of at most ``max_variables`` variables, by all states; of equal ones the smallest state."""
    t = terms.groupBy("model").agg(F.collect_list(F.struct("i", "j", "coeff")).alias("t"), (F.max("j") + 1).alias("n")).where(F.col("n") <= max_variables)
    s = t.select("model", "t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), F.col("n")).cast("bigint") - 1)).alias("state"))
    bit = lambda k: F.call_function("getbit", F.col("state"), F.greatest(k, F.lit(0)).cast("int"))
    e = F.aggregate("t", F.lit(0.0), lambda acc, x: acc + F.when(x["i"] < 0, x["coeff"]).otherwise(x["coeff"] * bit(x["i"]) * bit(x["j"])))
    return s.select("model", "state", F.round(e, 9).alias("energy")).groupBy("model").agg(F.min(F.struct("energy", "state")).alias("b")).select("model", "b.energy", "b.state")


def sample_for_order(order: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge variables of a path (``model``, ``node``, ``position``): ``model``, ``var`` (null where the graph lacks the edge), ``left``, ``right``."""
    nxt = order.select("model", (F.col("position") - 1).alias("position"), F.col("node").alias("right"))
    steps = order.select("model", "position", F.col("node").alias("left")).join(nxt, ["model", "position"])
    return steps.join(edges.select("model", "left", "right", "var"), ["model", "left", "right"], "left").select("model", "var", "left", "right")


def degree_conflicts(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per model of selected edges (``model``, ``left``, ``right``): edges, reads entered or left more than once, path starts, and whether one path covers all reads (cycles apart)."""
    i = selected.groupBy("model", F.col("right").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    o = selected.groupBy("model", F.col("left").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    d = nodes.select("model", "node").join(i, ["model", "node"], "left").join(o, ["model", "node"], "left")
    zi, zo = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    g = d.groupBy("model").agg(F.count(F.lit(1)).alias("reads"), F.sum(zo).alias("edges"), F.count_if(zi > 1).alias("entered_twice"), F.count_if(zo > 1).alias("left_twice"), F.count_if(zi == 0).alias("starts"), F.count_if(zo == 0).alias("ends"))
    ok = (F.col("edges") == F.col("reads") - 1) & (F.col("entered_twice") == 0) & (F.col("left_twice") == 0)
    return g.withColumn("valid_degrees", ok)


def position_violations(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per model of set position variables (``model``, ``var``): reads and positions that aren't used exactly once."""
    n = nodes.groupBy("model").agg(F.max("n").alias("n"))
    d = selected.join(n, "model").select("model", "n", F.floor(F.col("var") / F.col("n")).alias("r"), F.pmod(F.col("var"), F.col("n")).alias("p"))
    once = lambda c: d.groupBy("model", c).agg(F.count(F.lit(1)).alias("k")).where("k = 1").groupBy("model").agg(F.count(F.lit(1)).alias(f"one_{c}"))
    j = n.join(once("r"), "model", "left").join(once("p"), "model", "left")
    return j.select("model", (F.col("n") - F.coalesce("one_r", F.lit(0))).alias("reads_violated"), (F.col("n") - F.coalesce("one_p", F.lit(0))).alias("positions_violated"))


def boundary_state_model(states: DataFrame, penalty: float) -> Qubo:
    """One of the states (``model``, ``var``, ``weight``) of every model is chosen: exactly one, with its weight taken off."""
    g = states.select("model", F.lit(0).alias("form"), "var")
    return exactly_one(g, g.select("model", "form").distinct(), penalty).plus(linear_part(states.select("model", "var", (-F.col("weight")).alias("coeff"))))


def macro_edge_model(nodes: DataFrame, edges: DataFrame, ports: DataFrame, penalty: float | None = None) -> Qubo:
    """Path through all reads of a region from its entry to its exit: every read but the entry is entered once, every one but the exit left once; the entry isn't entered, the exit not left.

    ``ports`` has model, entry and exit (numbers of reads). The penalty is by default ``max(10, 4 * sum of absolute rewards + 1)`` of the model. Cycles apart from the path aren't ruled out
    by the terms and must be rejected when samples are decoded.
    """
    sums = edges.groupBy("model").agg(F.sum(F.abs("reward")).alias("s"))
    pen = nodes.select("model").distinct().join(sums, "model", "left").select("model", (F.greatest(F.lit(10.0), 4 * F.coalesce("s", F.lit(0.0)) + 1) if penalty is None else F.lit(penalty)).alias("pen"))
    q = linear_part(edges.select("model", "var", (-F.col("reward")).alias("coeff")))
    p = ports.join(pen, "model")
    for side, port, parity in (("ri", "entry", 0), ("li", "exit", 1)):
        e = edges.select("model", F.col(side).alias("idx"), "var").join(p, "model")
        groups = e.where(F.col("idx") != F.col(port)).select("model", (2 * F.col("idx") + parity).alias("form"), "var", F.lit(-1.0).alias("c"))
        forms = nodes.select("model", "idx").join(p, "model").where(F.col("idx") != F.col(port)).select("model", (2 * F.col("idx") + parity).alias("form"), F.lit(1.0).alias("offset"), "pen")
        q = q.plus(square(groups, forms, F.col("pen"))).plus(linear_part(e.where(F.col("idx") == F.col(port)).select("model", "var", F.col("pen").alias("coeff"))))
    return q


def circle_model(nodes: DataFrame, edges: DataFrame, penalty: float = 100.0, size_reward: float = 1.0, weight_reward: float = 0.1) -> Qubo:
    """Circles through some reads: each read is left as often as it is entered, at most once each; every edge earns ``size_reward`` and its reward times ``weight_reward``, so size comes first."""
    flow = edges.select("model", F.col("ri").alias("form"), "var", F.lit(1.0).alias("c")).unionByName(edges.select("model", F.col("li").alias("form"), "var", F.lit(-1.0).alias("c")))
    q = square(flow, nodes.select("model", F.col("idx").alias("form"), F.lit(0.0).alias("offset")), penalty).plus(_conflicts(edges, penalty))
    return q.plus(linear_part(edges.select("model", "var", (-(size_reward + weight_reward * F.col("reward"))).alias("coeff"))))


def ordered_circle_model(nodes: DataFrame, edges: DataFrame, overlap_reward: float = 0.1) -> Qubo:
    """One circle through the read with number 0 and any others: circles apart from it are ruled out by places that rise along it.

    Every edge earns ``overlap_reward`` times its reward and, for every read it stands for (``size``, 1 without that column), one more than all rewards together, so size comes first. The penalty is one more
    than all earnings. Read 0 is entered and left once, others as often as they are left, at most once; edges that don't leave read 0 have bits of their place, variables ``m + var * bits + b``,
    which only chosen edges may set; what leaves a read stands one behind what enters it. Edges with the same ``child``, where that column is there, exclude each other.
    """
    size = F.col("size") if "size" in edges.columns else F.lit(1)
    lam = F.lit(overlap_reward)
    z = nodes.groupBy("model").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    z = z.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(2), F.col("n")).cast("double")))).cast("bigint"))
    beta = edges.groupBy("model").agg((lam * F.sum(F.abs("reward")) + 1).alias("beta"))
    e = edges.drop("n", "m").withColumn("_size", size).join(beta, "model").withColumn("earn", F.col("beta") * F.col("_size") + lam * F.col("reward"))
    pen = e.groupBy("model").agg(F.greatest(F.lit(1.0), F.sum(F.abs("earn")) + 1).alias("pen"))
    z, _ = materialize(z.join(pen, "model", "left").withColumn("pen", F.coalesce("pen", F.lit(1.0))), "sizes")  # one row per model
    e, _ = materialize(e.join(z, "model"), "edges")
    p = F.col("pen")
    q = linear_part(e.select("model", "var", (-F.col("earn")).alias("coeff")))
    root = e.where("ri = 0").select("model", F.lit(0).alias("form"), "var").unionByName(e.where("li = 0").select("model", F.lit(1).alias("form"), "var")).withColumn("c", F.lit(-1.0))
    q = q.plus(square(root, z.select("model", "pen", F.explode(F.array(F.lit(0), F.lit(1))).alias("form")).withColumn("offset", F.lit(1.0)), p))
    bits = e.where("li <> 0").select("model", "li", "ri", "var", "pen", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bits") - 1)).alias("b"), "m", "bits")
    bits = bits.withColumns({"z": F.col("m") + F.col("var") * F.col("bits") + F.col("b"), "two": F.pow(F.lit(2.0), F.col("b"))})
    q = q.plus(linear_part(bits.select("model", F.col("z").alias("var"), p.alias("coeff")))).plus(quadratic_part(bits.select("model", F.col("var").alias("i"), F.col("z").alias("j"), (-p).alias("coeff"))))
    others = nodes.where("idx <> 0").select("model", F.col("idx").alias("form"), F.lit(0.0).alias("offset")).join(z.select("model", "pen"), "model")
    form = lambda d, end, var, c: d.where(f"{end} <> 0").select("model", F.col(end).alias("form"), F.col(var).alias("var"), c.cast("double").alias("c"))
    flow = form(e, "li", "var", F.lit(1)).unionByName(form(e, "ri", "var", F.lit(-1)))
    order = form(bits, "li", "z", F.col("two")).unionByName(form(e, "ri", "var", F.lit(-1))).unionByName(form(bits, "ri", "z", -F.col("two")))
    for terms in (flow, order):
        q = q.plus(square(terms.groupBy("model", "form", "var").agg(F.sum("c").alias("c")), others, p))
    apart = [e.where("li <> 0").withColumn("k", F.col("li")), e.where("ri <> 0").withColumn("k", F.col("ri"))]
    if "child" in edges.columns:
        apart.append(e.where("child is not null").withColumn("k", F.col("child")))
    for d in apart:
        a, b = d.select("model", "k", F.col("var").alias("i"), "pen"), d.select("model", "k", F.col("var").alias("j"))
        q = q.plus(quadratic_part(a.join(b, ["model", "k"]).where("i < j").select("model", "i", "j", p.alias("coeff"))))
    return q


def order_violations(selected: DataFrame, edges: DataFrame, bits: int) -> DataFrame:
    """Per model of an ordered-path sample: position bits set for edges that aren't selected, and edges whose position isn't one behind that of the edge before.

    ``selected`` has model and var (edges below m, then bits); ``edges`` model, li, ri, var, m.
    """
    m = edges.groupBy("model").agg(F.max("m").alias("m"))
    s = selected.join(m, "model")
    on = s.where(F.col("var") < F.col("m")).select("model", "var").join(edges.select("model", "li", "ri", "var"), ["model", "var"])
    z = s.where((F.col("var") >= F.col("m")) & (F.col("var") < F.col("m") * (1 + bits))).select("model", F.floor((F.col("var") - F.col("m")) / bits).alias("var"), F.pow(F.lit(2.0), (F.col("var") - F.col("m")) % bits).alias("v"))
    ghosts = z.join(on.select("model", "var"), ["model", "var"], "left_anti").groupBy("model").agg(F.count(F.lit(1)).alias("ghost_bits"))
    pos = on.join(z.groupBy("model", "var").agg(F.sum("v").alias("v")), ["model", "var"], "left").select("model", "li", "ri", (1 + F.coalesce("v", F.lit(0.0))).alias("p"))
    before = pos.select("model", F.col("ri").alias("li"), F.col("p").alias("b"))
    wrong = pos.join(before, ["model", "li"]).where("p <> b + 1").groupBy("model").agg(F.count(F.lit(1)).alias("order_violations"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return m.select("model").join(ghosts, "model", "left").join(wrong, "model", "left").select("model", zero("ghost_bits"), zero("order_violations"))
