"""Sequences, alignments, graphs and reports as text rows and files. Every function gives rows of one text column, written in parallel by :func:`write_lines`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import dot_escape, sign_token


def write_lines(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Writes ``line`` to text files; with ``files`` = 1 in the order of the rows."""
    d = rows.select("line")
    (d.coalesce(files) if files else d).write.mode("overwrite").text(path)


def fasta_rows(reads: DataFrame, width: int = 80) -> DataFrame:
    """One row per read: header and sequence in lines of ``width`` letters."""
    n = F.greatest(F.ceil(F.length("seq") / width).cast("int"), F.lit(0))
    wrapped = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("seq"), i * width + 1, F.lit(width))), "\n")).otherwise("")
    return reads.where("rid is not null and seq is not null").select(F.concat(F.lit(">"), "rid", F.lit("\n"), wrapped).alias("line"))


def fastq_rows(reads: DataFrame) -> DataFrame:
    """Four lines per read, with the quality ``I`` throughout."""
    return reads.where("rid is not null and seq is not null").select(F.concat(F.lit("@"), "rid", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq"))).alias("line"))


def paf_rows(edges: DataFrame) -> DataFrame:
    """Edges (left_id, left_len, left_start, ... ) as alignment lines with the tags lo, ro, sh and de."""
    minus = lambda side: F.col(f"{side}_orientation") == -1
    raw = lambda side: (F.when(minus(side), F.col(f"{side}_len") - F.col(f"{side}_end")).otherwise(F.col(f"{side}_start")), F.when(minus(side), F.col(f"{side}_len") - F.col(f"{side}_start")).otherwise(F.col(f"{side}_end")))
    (ls, le), (rs, re) = raw("left"), raw("right")
    strand = F.when(F.col("left_orientation") == F.col("right_orientation"), "+").otherwise("-")
    tags = [F.concat(F.lit("lo:i:"), F.col("left_orientation")), F.concat(F.lit("ro:i:"), F.col("right_orientation")), F.concat(F.lit("sh:i:"), F.col("shift")), F.concat(F.lit("de:f:"), F.format_string("%.9f", F.col("error_rate")))]
    return edges.select(F.concat_ws("\t", "left_id", "left_len", ls, le, strand, "right_id", "right_len", rs, re, "matches", "overlap_len", F.lit(255), *tags).alias("line"))


def gfa_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A header, segments (``node``, ``seq``) and links with the tags OL, SH, NM and ID."""
    head = nodes.sparkSession.range(1).select(F.lit("H\tVN:Z:1.0").alias("line"))
    seg = nodes.select(F.concat_ws("\t", F.lit("S"), "node", F.coalesce("seq", F.lit("*"))).alias("line"))
    link = edges.select(F.concat_ws("\t", F.lit("L"), "left_id", sign_token("left_orientation"), "right_id", sign_token("right_orientation"), F.concat(F.col("overlap_len"), F.lit("M")), F.concat(F.lit("OL:i:"), F.col("overlap_len")), F.concat(F.lit("SH:i:"), F.col("shift")), F.concat(F.lit("NM:i:"), F.col("mismatches")), F.concat(F.lit("ID:f:"), F.format_string("%.12f", F.col("identity")))).alias("line"))
    return head.unionByName(seg).unionByName(link)


def table_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated lines of the columns, nulls empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def dot_rows(edges: DataFrame, name: str = "overlaps", oriented: bool = False, max_edges: int | None = None, highlight: DataFrame | None = None, rankdir: str = "LR") -> DataFrame:
    """A Graphviz graph: ``ord`` and ``line``. Edges have ``reward``, the best first; the pen grows with the reward over the largest, from 1 to 5. ``highlight`` lists edges (source, target) drawn in red.

    Without ``oriented`` the ends are left_id and right_id, else source and target, with the strands in two colours.
    """
    a, b = ("source", "target") if oriented else ("left_id", "right_id")
    e = edges.select(a, b, "reward")
    if max_edges is not None:
        e = e.orderBy(F.desc("reward"), a, b).limit(max_edges)
    top = e.agg(F.max("reward").alias("m")).scalar()
    pen = 1 + 4 * F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reward") / top))).otherwise(0.0)
    colour = F.lit("")
    if highlight is not None:
        e = e.join(highlight.select(a, b).distinct().withColumn("_h", F.lit(True)), [a, b], "left")
        colour = F.when(F.col("_h"), ", color=red").otherwise("")
    arcs = e.select(F.lit(2).alias("ord"), F.concat(F.lit('  "'), dot_escape(a), F.lit('" -> "'), dot_escape(b), F.lit('" [label="'), F.format_string("%.3f", "reward"), F.lit('", penwidth='), F.format_string("%.3f", pen), colour, F.lit("];")).alias("line"))
    nodes = e.select(F.explode(F.array(a, b)).alias("node")).distinct()
    shade = F.when(F.endswith("node", F.lit("-")), ", fillcolor=lightblue").otherwise(", fillcolor=white") if oriented else F.lit("")
    dots = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('  "'), dot_escape("node"), F.lit('" [shape=box'), shade, F.lit("];")).alias("line"))
    one = edges.sparkSession.range(1)
    head = one.select(F.lit(0).alias("ord"), F.lit(f"digraph {name} {{\n  rankdir={rankdir};").alias("line"))
    return head.unionByName(dots).unionByName(arcs).unionByName(one.select(F.lit(3).alias("ord"), F.lit("}").alias("line")))


def graphml_rows(edges: DataFrame) -> DataFrame:
    """A GraphML document of ``source``, ``target`` and ``overlap_len``: ``ord`` and ``line``."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    one = edges.sparkSession.range(1)
    head = one.select(F.lit(0).alias("ord"), F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="o" for="edge" attr.name="overlap" attr.type="long"/>\n<graph edgedefault="directed">').alias("line"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), safe("node"), F.lit('"/>')).alias("line"))
    arcs = edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('"><data key="o">'), F.col("overlap_len").cast("string"), F.lit("</data></edge>")).alias("line"))
    return head.unionByName(nodes).unionByName(arcs).unionByName(one.select(F.lit(3).alias("ord"), F.lit("</graph>\n</graphml>").alias("line")))


def write_windows(edges: DataFrame, path: str) -> None:
    """Edges of windows (``entity``, ``window``, ...), one folder per window."""
    edges.write.mode("overwrite").partitionBy("entity", "window").parquet(path)


def write_window_dataset(windows: DataFrame, edges: DataFrame, sequences: DataFrame, path: str) -> None:
    """Windows of layouts as files: ``graphml`` and ``gfa`` with a folder per entity and window, ``manifest`` with a row per window, and ``wrap`` with the edges round the circle.

    ``windows`` has entity, node, position, window; ``edges`` entity, source, target, overlap_len; ``sequences`` node, seq. The files of a window hold its nodes and the edges within it; the manifest
    counts these, the edges in and out, and gives the first and last position.
    """
    at = lambda x: windows.select("entity", F.col("node").alias(x), F.col("window").alias(f"w{x}"), F.col("position").alias(f"p{x}"))
    e = edges.join(at("source"), ["entity", "source"]).join(at("target"), ["entity", "target"])
    inside = e.where("wsource = wtarget").select("entity", F.col("wsource").alias("window"), "source", "target", "overlap_len")
    n = windows.select("entity", "window", "node", "position")
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    each = n.select("entity", "window").distinct()
    head = each.select("entity", "window", F.lit(0).alias("ord"), F.lit('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="o" for="edge" attr.name="overlap" attr.type="long"/><graph edgedefault="directed">').alias("line"))
    dots = n.select("entity", "window", F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), safe("node"), F.lit('"/>')).alias("line"))
    arcs = inside.select("entity", "window", F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('"><data key="o">'), F.col("overlap_len").cast("string"), F.lit("</data></edge>")).alias("line"))
    foot = each.select("entity", "window", F.lit(3).alias("ord"), F.lit("</graph></graphml>").alias("line"))
    xml = head.unionByName(dots).unionByName(arcs).unionByName(foot)
    ordered = lambda d: d.repartition("entity", "window").sortWithinPartitions("entity", "window", "ord", "line").drop("ord")  # noqa: E731 - one file a window
    ordered(xml).write.mode("overwrite").partitionBy("entity", "window").text(f"{path}/graphml")
    seg = n.join(sequences.select("node", "seq"), "node", "left").select("entity", "window", F.lit(1).alias("ord"), F.concat_ws("\t", F.lit("S"), "node", F.coalesce("seq", F.lit("*"))).alias("line"))
    link = inside.select("entity", "window", F.lit(2).alias("ord"), F.concat_ws("\t", F.lit("L"), F.regexp_replace("source", "[+-]$", ""), F.right("source", F.lit(1)), F.regexp_replace("target", "[+-]$", ""), F.right("target", F.lit(1)), F.concat("overlap_len", F.lit("M"))).alias("line"))
    gfa = each.select("entity", "window", F.lit(0).alias("ord"), F.lit("H\tVN:Z:1.0").alias("line")).unionByName(seg).unionByName(link)
    ordered(gfa).write.mode("overwrite").partitionBy("entity", "window").text(f"{path}/gfa")
    ends = e.where("wsource <> wtarget").select("entity", F.explode(F.array(F.struct(F.col("wsource").alias("window"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("wtarget").alias("window"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    ports = ends.groupBy("entity", "x.window").agg(F.sum("x.i").alias("incoming"), F.sum("x.o").alias("outgoing"))
    core = inside.groupBy("entity", "window").agg(F.count(F.lit(1)).alias("edges"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    m = n.groupBy("entity", "window").agg(F.count(F.lit(1)).alias("nodes"), F.min("position").alias("first"), F.max("position").alias("last")).join(core, ["entity", "window"], "left").join(ports, ["entity", "window"], "left")
    m.select("entity", "window", "nodes", "first", "last", zero("edges"), zero("incoming"), zero("outgoing")).write.mode("overwrite").parquet(f"{path}/manifest")
    e.where("ptarget < psource").select("entity", "source", "target", "overlap_len").write.mode("overwrite").parquet(f"{path}/wrap")


def write_report(df: DataFrame, path: str) -> None:
    """A report as comma-separated files with header."""
    df.write.mode("overwrite").csv(path, header=True)
