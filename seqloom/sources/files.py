"""Sequence, alignment and graph files as DataFrames.

Text files are read in splits; lines get their number in the file from the split's place and their place in the split, so four-line records and row-aligned files
work however the files are cut. Compressed files are one split each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import tag_map

READS = "rid string, seq string, true_start bigint, true_end bigint, strand int, ref_coords array<bigint>"
NODES_TSV = "reference_index bigint, node string, read_id string, selected_sign string, length bigint, start bigint, end bigint"
EDGES_TSV = (
    "source string, target string, weight bigint, raw_quality_margin bigint, weight_divisor bigint, matching_bases bigint, errors bigint, identity double, "
    "alignment_block bigint, overlap_span bigint, paf_line bigint"
)


def numbered_lines(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """``file``, ``line_no`` (from 0 in each file, or ``through`` all files in the order of their names) and ``line``, without carriage returns."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    blocks = d.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # one row per split
    up = (Window.orderBy("file", "_block") if through else Window.partitionBy("file").orderBy("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    return d.join(blocks, ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"), "line")


def _as_reads(df: DataFrame) -> DataFrame:
    unknown = F.lit(-1).cast("bigint")
    return df.select("rid", "seq", unknown.alias("true_start"), unknown.alias("true_end"), F.lit(1).alias("strand"), F.lit(None).cast("array<bigint>").alias("ref_coords"))


def read_fastq(spark: SparkSession, path: str, max_reads: int | None = None) -> DataFrame:
    """Reads of FASTQ files, plain or compressed; qualities are dropped, the id is the first word behind ``@``.

    A record without ``@`` or ``+``, or with sequence and qualities of different lengths, fails the query. ``max_reads`` takes the first records of each file.
    """
    lines = numbered_lines(spark, path)
    rec = F.floor(F.col("line_no") / 4)
    if max_reads is not None:
        lines = lines.where(rec < max_reads)
    at = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("line"))).alias(f"l{k}")
    g = lines.groupBy("file", rec.alias("record")).agg(*[at(k) for k in range(4)])
    g = g.where("not (l0 = '' and coalesce(l1, '') = '' and coalesce(l2, '') = '')")
    bad = ~F.startswith("l0", F.lit("@")) | F.coalesce(~F.startswith("l2", F.lit("+")), F.lit(True)) | F.coalesce(F.length("l1") != F.length("l3"), F.lit(True))
    rid = F.regexp_extract("l0", r"^@(\S*)", 1)
    return _as_reads(g.select(F.when(bad, F.raise_error(F.concat(F.lit("malformed FASTQ record "), F.col("record").cast("string")))).otherwise(rid).alias("rid"), F.col("l1").alias("seq")))


def read_fasta(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """``rid`` and ``seq`` of FASTA files: lines of a record are joined. Text before the first header fails the query, and so do repeated ids if ``unique``."""
    d = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("v"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    d = d.where(F.trim("v") != "")
    headless = (F.col("b") == 0) & ~F.startswith("v", F.lit(">")) & (F.col("i") == 0)
    body = F.regexp_replace("v", "^>", "")
    d = d.select(F.when(headless, F.raise_error(F.lit("sequence before the first FASTA header"))).otherwise(F.regexp_extract(body, r"^(\S*)", 1)).alias("rid"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    if not unique:
        return d
    g = d.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.any_value("seq").alias("seq"))
    return g.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated FASTA id "), "rid"))).otherwise(F.col("rid")).alias("rid"), "seq")


def read_reference(spark: SparkSession, path: str) -> str:
    """All sequence of a FASTA or plain file joined, in upper case; an empty one raises. Meant for one reference genome, which must fit the driver."""
    lines = numbered_lines(spark, path).where("line not like '>%'").orderBy("file", "line_no").toLocalIterator()
    seq = "".join("".join(r.line.split()) for r in lines).upper()
    if not seq:
        raise ValueError(f"no sequence in {path}")
    return seq


def read_paf_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` and ``line`` of alignment files, for :func:`seqloom.operators.paf.parse_paf`."""
    return numbered_lines(spark, path, True).select("line_no", "line")


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (``segment``, ``seq``, ``tags``) and links (``link_no``, ``source``, ``source_sign``, ``target``, ``target_sign``, ``overlap``, ``tags``) of a GFA file, links numbered from 0 in their order."""
    d = numbered_lines(spark, path, True).withColumn("f", F.split("line", "\t"))
    rest = lambda k: tag_map(F.slice("f", F.lit(k), F.greatest(F.size("f") - k + 1, F.lit(0))))
    seg = d.where(F.col("f")[0] == "S").select(F.col("f")[1].alias("segment"), F.col("f")[2].alias("seq"), rest(4).alias("tags"))
    links = d.where(F.col("f")[0] == "L").select("line_no", F.col("f")[1].alias("source"), F.col("f")[2].alias("source_sign"), F.col("f")[3].alias("target"), F.col("f")[4].alias("target_sign"), F.col("f")[5].alias("overlap"), rest(7).alias("tags"))
    from ..operators.ranking import global_rank

    return seg, global_rank(links, [F.col("line_no")], "link_no").drop("line_no")


def join_gfa_paf(links: DataFrame, paf: DataFrame) -> DataFrame:
    """Links with the alignment record of the same row; different counts or names fail the query. ``paf`` has line_no, q_id, t_id and strand."""
    j = links.join(paf, F.col("link_no") == F.col("line_no"), "full_outer")
    same = (F.col("source") == F.col("q_id")) & (F.col("target") == F.col("t_id")) & ((F.col("source_sign") == F.col("target_sign")) == (F.col("strand") == "+"))
    return j.withColumn("source", F.when(F.coalesce(same, F.lit(False)), F.col("source")).otherwise(F.raise_error(F.lit("graph and alignment rows don't match"))))


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str, match_weight: int = 1, error_weight: int = 49) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables (tab-separated, with header); an edge whose weight isn't ``matches - 49 errors`` or that occurs twice fails the query."""
    nodes = spark.read.csv(nodes_path, sep="\t", header=True, schema=NODES_TSV)
    edges = spark.read.csv(edges_path, sep="\t", header=True, schema=EDGES_TSV)
    n = F.count(F.lit(1)).over(Window.partitionBy("source", "target"))
    wrong = F.col("weight") * F.coalesce("weight_divisor", F.lit(1)) != F.col("matching_bases") * match_weight - F.col("errors") * error_weight
    plain = F.col("weight") != F.col("matching_bases") * match_weight - F.col("errors") * error_weight
    checked = edges.withColumn("source", F.when(n > 1, F.raise_error(F.lit("repeated edge"))).when(wrong & plain, F.raise_error(F.lit("weight doesn't follow from matches and errors"))).otherwise(F.col("source")))
    return nodes, checked


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with header."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``file`` and ``text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
