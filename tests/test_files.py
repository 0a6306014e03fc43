import pytest
from conftest import rows

from seqloom.operators import overlap as O
from seqloom.operators import paf as P
from seqloom.operators.ranking import entity_rank, global_rank
from seqloom.sources import files as R
from seqloom.sources import simulate as M
from seqloom.sources import sinks as W
from seqloom.streaming import paf_stream as S


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fastq(spark, tmp_path):
    p = write(tmp_path, "a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+r2\n@@\n")
    assert rows(R.read_fastq(spark, p), "rid", "seq") == [("r1", "ACGT"), ("r2", "GG")]
    assert R.read_fastq(spark, p, max_reads=1).count() == 1
    for bad in ("r1\nAC\n+\nII\n", "@r\nAC\nII\nII\n", "@r\nACG\n+\nII\n"):
        with pytest.raises(Exception, match="malformed"):
            R.read_fastq(spark, write(tmp_path, "b.fq", bad)).collect()


def test_fasta(spark, tmp_path):
    assert rows(R.read_fasta(spark, write(tmp_path, "a.fa", ">r1 x\nACG\nTT\r\n>r2\nGG\n\n>r3\n"))) == [("r1", "ACGTT"), ("r2", "GG"), ("r3", "")]
    with pytest.raises(Exception, match="repeated"):
        R.read_fasta(spark, write(tmp_path, "b.fa", ">r\nA\n>r\nC\n")).collect()
    with pytest.raises(Exception, match="before"):
        R.read_fasta(spark, write(tmp_path, "c.fa", "ACG\n>r\nC\n")).collect()
    assert R.read_reference(spark, write(tmp_path, "d.fa", ">x\nac\nGT\n")) == "ACGT"
    with pytest.raises(ValueError):
        R.read_reference(spark, write(tmp_path, "e.fa", ">x\n"))


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    p = write(tmp_path, "a.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert all(r.line == f"line {r.line_no}" for r in R.numbered_lines(spark, p).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gfa_with_rows(spark, tmp_path):
    g = write(tmp_path, "a.gfa", "H\tVN:Z:1.0\nS\ta\tACGT\tLN:i:4\nL\ta\t+\tb\t-\t3M\tL1:i:2\nL\tb\t+\ta\t+\t2M\n")
    seg, links = R.read_gfa(spark, g)
    assert rows(seg, "segment", "seq") == [("a", "ACGT")] and rows(links, "link_no", "source", "target", "overlap") == [(0, "a", "b", "3M"), (1, "b", "a", "2M")]
    rec = lambda q, s, t: "\t".join(map(str, (q, 9, 0, 3, s, t, 9, 0, 3, 3, 3, 60)))
    good = P.parse_paf(R.read_paf_lines(spark, write(tmp_path, "a.paf", rec("a", "-", "b") + "\n" + rec("b", "+", "a") + "\n")))
    assert R.join_gfa_paf(links, good).count() == 2
    bad = P.parse_paf(R.read_paf_lines(spark, write(tmp_path, "b.paf", rec("a", "-", "b") + "\n")))
    with pytest.raises(Exception, match="don't match"):
        R.join_gfa_paf(links, bad).collect()


def test_graph_tables(spark, tmp_path):
    head = "\t".join(c.split()[0] for c in R.EDGES_TSV.split(", ")) + "\n"
    n = write(tmp_path, "n.tsv", "reference_index\tnode\tread_id\tselected_sign\tlength\tstart\tend\n0\ta+\ta\t+\t9\t0\t9\n")
    row = lambda w: f"a+\tb+\t{w}\t0\t1\t100\t1\t0.99\t101\t99\t1\n"
    assert R.read_graph(spark, n, write(tmp_path, "e.tsv", head + row(51)))[1].count() == 1
    with pytest.raises(Exception, match="weight"):
        R.read_graph(spark, n, write(tmp_path, "f.tsv", head + row(50)))[1].collect()
    with pytest.raises(Exception, match="repeated"):
        R.read_graph(spark, n, write(tmp_path, "g.tsv", head + row(51) + row(51)))[1].collect()


def test_wrapping_and_dot(spark):
    d = spark.createDataFrame([("r", "A" * 170), ("e", "")], "rid string, seq string")
    lines = dict(x.line.split("\n", 1) for x in W.fasta_rows(d).collect())
    assert [len(x) for x in lines[">r"].split("\n")] == [80, 80, 10] and lines[">e"] == ""
    e = spark.createDataFrame([('a"', "b", 2.0), ("b", "c", 1.0)], "left_id string, right_id string, reward double")
    out = [r.line for r in W.dot_rows(e, max_edges=1).orderBy("ord").collect()]
    assert out[0].startswith("digraph") and out[-1] == "}" and sum("->" in x for x in out) == 1 and any('a\\"' in x and "penwidth=5.000" in x for x in out)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rec = "\t".join(map(str, ("a", 1000, 400, 1000, "+", "b", 1000, 0, 600, 590, 600, 60)))
    write(tmp_path / "in", "a.paf", rec + "\nshort\n")
    S.state_sink(S.best_edge_stream(S.paf_stream(spark, str(tmp_path / "in"), P.PafConfig())), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "left_id", "right_id", "matches", "epoch") == [("a", "b", 590, 0)]


def test_ranks(spark):
    d = spark.createDataFrame([("hot" if i % 3 else "b", (i * 37) % 101, i) for i in range(120)], "e string, p bigint, k bigint")
    got = {(r.e, r.p, r.k): r["rank"] for r in entity_rank(d, ["e"], "p", ["k"], width=8).collect()}
    for e in ("hot", "b"):
        own = sorted(x for x in got if x[0] == e)
        assert [got[x] for x in own] == list(range(len(own)))
    from pyspark.sql import functions as F

    g = global_rank(d, [F.col("p"), F.col("k")]).collect()
    assert [r["rank"] for r in sorted(g, key=lambda r: (r.p, r.k))] == list(range(120))


def test_simulation(spark):
    g = spark.createDataFrame([("g", 10_000, 5)], "genome_id string, length bigint, seed bigint")
    c = M.SimulationConfig(read_len=2000, step=1000)
    r = M.fixed_layout(g, c).orderBy("true_start").collect()
    assert [x.true_start for x in r] == list(range(0, 9000, 1000)) and r[-1].true_end == 10_000
    a, b = (rows(M.simulate_reads(g, c), "rid", "seq") for _ in range(2))
    assert a == b and len(a) == 9
    for x in M.simulate_reads(g, c).collect():
        assert len(x.seq) == len(x.ref_coords) and [v for v in x.ref_coords if v >= 0] == sorted(v for v in x.ref_coords if v >= 0)
    with pytest.raises(ValueError):
        M.SimulationConfig(mismatch_rate=2).check()


def test_overlaps_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    seqs = {f"r{i:02}": genome[s : s + 90] for i, s in enumerate(rng.sample(range(310), 24))}
    seqs["dup"] = seqs["r00"]
    reads = spark.createDataFrame(list(seqs.items()), "rid string, seq string")
    classes = {}
    for rid in sorted(seqs):
        classes.setdefault(seqs[rid], rid)
    want = []
    for s, a in classes.items():
        for t, b in classes.items():
            best = max((n for n in range(30, 91) if a != b and s[-n:] == t[:n]), default=0)
            if best:
                want.append((a, b, best))
    assert rows(O.exact_overlaps(reads, 30), "src", "dst", "overlap") == sorted(want, key=repr)
    noisy = {k: "".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in v) for k, v in seqs.items()}
    got = {(r.left_id, r.right_id): (r.overlap, r.matches) for r in O.ungapped_overlaps(spark.createDataFrame(list(noisy.items()), "rid string, seq string"), 40, 0.96, k=9, w=6).collect()}
    want = {}
    for a, s in noisy.items():
        for b, t in noisy.items():
            if a != b:
                best = max(((m / n, n, m) for n in range(40, len(s) + 1) if n <= len(t) and (m := sum(x == y for x, y in zip(s[len(s) - n :], t)))/ n >= 0.96), default=None)
                if best:
                    want[a, b] = best[1:]
    assert got == want
    with pytest.raises(ValueError):
        O.ungapped_overlaps(reads, 40, 0.5)
