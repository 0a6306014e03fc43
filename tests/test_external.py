import os
import stat

import pytest
from conftest import rows

from seqloom.sources import external as X


def program(tmp_path, body):
    path = tmp_path / "aligner"
    path.write_text("#!/bin/sh\n" + body)
    os.chmod(path, os.stat(path).st_mode | stat.S_IEXEC)
    return str(path)


def test_blocks_of_reads(spark, tmp_path):
    fake = program(tmp_path, 'shift 4\nT=$(grep ">" $1); Q=$(grep ">" $2)\nfor t in $T; do for q in $Q; do echo "$q $t"; done; done\n')
    reads = spark.createDataFrame([(f"r{i}", "ACGT" * (i + 1)) for i in range(9)] + [(None, "A"), ("e", "")], "rid string, seq string")
    got = X.aligned_pairs(reads, fake, block=4)
    pairs = {tuple(sorted(line.replace(">", "").split())) for _, line in rows(got, "line_no", "line")}
    assert len(pairs) == 9 * 10 // 2
    count = program(tmp_path, 'echo "$(grep -c ACGACG $5) $(grep -c ">" $6)"\n')
    mapped = [x.line.split() for x in X.mapped_reads(reads, "ACG", count).collect()]
    assert sum(int(q) for _, q in mapped) == 9 and {t for t, _ in mapped} == {"1"}


def test_failures(tmp_path):
    with pytest.raises(RuntimeError, match="cannot find"):
        X.run_aligner(["no-such-program"], "x")
    with pytest.raises(RuntimeError, match="broken"):
        X.run_aligner([program(tmp_path, "echo broken >&2\nexit 3\n")], "x" * 1_000_000)


def test_parsing():
    assert X.key_values("a\t1\n\nb\tx\ty\nnone\n") == {"a": "1", "b": "x\ty"}
    assert X.edge_block("k\tv\nedges_begin\n1\t2\t30\n2\t3\t40\nedges_end\n9\t9\t9\n") == [(1, 2, 30), (2, 3, 40)] and X.edge_block("") == []
