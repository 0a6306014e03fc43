"""External aligners: reads go to the program and its records come back through pipes, block by block on the executors."""

from __future__ import annotations

import os
import shutil
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def run_aligner(command: list[str], *inputs: str) -> tuple[list[str], str]:
    """Runs a program with the texts as further arguments, each a pipe of its own; its lines and what it wrote to the error stream. A missing program or an exit code other than 0 raises, with that stream."""
    if shutil.which(command[0]) is None:
        raise RuntimeError(f"cannot find the program {command[0]!r}")
    pipes = [os.pipe() for _ in inputs]
    full = [*command, *(f"/dev/fd/{r}" for r, _ in pipes)]
    p = subprocess.Popen(full, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, pass_fds=[r for r, _ in pipes])

    def feed(fd: int, text: str) -> None:
        try:
            with os.fdopen(fd, "w") as f:
                f.write(text)
        except BrokenPipeError:
            pass  # the program ended early; its exit code tells

    writers = [threading.Thread(target=feed, args=(w, t), daemon=True) for (_, w), t in zip(pipes, inputs)]
    for r, _ in pipes:
        os.close(r)
    for t in writers:
        t.start()
    out, err = p.communicate()
    for t in writers:
        t.join()
    if p.returncode:
        raise RuntimeError(f"{' '.join(full)} ended with {p.returncode}: {err}")
    return out.splitlines(), err


def _fasta(rows: list) -> str:
    return "".join(f">{r['rid']}\n{r['seq']}\n" for r in rows)


def aligned_pairs(reads: DataFrame, program: str = "minimap2", preset: str = "ava-ont", threads: int = 1, extra: tuple[str, ...] = (), block: int = 2000) -> DataFrame:
    """``line_no``, ``line``: alignment records of all reads against all, as an external program gives them for pairs of blocks of about ``block`` reads.

    Null ids and empty sequences are left out. Each pair of blocks is a task that runs ``program -x preset -t threads extra... target query``.
    """
    ship(reads.sparkSession)
    r = reads.where("rid is not null and seq <> ''").select("rid", "seq")
    count = max(1, -(-r.count() // block))
    own = r.withColumn("own", F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int"))
    blocks = own.groupBy("own").agg(F.collect_list(F.struct("rid", "seq")).alias("rows"))  # about ``block`` reads each
    a, b = blocks.select(F.col("own").alias("a"), F.col("rows").alias("target")), blocks.select(F.col("own").alias("b"), F.col("rows").alias("query"))
    pairs = reads.sparkSession.range(count).select(F.col("id").cast("int").alias("a")).withColumn("b", F.explode(F.sequence("a", F.lit(count - 1))))
    jobs = pairs.join(a, "a").join(b, "b").repartition("a", "b")
    command = [program, "-x", preset, "-t", str(threads), *extra]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for j in p.itertuples():
                lines, _ = run_aligner(command, _fasta(j.target), _fasta(j.query))
                first = (int(j.a) * count + int(j.b)) << 32
                yield pd.DataFrame({"line_no": [first + i for i in range(len(lines))], "line": lines})

    return jobs.mapInPandas(run, "line_no bigint, line string")


def mapped_reads(reads: DataFrame, reference: str, program: str = "minimap2", preset: str = "map-ont", circular: bool = True, extra: tuple[str, ...] = ("-c", "--eqx")) -> DataFrame:
    """``line_no``, ``line``: records of reads against a reference, which is given twice in a row if it's circular. The reference, one genome, is sent to every task."""
    ship(reads.sparkSession)
    sent = reads.sparkSession.sparkContext.broadcast(f">reference\n{reference * 2 if circular else reference}\n")
    command = [program, "-x", preset, *extra]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            lines, _ = run_aligner(command, sent.value, _fasta(p.to_dict("records")))
            yield pd.DataFrame({"line": lines})

    found = reads.where("rid is not null and seq <> ''").select("rid", "seq").mapInPandas(run, "line string")
    return found.select(F.monotonically_increasing_id().alias("line_no"), "line")


def key_values(text: str) -> dict[str, str]:
    """Lines of a key, a tab and a value; others are skipped."""
    return dict(line.split("\t", 1) for line in text.splitlines() if "\t" in line)


def edge_block(text: str) -> list[tuple[int, int, int]]:
    """Source, target and overlap of the lines between ``edges_begin`` and ``edges_end``."""
    lines = text.splitlines()
    if "edges_begin" not in lines:
        return []
    lines = lines[lines.index("edges_begin") + 1 :]
    return [tuple(map(int, line.split("\t"))) for line in lines[: lines.index("edges_end") if "edges_end" in lines else None]]
