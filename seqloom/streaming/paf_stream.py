"""Alignment records as a stream: the filter chain is stateless and runs unchanged on text that keeps arriving; the best edge of a pair is kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import paf as P
from ..session import new_path


def paf_stream(spark: SparkSession, folder: str, config: P.PafConfig) -> DataFrame:
    """Records with outcomes of the alignment files that appear in a folder; ``line_no`` is a hash of the line, as files have no common order."""
    lines = spark.readStream.schema("value string").text(folder).select(F.xxhash64("value").alias("line_no"), F.col("value").alias("line"))
    return P.with_outcomes(P.parse_paf(lines), config)


def best_edge_stream(records: DataFrame) -> DataFrame:
    """Best match count of every oriented pair so far, one state per pair."""
    return P.direct_edges(P.candidates(records)).groupBy("left_id", "right_id", "left_orientation", "right_orientation").agg(F.max("matches").alias("matches"))


def state_sink(stream: DataFrame, path: str) -> StreamingQuery:
    """Write the states that each micro-batch changed to a table, a folder per batch, until what is there has been read; the latest ``epoch`` of a key is its state."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", new_path(stream.sparkSession, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def outcome_sink(stream: DataFrame, path: str) -> StreamingQuery:
    """Append outcome counts of every micro-batch to a table, each batch once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", new_path(stream.sparkSession, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
