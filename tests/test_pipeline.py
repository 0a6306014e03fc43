from pyspark.sql import functions as F

from seqloom.operators import layout as L
from seqloom.operators import qubo as Q
from seqloom.pipeline import Pipeline
from seqloom.sources import simulate as M


def test_reads_to_layouts(spark):
    g = spark.createDataFrame([("g", 2600, 3)], "genome_id string, length bigint, seed bigint")
    reads = M.simulate_reads(g, M.SimulationConfig(read_len=600, step=400, mismatch_rate=0.0, insertion_rate=0.0, deletion_rate=0.0)).select("rid", "seq", "true_start").persist()
    places = reads.select(F.lit("m").alias("model"), F.concat("rid", F.lit("+")).alias("node"), F.col("true_start").alias("pos"))
    got = Pipeline().layouts(reads, places).collect()
    assert len(got) == 1 and got[0].reads == 6 and sorted(got[0].order) == list(range(6)) and got[0].variables >= 5
    own = Pipeline(build=lambda n, e: Q.edge_path_model(n, e).terms(), solve=lambda n, e, t: L.solve_layouts(n, e, t, "edge_path", "exhaustive"))
    best = own.layouts(reads, places).collect()[0]
    assert best.valid and best.order == list(range(6)) and best.missing == 0
    none = Pipeline(find=lambda r: Pipeline().find(r).limit(0))
    assert none.edges(reads).count() == 0
