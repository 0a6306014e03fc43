import random
import re

from seqloom.operators import overlap as O


def test_ungapped_overlaps_against_all_shifts(spark):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(1500))
    back = str.maketrans("ACGTN", "TGCAN")
    reads = []
    for i in range(40):
        a = rng.randrange(1100)
        s = [c if rng.random() > 0.012 else rng.choice("ACGT") for c in genome[a : a + rng.randrange(150, 400)]]
        s = "".join("N" if i % 9 == 4 and 40 <= p < 75 else c for p, c in enumerate(s))
        reads.append((f"r{i:02d}", s if i % 2 else s.translate(back)[::-1]))
    want = {}
    for x, u in reads:
        for y, v0 in reads:
            for o, v in ((1, v0), (-1, v0.translate(back)[::-1])):
                for n in range(100, min(len(u), len(v)) + 1):
                    m = sum(p == q for p, q in zip(u[len(u) - n :], v))
                    if x != y and m >= n * 0.97 - 1e-9:
                        want[x, y] = max(want.get((x, y), (0, 0, 0, 0)), (m / n, n, o, m))
    r = spark.createDataFrame(reads, "rid string, seq string")
    got = O.ungapped_overlaps(r, 100, 0.97, strands=True)
    found = {(g.left_id, g.right_id): (g.matches / g.overlap, g.overlap, g.orientation, g.matches) for g in got.collect()}
    assert found == want and len(want) > 50
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"seeds#\w+ >= least#", plan)  # chance hits go before any sequence is fetched
