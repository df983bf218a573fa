import math
import random

import pytest
from pyspark.sql import functions as F

from readloom.llm import codes


def brute(rows, k):
    rows = sorted({r for r in rows if None not in r})
    out = []
    for q, c in rows:
        if q % 3 == 0:
            far = sorted((bin((c ^ x) % (1 << 64)).count("1"), i) for i, x in rows if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(far)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_like_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(n)]
    rows += [(1000 + i, 77) for i in range(n // 3)] + rows[:2] + [(None, 5), (7000, None)]
    df = spark.createDataFrame(rows, "id long, code long").withColumn("q", F.lit(1)).withColumn("segment", F.lit(1))
    got = codes.top_k(df, F.col("id") % 3 == 0, 4)
    assert sorted((r.query_id, r.rank, r.id, r.distance) for r in got.collect()) == brute(rows, 4)


def test_sign_code(spark):
    df = spark.createDataFrame([([0.5] + [-1.0] * 62 + [2.0],), ([0.0, 1.0],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(codes.sign_code(F.col("v"))).collect()] == [1 - (1 << 63), 2, 0, None]


def test_patterns_are_not_broadcast(spark, monkeypatch):
    """Few queries make many patterns: a broadcast of them filled the driver's memory."""
    plans, cut = {}, codes.Scratch.cut

    def watched(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(self, df, name)

    monkeypatch.setattr(codes.Scratch, "cut", watched)
    rng = random.Random(7)
    rows = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(1500)] + [(5000 + i, 1 << i) for i in range(20)]
    got = codes.top_k(spark.createDataFrame(rows, "id long, code long"), F.col("id") % 3 == 0, 4)
    assert sorted((r.query_id, r.rank, r.id, r.distance) for r in got.collect()) == brute(rows, 4)
    rounds = [p for name, p in plans.items() if name.startswith("best")]
    assert len(rounds) > 2 and not any("Broadcast" in p for p in rounds)


def test_segments_of_least_work():
    """Segments as wide as the binary logarithm of the number of codes made 8248 patterns a query at 51282 codes."""
    for n in (0, 1, 10, 300, 5000, 10256, 51282, 10**8):
        segments = codes._segments(n, 10)
        assert [a for a, _ in segments] + [codes.BITS] == [0] + [a + w for a, w in segments]
        usual = max(2, min(16, round(64 / math.log2(max(16, n)))))
        assert codes._work(len(segments), n, 10)[0] <= codes._work(usual, n, 10)[0] or n < 300
    assert codes._work(4, 51282, 10)[0] == 8248 and codes._work(len(codes._segments(51282, 10)), 51282, 10)[0] < 1000
