import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import vafile

SCHEMA = "vec_id long, embedding array<double>, label int"
ODD = [(None, [1.0, 1.0], 1), (9001, [1.0, 1.0], None), (9002, None, 1), (9003, [1.0, None], 1), (9004, [1.0, math.nan], 1), (9005, [math.inf, 1.0], 1), (9006, [1e300, 1.0], 1)]


def plain(rows, anchors, positives, negatives, scale):
    rows = sorted({(i, tuple(math.floor(scale * x) for x in v), y) for i, v, y in rows})
    out = Counter()
    for i, v, y in rows:
        if anchors(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in rows if j != i and len(w) == len(v))
            for p, pid in [(-s, j) for s, j, z in scored if z == y][:positives]:
                fit = [(-s, j) for s, j, z in scored if z != y and 50 * p <= -100 * s <= 95 * p]
                for n, (s, j) in enumerate(fit[:negatives]):
                    out[i, pid, n + 1, j, p, s] += 1
    return out


@pytest.mark.parametrize("shape", ["normal", "copies", "ties"])
def test_plain(spark, shape, monkeypatch):
    monkeypatch.setattr(vafile, "SHARD", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (240, 5)) if shape != "ties" else rng.integers(-1, 2, (240, 5)).astype(float)
    if shape == "copies":  # a third of all rows are one vector
        x[:80] = x[0]
    rows = [(int(i), v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, rng.integers(0, 3, 240)))]
    rows += [rows[7], (500, [1.0, 2.0], 0), (501, [1.0, 2.0], 0), (502, [0.5, 1.0], 1), (503, [], 1)]
    df = spark.createDataFrame(rows + ODD, SCHEMA).withColumn("v", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("dim", F.lit(0))
    got = vafile.hard_negatives(df, F.col("vec_id") % 10 == 0, 5, 3, 256).collect()
    assert Counter(map(tuple, got)) == plain(rows, lambda i: i % 10 == 0, 5, 3, 256)
    assert got


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], SCHEMA)
    assert [tuple(r) for r in vafile.hard_negatives(df, F.col("vec_id") == 0, scale=100).collect()] == [(0, 1, 1, 2, 10000, 9000)]
    assert vafile.hard_negatives(df.where("vec_id < 2"), F.col("vec_id") == 0).collect() == []
    assert vafile.hard_negatives(df.where("vec_id > 5"), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("n", [1, 5, 255, 257, 1000])
def test_bounds_hold(n):
    rng = np.random.default_rng(n)
    v = rng.integers(-300, 300, (n, 7))
    v[:, 3] = 4
    a = vafile.Approximation(v)
    a = vafile.Approximation.read(7, *a.stored())
    for q in rng.integers(-300, 300, (20, 7)):
        least, most = a.bounds(q, 0, n)
        assert (least <= v @ q).all() and (v @ q <= most).all()
    if n >= 255:
        assert (most - least).mean() < 0.2 * np.ptp(v @ q)


def test_windows():
    for p in range(-50, 400):
        lo, hi = vafile.window(p)
        assert [s for s in range(-500, 500) if 50 * p <= 100 * s <= 95 * p] == list(range(lo, hi + 1))
