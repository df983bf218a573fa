import math

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import forest


def rows():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).round(3)
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(1000 + i, x[7].tolist()) for i in range(200)] + [out[3]]  # copies; a repeated row
    return out, [(5001, None), (5010, []), (5020, [0.0] * 16), (5030, [math.nan] * 16), (5040, [1.0, None]), (5050, [math.inf] * 16), (None, [1.0] * 16), (5060, [1.0, 2.0])]


def test_exact_where_all_are_reached(spark):
    good, odd = rows()
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rep", F.lit(1))
    got = forest.nearest(df, F.col("vec_id") % 10 == 0, 10, trees=8, budget=10**6).collect()
    ids, x = np.array([i for i, _ in good[:-1]]), np.array([v for _, v in good[:-1]])
    want = []
    for i in np.flatnonzero(ids % 10 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        far[i] = np.inf
        want += [(ids[i], r + 1, ids[j]) for r, j in enumerate(np.lexsort((ids, far))[:10])]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(want)


def test_recall(spark):
    good, _ = rows()
    df = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    exact = {(r.query_id, r.vec_id) for r in forest.nearest(df, F.col("vec_id") % 10 == 0, trees=4, budget=10**6).collect()}
    some = {(r.query_id, r.vec_id) for r in forest.nearest(df, F.col("vec_id") % 10 == 0, trees=32, budget=600).collect()}
    assert len(exact & some) / len(exact) > 0.9


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in forest.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 3, 2.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.nearest(none, F.col("vec_id") == 0).collect() == []
