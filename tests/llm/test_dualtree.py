import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from readloom.llm import dualtree

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, scale, seed):
    """Exact integers throughout, one vector after another."""
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        best = [min((far(v, x), j) for j, x in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, at) in zip(kept, best) if at == j]
                if own:
                    c[j] = tuple(sum(x) // len(own) for x in zip(*own))
    part = Counter()
    for d, j in best:
        part[j] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, j, d, part[j], sum(part.values()), sha[j]) for (i, _), (d, j) in zip(kept, best))


def odd(dim):
    good = [1.0] * (dim - 1)
    return [(9001, None), (9002, []), (9003, good), (9004, [*good, math.nan]), (9005, [*good, None]), (9006, [*good, math.inf]), (9007, [*good, 1e300])]


@pytest.mark.parametrize("shape", ["clustered", "copies", "grid"])
def test_plain(spark, shape):
    rng = np.random.default_rng(5)
    if shape == "clustered":
        x = np.repeat(rng.normal(0, 3, (12, 6)), 25, axis=0) + rng.normal(0, 0.05, (300, 6))
    elif shape == "copies":  # a third of all rows are one vector
        x = np.concatenate([np.tile(rng.normal(0, 1, 6), (100, 1)), rng.normal(0, 1, (200, 6))])
    else:  # many ties
        x = rng.integers(0, 2, (300, 6)).astype(float)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (None, x[5].tolist())]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows + odd(6), SCHEMA).withColumn("v", F.lit("x")).withColumn("cluster", F.lit("x"))
    got = dualtree.lloyd(df, k=8, rounds=4, dim=6, scale=1024, seed=3)
    assert Counter(map(tuple, got.collect())) == plain(rows, 8, 4, 1024, 3)


def test_few_and_none(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, -2.5])], SCHEMA)
    got = {r.vec_id: r for r in dualtree.lloyd(two, k=8, rounds=2, dim=2, scale=1).collect()}
    assert {r.distance for r in got.values()} == {0} and got[1].cluster != got[2].cluster and got[2].inertia == 0
    assert dualtree.lloyd(two.where("vec_id = 5"), dim=2).collect() == []
    assert dualtree.lloyd(two, dim=3).collect() == []


@pytest.mark.parametrize("n", [1, 24, 25, 400])
def test_cover_tree(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-50, 50, (n, 3))
    t = dualtree.CoverTree(np.concatenate([x, x[: n // 2]]))
    v = np.concatenate([x, x[: n // 2]])[t.order].astype(float)
    assert sorted(t.order) == list(range(len(v))) and t.hi[0] == len(v)
    for i in range(len(t.center)):
        far = np.sqrt(((v[t.lo[i] : t.hi[i]] - v[t.center[i]]) ** 2).sum(axis=1))
        assert abs(far.max() - t.radius[i]) < 1e-9 and t.lo[i] <= t.center[i] < t.hi[i]
        kids = list(t.children(i))
        assert sum(t.hi[c] - t.lo[c] for c in kids) + t.own[i] - t.lo[i] == t.hi[i] - t.lo[i]
        for c in kids:
            assert t.radius[c] <= t.radius[i] / dualtree.BASE + 1e-9
        centers = v[t.center[kids]]
        apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))[np.triu_indices(len(kids), 1)]
        assert (apart > t.radius[i] / dualtree.BASE).all()


def test_nodes_are_pruned():
    """Vectors in tight clusters are assigned by whole nodes."""
    rng = np.random.default_rng(1)
    x = np.rint(np.repeat(rng.normal(0, 4000, (8, 16)), 200, axis=0) + rng.normal(0, 5, (1600, 16))).astype(np.int64)
    tree = dualtree.CoverTree(x)
    found = list(dualtree.Centroids(x[::200]).nearest(dualtree.Block(x[tree.order], tree)))
    assert sum(hi - lo for lo, hi, at in found if isinstance(at, int)) == len(x)
