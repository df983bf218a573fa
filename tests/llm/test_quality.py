import numpy as np
from pyspark.sql import functions as F

from readloom.llm import quality, registry


def corpus(n=400, junk=0.25):
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        bad = rng.random() < junk
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(int(rng.integers(20, 60)))]
        out.append((i, " ".join(f"{w}###" for w in words) if bad else " ".join(words) + ".", not bad))
    return out


def test_positives_and_unlabelled_only(spark, make_docs):
    rows = corpus()
    docs = make_docs([(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (9001, "word " * 300_000), (0, rows[0][1])])
    known = spark.createDataFrame([(i,) for i, _, good in rows if good and i % 3 == 0] + [(None,), (3,), (3,)], "doc_id long")
    got = quality.classify(docs, known, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows) + 4 and {"doc_id", "score"} == set(got[0].asDict())
    by = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in by.values())
    held = [(by[i] >= 0.5) == good for i, _, good in rows if i % 5 == 0]
    assert np.mean(held) >= 0.95


def test_none(spark, make_docs):
    no = spark.createDataFrame([], "doc_id long")
    assert quality.classify(make_docs([]), no, F.lit(True)).collect() == []
    assert [r.score for r in quality.classify(make_docs([(1, "a b"), (2, None)]), no, F.lit(True)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1,)], "doc_id long")
    assert all(0 <= r.score <= 1 for r in quality.classify(make_docs([(1, "a b"), (2, None)]), one, F.lit(True)).collect())


def test_class_prior():
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.7, 0.9):
        good, bad = rng.normal(1.5, 1, 60000), rng.normal(-1.5, 1, 60000)
        every = np.where(rng.random(60000) < prior, rng.normal(1.5, 1, 60000), bad)
        count = [np.histogram(1 / (1 + np.exp(-x)), quality.SCORES, (0, 1))[0] for x in (good, every)]
        assert abs(quality.best_bin(*count) - prior) < 0.06
    assert 0.01 <= quality.best_bin(np.zeros(5), np.zeros(5)) <= 0.99


def test_negative_risk_is_raised():
    """Where the risk of negatives is below 0, the gradient is turned."""
    x = np.zeros(3 + 2 * quality.SIZE + quality.SIZE**2)
    p, u = quality._Parts(x), quality._Parts(x)
    p.loss_up, p.loss_down, u.loss_down = 0.1, 3.0, 0.5
    p.scored, u.scored = np.full(quality.SIZE, 0.9), np.full(quality.SIZE, 0.2)
    value, gradient, _ = quality._non_negative(0.8)(p, u)
    assert np.isclose(value, 0.08) and np.allclose(gradient, -(0.2 - 0.8 * 0.9))
    u.loss_down = 3.0
    value, gradient, _ = quality._non_negative(0.8)(p, u)
    assert np.isclose(value, 0.08 + 3.0 - 2.4) and np.allclose(gradient, 0.2 - 0.8 * p.bins)


def test_registered(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = registry.op11_quality(spark, d)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == 1 for r in held if r.quality == 1]) > 0.95
    assert np.mean([r.predicted == 0 for r in held if r.quality == 0]) > 0.8
