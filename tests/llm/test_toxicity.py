import random

from readloom.llm import toxicity


def rows(n, seed=0):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(80)]
    out = []
    for i in range(n):
        w = rng.choices(plain, k=rng.randrange(5, 60))
        y = i % 4 == 0
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(["idiotic", "IDIOTS", "moron"]))
        out.append((i, " ".join(w), y))
    return out


def test_held_out_accuracy(spark, make_docs):
    data = rows(600)
    docs = make_docs([(i, t) for i, t, _ in data])
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in data if i % 5] + [(1, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == y for i, _, y in data if i % 5 == 0]
    assert sum(held) / len(held) > 0.97
    odd = make_docs([(1, None), (2, ""), (None, "moron"), (3, "x " * 100_000), (1, None)])
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(docs, model, keep=docs.columns).columns == [*(c for c in docs.columns if c != "score"), "score"]


def test_interactions_are_learned():
    import numpy as np

    a, b = np.array([1], np.uint64), np.array([2], np.uint64)
    both = np.array([1, 2], np.uint64)
    texts, y = [a, b, both, np.zeros(0, np.uint64)] * 200, np.array([1, 1, 0, 0] * 200, dtype=float)  # additive weights can't tell
    old = toxicity.EPOCHS, toxicity.DECAY
    toxicity.EPOCHS, toxicity.DECAY = 60, 0.0
    try:
        m = toxicity.fit(texts, y)
    finally:
        toxicity.EPOCHS, toxicity.DECAY = old
    p = m.scores([np.array([0]), np.array([1]), np.array([0, 1]), np.zeros(0, np.int64)])
    assert (p.round() == [1, 1, 0, 0]).all(), p


def test_no_labels_and_empty(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(make_docs([(1, "a")]), none)
    assert [r.score for r in toxicity.score(make_docs([(1, "a"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert toxicity.score(make_docs([]), model).collect() == []
