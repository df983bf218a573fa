import math
from collections import Counter

import pytest

from readloom.llm import mixing


def docs(make_docs):
    rows = [(i, "a b c d e f", "big") for i in range(400)] + [(1000 + i, "a b c " * (i % 5 + 1), "mid") for i in range(60)]
    rows += [(2000 + i, "x y z", "small") for i in range(20)] + [(3000 + i, "q r", None) for i in range(10)]
    return make_docs([*rows, (9000, None, "big"), (10, "", "empty"), (None, "n u l l", "mid"), (None, "n u l l", "mid"), (5000, "w " * 30_000, "long")])


def shares(mixed):
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len((r.text or "").split())
    return got


def test_max_epochs(spark, make_docs):
    d = docs(make_docs)
    mixed = mixing.mix(d, max_epochs=1.5)
    have, got = shares(d), shares(mixed)
    weights = {r.source: r.mix_weight for r in mixed.collect()}
    total = sum(have.values())
    ratio = {s: weights[s] * total / have[s] for s in have if have[s] and s in weights}
    assert max(ratio.values()) == pytest.approx(1.5, abs=1e-6)
    assert sorted(ratio, key=ratio.get) == sorted(ratio, key=lambda s: -have[s])  # smaller sources weigh more
    longest = {"big": 6, "mid": 15, "small": 3, None: 2, "long": 30_000}
    for s in have:
        if have[s]:
            assert weights.get(s, 0) * total - longest[s] <= got[s] <= weights.get(s, 0) * total + 1e-6 or s not in weights
    epochs = Counter((r.doc_id, r.source) for r in mixed.collect() if r.doc_id is not None)
    assert max(epochs.values()) <= 2 and epochs[9000, "big"] == 1 and epochs[10, "empty"] == 1
    assert [c for c in mixed.columns if not c.startswith("mix_")] == d.columns


def test_entropy(spark, make_docs):
    d = docs(make_docs).where("source in ('big', 'mid', 'small')")
    w = {r.source: r.mix_weight for r in mixing.mix(d, entropy=0.8).collect()}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    assert sum(w.values()) == pytest.approx(1)


def test_documents_without_id(spark, make_docs):
    d = make_docs([(None, f"w{i} x y z", "a") for i in range(300)] + [(i, f"v{i}", "b") for i in range(20)])
    mixed = mixing.mix(d, max_epochs=1.5, budget=600.0)
    weight = {r.source: r.mix_weight for r in mixed.select("source", "mix_weight").distinct().collect()}
    got = shares(mixed)
    assert 600 * weight["a"] - 4 <= got["a"] <= 600 * weight["a"] + 1e-6  # one by one, not all or none


def test_bounds(spark, make_docs):
    d = docs(make_docs)
    with pytest.raises(ValueError):
        mixing.mix(d)
    with pytest.raises(ValueError):
        mixing.mix(d, max_epochs=1.0, budget=1e9)
    assert mixing.mix(make_docs([]), max_epochs=2.0).collect() == []
    assert mixing.mix(make_docs([(1, None), (2, " ")]), max_epochs=2.0).count() == 2
