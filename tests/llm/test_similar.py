import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from readloom.llm import similar


def jaccard(a, b):
    x, y = (set(zip(*(w[i:] for i in range(5)))) if len(w := t.lower().split()) > 4 else {tuple(t.lower().split())} for t in (a or "", b or ""))
    return len(x & y) / len(x | y)


def kept(rows):
    comp = {d: d for d, _ in rows}
    near = [(d, e) for (d, a), (e, b) in itertools.combinations(rows, 2) if jaccard(a, b) >= 0.8]
    for _ in rows:
        for d, e in near:
            comp[d] = comp[e] = min(comp[d], comp[e])
    return {d for d, c in comp.items() if d == c}


def texts():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, "a b c d e"), (6, "a b c d f")]
    passage = " ".join(f"p{i}" for i in range(60))
    for g in range(12):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(150)]
        for k in range(6):  # 0 to 5 words changed: the similarity falls from 1 to 0.7
            w = list(base)
            for at in rng.sample(range(0, 150, 6), k):
                w[at] = f"x{rng.random()}"
            rows.append((100 + 10 * g + k, " ".join(w)))
        rows.append((1000 + g, passage + " " + " ".join(f"own{g}-{i}" for i in range(40))))
    # One hub: each differs from the first a little, and two far ends that only a middle one connects.
    hub = [f"h{i}" for i in range(200)]
    rows += [(2000 + k, " ".join(hub[k:] + [f"t{i}" for i in range(k)])) for k in range(0, 60, 3)]
    return rows


def test_keep_one_like_brute_force(spark, make_docs):
    rows = texts()
    got = similar.keep_one(make_docs(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(kept(rows))


def test_pipeline_stage_keeps_no_near_copy(spark, make_docs):
    rows = texts()
    ids = {r.doc_id for r in P.dedup_stage(spark, make_docs(rows), "").collect()}
    left = [(d, t) for d, t in rows if d in ids]
    assert not [1 for (_, a), (_, b) in itertools.combinations(left, 2) if jaccard(a, b) >= 0.8]
    assert ids == kept(rows)


def test_one_changed_stretch(spark, make_docs):
    """Pairs that differ in one stretch, of a similarity of 0.8 or somewhat more: replaced, put in or left out."""
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(240):
        n = rng.randrange(30, 400)
        w = [f"s{i}-{rng.randrange(4 * n)}" for _ in range(n)]
        size, kind = max(1, int(n * rng.uniform(0.02, 0.1)) - 4), i % 3
        at = rng.randrange(0, n - size)
        new = [f"n{i}-{k}" for k in range(size)] if kind < 2 else []
        x = w[:at] + new + w[at + (size if kind != 1 else 0) :]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
        if jaccard(" ".join(w), " ".join(x)) >= 0.8:
            pairs.append(i)
    component = {r.doc_id: r.component_id for r in similar.groups(make_docs(rows)).collect()}
    found = [component[2 * i] == component[2 * i + 1] for i in pairs]
    assert len(pairs) > 180 and sum(found) >= 0.98 * len(found)
    assert all(component[2 * i + 1] == 2 * i + 1 for i in range(240) if i not in pairs)


def test_rows_of_one_doc_id(spark, make_docs):
    """Texts are told apart, not ids: what has no copy stays, and of rows that agree in both one stays."""
    base, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    keep = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in similar.keep_one(make_docs(rows)).collect())
    assert keep([(1, base), (5, base), (5, other)]) == [(False, 1, base), (False, 5, other)]
    assert keep([(5, base), (5, other), (5, other, "t"), (5, other, "s")]) == [(False, 5, base), (False, 5, other)]
    assert keep([(None, base), (7, base), (None, other), (None, other)]) == [(False, 7, base), (True, 0, other)]
    first = similar.keep_one(make_docs([(5, other, "t"), (5, other, "s")])).collect()
    assert [r.source for r in first] == ["s"]


def test_parts():
    for n in range(0, 3000, 7):
        sizes = similar.part_sizes(n)
        assert len(sizes) <= 2 and all(s <= similar.PART * n for _, s in sizes)
        if n * similar.PART >= 10:
            assert len(sizes) == 2 and (sizes[-1][1] + 1) * similar.GRID > similar.PART * n
            # Texts of nearly one length share a size.
            assert {x for x, _ in sizes} & {x for x, _ in similar.part_sizes(int(n * 1.11))}


def test_sketches_leave_out_no_near_pair(spark):
    """Sets of all sizes, those with sketches of two sizes included: none of 0.8 or more is sorted out, and few below 0.7 pass."""
    rng = np.random.default_rng(4)
    rows, near = [], {}
    for i, n in enumerate([1, 5, 40, 500, 1000, 1900, 2040, 2048, 2100, 4090, 4096, 9000] * 20):
        share = rng.choice([0.0, 0.05, 0.1, 0.11, 0.112, 0.15, 0.3])
        x = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64))
        same = x[: len(x) - int(share * len(x))]
        y = np.unique(np.concatenate([same, rng.integers(0, 1 << 63, size=int(share * len(x)) + int(rng.integers(0, 3)), dtype=np.uint64)]))
        near[i] = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        sketches = [np.packbits(similar.parity_sketch(s).astype(bool), bitorder="little").view("<i8").tolist() for s in (x, y)]
        rows.append((i, len(x), len(y), *sketches))
    df = spark.createDataFrame(rows, "i int, nx int, ny int, sx array<long>, sy array<long>")
    passed = {r.i for r in df.where(similar._may_be_near(0.8)).select("i").collect()}
    assert {len(r[3]) != len(r[4]) for r in rows} == {True, False}
    assert {i for i, s in near.items() if s >= 0.8} <= passed and not [i for i in passed if near[i] < 0.7]
    widest = df.select(F.max(F.size("sy"))).first()[0]
    assert widest == 256


def test_empty(spark, make_docs):
    assert similar.keep_one(make_docs([])).collect() == []
