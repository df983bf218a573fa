import itertools
import random

import xxhash
from pyspark.sql import functions as F

from readloom.llm import simhash

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))
    while True:
        new = list(comp)
        for i, j in itertools.combinations(range(len(rows)), 2):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                new[i] = new[j] = min(new[i], new[j])
        if new == comp:
            break
        comp = new
    ids = {}
    for (d, _), c in zip(rows, comp):
        ids[c] = min(x for x in (ids.get(c), d) if x is not None) if (ids.get(c), d) != (None, None) else None
    return fps, [ids[c] for c in comp]


def test_fingerprint():
    for t in [None, "", " \t\n", "one", "one two", "A b C d", "É é Ü", "a\x0bb\x0cc d", LONG]:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain(t)


def test_components_like_brute_force(spark, make_docs):
    rng = random.Random(3)
    base = [f"t{rng.randrange(500)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "x"), (6, "é X"), (7, LONG), (8, LONG), (8, LONG)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(400)] = "changed"
        rows.append((100 + rng.randrange(1000) * 10 + i % 10, " ".join(w)))
    fps, comp = components(rows)
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comp))


def test_links_all_distances(spark):
    rng = random.Random(1)
    fps = {0, 1, (1 << 63), (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for d in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius in range(4):
        want = {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) % (1 << 64)).count("1") <= radius}
        assert {(r.u, r.v) for r in simhash.links(df, radius).collect()} == want


def test_empty_table(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_keys_are_not_broadcast(spark):
    """The keys are 131 times the fingerprints, whose size Spark takes them to have."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
