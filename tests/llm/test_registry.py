"""The registered queries over the smallest tables, held to SQL or to a plain version."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from readloom.llm import forest, registry, toxicity

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DIR), con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_simhash(spark, docs):
    def fingerprint(text):
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fp = {d: fingerprint(r.text) for d, r in docs.items()}
    root = {d: d for d in fp}
    near = [(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 3]
    for _ in fp:
        old = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if old == root:
            break
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in registry.op1_simhash(spark, DIR).collect()} == {(d, f"{fp[d]:016x}", root[d]) for d in fp}


def test_toxicity(spark, docs):
    frame = spark.read.parquet(f"{DIR}/documents.parquet")
    m = registry.toxicity_model(frame, spark.read.parquet(f"{DIR}/labels.parquet"))
    row = {int(x): i for i, x in enumerate(m.terms)}
    for r in registry.op3_toxicity(spark, DIR).collect():
        each = {x & (toxicity.FEATURES - 1) for w in re.findall(r"\w+", (docs[r.doc_id].text or "").lower()) for x in toxicity.terms(w)}
        at = [row[x] for x in each if x in row]
        v = m.vectors[at].astype(float)
        pairs = v @ v.T
        raw = m.bias + m.weight[at].sum() + (pairs.sum() - np.trace(pairs)) / 2
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))), abs=1e-6)
        assert r.held_out == (crc(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5)


def test_tokens(spark, docs):
    whole = Tokenizer.from_file(registry.tokenizer("byte_bpe_50k.json"))
    want, start = [], 0
    for d in sorted(docs):
        ids = np.array([*whole.encode(docs[d].text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in registry.op4_sstable(spark, DIR).collect()) == want


def covered(rows, texts):
    """Whether rows are the pieces of the texts (doc_id, text), gapless in their documents and their sequences."""
    whole = Tokenizer.from_file(registry.tokenizer("word_bpe_49k.json"))
    ids = [(d, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in texts]
    want = Counter((d, at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes()), len(x)) for d, x in ids for at in range(0, len(x), 4096))
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1]] and sum(n for _, n in p) <= 4096
    assert sorted(places) == list(range(len(places)))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    return len(places)


def test_packing(spark, docs):
    rows = registry.op6_packing(spark, DIR).collect()
    n = covered(rows, [(d, r.text) for d, r in docs.items()])
    # Shortest pack first, one piece at a time.
    room = []
    for length in sorted((r.length for r in rows), reverse=True):
        at = max(range(len(room)), key=room.__getitem__, default=None)
        if at is None or room[at] < length:
            room.append(4096)
            at = len(room) - 1
        room[at] -= length
    assert n == len(room)


def test_langid(spark, docs):
    def grams(text):
        out = Counter()
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {word} "
            out.update(word)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    def ranked(c):
        code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:300]]

    learned = defaultdict(Counter)
    for d, r in docs.items():
        if crc(d, 4) != 2 and r.lang is not None and r.text is not None:
            learned[r.lang] += grams(r.text)
    profiles = {x: {g: i for i, g in enumerate(ranked(c))} for x, c in learned.items()}
    for r in registry.op8_langid(spark, DIR).collect():
        found = ranked(grams(docs[r.doc_id].text))
        far = {x: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(found)) for x, p in profiles.items()}
        want = min(sorted(far), key=far.get) if found else "und"
        assert (r.lang_pred, r.held_out) == (want, crc(r.doc_id, 4) == 2)
        assert r.score == pytest.approx(1 - far[want] / (300 * len(found)) if found else 0, abs=1e-9)


def test_forest(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows}
    ids, data = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    right = n = 0
    for r in registry.op9_forest(spark, "/root/testdata/sf0.1").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found")).collect():
        far = np.sqrt(((data - x[r.query_id]) ** 2).sum(axis=1))
        want = [i for _, i in sorted(zip(far.tolist(), ids.tolist())) if i != r.query_id][:10]
        assert [f.rank for f in r.found] == list(range(1, 11)) and all(f.score == pytest.approx(far[np.searchsorted(ids, f.vec_id)], abs=1e-12) for f in r.found)
        right, n = right + len(set(want) & {f.vec_id for f in r.found}), n + 10
    assert n == 10 * (ids % 100 == 0).sum() and right / n >= 0.9
    reached = forest.Forest(data, 320).candidates(data[ids % 100 == 0], 512)
    assert np.mean([len(c) / len(data) for c in reached]) < 0.4  # the result doesn't come by looking at all


def test_runlength(spark, docs):
    texts = {d: (r.text or "").encode() for d, r in docs.items()}
    seen = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    want = set()
    for d, t in texts.items():
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.add((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op10_runlength(spark, DIR).collect()} == want


def test_pipeline(spark, tmp_path):
    """Each stage on what the one before kept: near copies go, the last stage packs what mixing gave."""
    import corpus_pipeline as P

    frame, kept = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, frame, DIR).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = frame.collect()
    score = {r.doc_id: r.score for r in registry.op3_toxicity(spark, DIR).collect()}
    assert {r.doc_id for r in kept["toxicity"]} == {d for d, s in score.items() if s < 0.5}
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in kept["toxicity"] for w in [(r.text or "").lower().encode().split()]}
    first = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            first[b] = min(first[b], first[a])
    assert {r.doc_id for r in kept["simhash"]} == {d for d, f in first.items() if d == f}
    assert {r.doc_id for r in kept["sentences"]} <= {r.doc_id for r in kept["simhash"]}
    covered(kept["packing"], [(r.doc_id, r.text) for r in kept["mixing"]])
    assert Counter(map(str, P.run(spark, DIR).drop("sequence_id", "offset").collect())) == Counter(map(str, frame.drop("sequence_id", "offset").collect()))


def test_entry_registers_all():
    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert json.dumps(sorted(__spark_entry__.oracle_sql()))
