"""Toxicity scores of whole texts by a factorization machine over hashed terms (Rendle, 2010).

The model's score is a weight for each term that a text holds, and for each pair of them the product of two learned
vectors: so an insult counts for more, or less, beside another term, which a sum of weights can't tell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.batches import sliced
from readloom.plans.store import Scratch

#: Labelled rows that are learned from, of each label at most; features that terms are hashed to; length of vectors.
MAX_ROWS, FEATURES, FACTORS = 6000, 1 << 18, 8
#: A feature's value is chi / (chi + HALF), by the chi-square of its bond with the label, or if that is more twice its share
#: of the texts, 1 at most; FLOOR at least. So rare ones that tell nothing by themselves have little say, and none is left out.
HALF, FLOOR = 30.0, 0.1
EPOCHS, BATCH, RATE, DECAY, SEED = 4, 128, 0.05, 2e-3, 7
#: Tokens that a worker keeps the terms of.
KEPT_TOKENS = 100_000
_WORD = re.compile(r"\w+")


def terms(token: str) -> set[int]:
    """Hashes of the terms of a token in lower case: each word in it, and the word's first 4 and 5 letters, by which
    words are alike that were coined or inflected."""
    found = set()
    for w in _WORD.findall(token):
        found.update(xxhash.xxh64_intdigest(x) for x in (w, f"^{w[:4]}", f"^{w[:5]}"))
    return found


@dataclass
class Model:
    """Rows for the features ``terms`` (ascending) that were seen; ``bias`` alone is the score of a text without any. The
    values of features are part of the weights and vectors."""

    terms: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    bias: float
    wide: np.ndarray | None = None

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as the rows of their features."""
        if self.wide is None:
            self.wide = self.vectors.astype(np.float64)
        return 1 / (1 + np.exp(-_raw(self.bias, self.weight, self.wide, *_flat(texts))[0]))


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in texts], dtype=np.int64)
    return np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), n


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``n`` rows; a run may be empty."""
    out, some = np.zeros((len(n), *values.shape[1:])), n > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some], axis=0)
    return out


def _raw(bias, weight, vectors, at, n, value=None):
    """Raw scores, and what their gradient needs: the sums of vectors by text, and the vectors."""
    v, w = vectors[at], weight[at]
    if value is not None:
        v, w = v * value[at, None], w * value[at]
    s = _sums(v, n)
    return np.clip(bias + _sums(w, n) + 0.5 * (s * s - _sums(v * v, n)).sum(axis=1), -30, 30), s, v


def features(hashes: np.ndarray) -> np.ndarray:
    """The features of a text's terms, ascending, each once."""
    return np.unique(hashes & np.uint64(FEATURES - 1))


def _values(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    flat, n = _flat(rows)
    count = np.bincount(flat, minlength=size).astype(np.float64)
    toxic = np.bincount(flat, np.repeat(labels, n), minlength=size)
    texts, n1 = len(rows), labels.sum()
    gap = toxic * texts - count * n1
    chi = gap * gap / np.maximum(1, count * (texts - count)) / max(1.0, n1 * (texts - n1) / max(1, texts))
    return np.maximum(np.maximum(chi / (chi + HALF), np.minimum(1, 2 * count / max(1, texts))), FLOOR)


def fit(texts: list[np.ndarray], labels: np.ndarray) -> Model:
    """Learns from the hashes of the terms of each text, with both labels given even weight."""
    found = [features(x) for x in texts]
    every = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
    rows = [np.searchsorted(every, x) for x in found]
    rng = np.random.default_rng(SEED)
    w, v, bias = np.zeros(len(every)), rng.normal(0, 0.01, (len(every), FACTORS)), 0.0
    if not 0 < labels.sum() < len(labels):
        return Model(every, w, np.zeros(v.shape, np.float32), bias)
    value = _values(rows, labels, len(every))
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            flat, n = _flat([rows[i] for i in part])
            raw, s, vx = _raw(bias, w, v, flat, n, value)
            g = (1 / (1 + np.exp(-raw)) - labels[part]) * share[part]
            each = np.repeat(np.arange(len(part)), n)
            used, back = np.unique(flat, return_inverse=True)
            gx = g[each] * value[flat]
            dw = np.bincount(back, gx, len(used)) / len(part) + DECAY * w[used]
            dv = gx[:, None] * (s[each] - vx)
            dv = np.stack([np.bincount(back, dv[:, k], len(used)) for k in range(FACTORS)], axis=1) / len(part) + DECAY * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.mean() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            bias -= RATE * g.mean() / np.sqrt(gb)
    return Model(every, w * value, (v * value[:, None]).astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows of ``labels`` (doc_id, toxic 0 or 1) and the texts of ``docs`` with that doc_id.

    Of each label the MAX_ROWS rows with the smallest hash of doc_id are used, which bounds what one task learns from. The
    model has a row for each of FEATURES features at most, whatever the texts hold; that is what reaches the driver. Labels that are null or without a document are left out; of several for one doc_id
    the largest holds. Both labels weigh the same: a score of 0.5 is where neither is likelier. Without both the score is
    0.5 for every text.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = scratch.cut(known, "labels")
    some = [known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS) for x in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # 2 * MAX_ROWS rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]):
        for b in sliced(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = set(chain.from_iterable(map(terms, set((text or "").lower().split()))))
                hashes = np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))
                yield pa.RecordBatch.from_pydict({"terms": [hashes.tobytes()], "toxic": [y]}, schema=_SAMPLE)

    taken = rows.select("text", "toxic").mapInArrow(extract, "terms binary, toxic int")

    def learn(parts: Iterator[pd.DataFrame]):
        got = pd.concat([pd.DataFrame({"terms": [], "toxic": []}), *parts])
        m = fit([np.frombuffer(x, np.uint64) for x in got["terms"]], got["toxic"].to_numpy(dtype=np.float64))
        yield pd.DataFrame({"part": ["terms", "weight", "vectors", "bias"], "data": [m.terms.tobytes(), m.weight.tobytes(), m.vectors.tobytes(), np.float64(m.bias).tobytes()]})

    ordered = scratch.cut(taken, "sample").orderBy(F.md5("terms"), "toxic").coalesce(1)
    got = {r["part"]: r["data"] for r in ordered.mapInPandas(learn, "part string, data binary").collect()}
    empty = {"terms": b"", "weight": b"", "vectors": b"", "bias": np.float64(0).tobytes()}
    a = {k: bytes(got.get(k, x)) for k, x in empty.items()}
    vectors = np.frombuffer(a["vectors"], np.float32).reshape(-1, FACTORS)
    return Model(np.frombuffer(a["terms"], np.uint64), np.frombuffer(a["weight"]), vectors, float(np.frombuffer(a["bias"])[0]))


_SAMPLE = pa.schema([("terms", pa.binary()), ("toxic", pa.int32())])


class _Rows(dict):
    """Token -> the model's rows of its features."""

    def __init__(self, known: dict[int, int]):
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> tuple[int, ...]:
        each = {x & (FEATURES - 1) for x in terms(token)}
        got = tuple(self.known[x] for x in each if x in self.known)
        if len(self) < KEPT_TOKENS:
            self[token] = got
        return got


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` by its whole text, or the columns ``keep`` and score; a null text scores as
    an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows at most
    names = [c for c in keep or ["doc_id"] if c != "score"]
    numbered = [f"c{i}" for i in range(len(names))]
    slim = docs.select(*names, "text").toDF(*numbered, "whole")

    def run(batches):
        m = shared.value
        rows = _Rows({int(h): i for i, h in enumerate(m.terms)})
        for b in sliced(batches):
            texts = []
            for text in b.column(len(names)).to_pylist():
                found = set(chain.from_iterable(map(rows.__getitem__, set((text or "").lower().split()))))
                texts.append(np.sort(np.fromiter(found, dtype=np.int64, count=len(found))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.scores(texts))], names=[*numbered, "score"])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:-1], T.StructField("score", T.DoubleType())])).toDF(*names, "score")
