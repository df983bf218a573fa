"""Quality of whole texts by positive-unlabelled learning: the non-negative unbiased risk (Kiryo et al., 2017) of an additive
model, over trusted positives, all unlabelled text and an estimated class prior (best bin estimation; Garg et al., 2021)."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.batches import sliced
from readloom.plans.store import Scratch

#: Quantiles at which a measure is cut into bins: close at the ends, where junk lies.
CUTS = [0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.5, 0.75, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995, 0.998]
BINS = len(CUTS) + 1
#: Weight of half the squares of the model against the losses of all rows, rounds of Newton's method at most, and the gain at
#: which they end.
RIDGE, ROUNDS, GAIN = 10.0, 14, 1e-6
#: Bins of scores that the class prior is estimated from, and the chance that its bound fails.
SCORES, FAIL = 400, 0.1

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "line": [10, 13], "blank": [9, 32],
    "stop": b".,;:", "call": b"!?", "symbol": b"#$%&*+/<=>@\\^_`|~", "bracket": b"()[]{}\"'-",
}
_OF = np.zeros((256, len(_KINDS)))
for _i, _x in enumerate(_KINDS.values()):
    _OF[list(_x), _i] = 1
MEASURES = [
    *_KINDS, "bytes", "words", "word length", "longest word", "distinct words", "top word", "same as last", "distinct pairs", "distinct triples",
    "distinct lines", "line length", "sentence length", "zipped", "entropy", "short words",
]


def measures(text: str | None) -> np.ndarray:
    """What is measured of a whole text; null is as empty."""
    data = (text or "").encode("utf-8", "replace")
    count, n = np.bincount(np.frombuffer(data, np.uint8), minlength=256), max(1, len(data))
    words, lines = (text or "").split(), (text or "").split("\n")
    each, m = Counter(words), max(1, len(words))
    p = count[count > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return np.array(
        [
            *(count @ _OF / n), math.log1p(len(data)), math.log1p(len(words)), lengths.mean(), math.log1p(lengths.max()),
            len(each) / m, max(each.values(), default=0) / m, sum(map(eq, words, words[1:])) / m,
            len(set(zip(words, words[1:]))) / m, len(set(zip(words, words[1:], words[2:]))) / m,
            len(set(lines)) / len(lines), math.log1p(len(data) / len(lines)), math.log1p(m / (1 + count[46])),
            len(zlib.compress(data, 1)) / n, -(p * np.log(p)).sum(), (lengths <= 2).mean(),
        ],
        dtype=np.float32,
    )


class Bins:
    """Each measure as one of its bins: a row of the model's weights."""

    def __init__(self, cuts: list[list[float]]):
        self.cuts = [np.array(c, np.float32) for c in cuts]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="left") + i * BINS for i, c in enumerate(self.cuts)], axis=1)


SIZE = len(MEASURES) * BINS


def _sums(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of rows of bins: their number, both losses, bins, bins by score, and pairs of bins by what the score's slope is."""
    g = w[at].sum(axis=1)
    s = 1 / (1 + np.exp(-g))
    slope, k = s * (1 - s), at.shape[1]
    out = np.zeros((SIZE, SIZE))
    for i in range(k):
        for j in range(i, k):
            pair = np.bincount((at[:, i] - i * BINS) * BINS + at[:, j] - j * BINS, slope, BINS * BINS).reshape(BINS, BINS)
            out[i * BINS : (i + 1) * BINS, j * BINS : (j + 1) * BINS] += pair
            if i < j:
                out[j * BINS : (j + 1) * BINS, i * BINS : (i + 1) * BINS] += pair.T
    flat = at.ravel()
    first = [len(at), np.logaddexp(0, -g).sum(), np.logaddexp(0, g).sum()]
    return np.concatenate([first, np.bincount(flat, minlength=SIZE), np.bincount(flat, np.repeat(s, k), SIZE), out.ravel()])


class _Parts:
    """Means over rows of one kind."""

    def __init__(self, x: np.ndarray):
        self.n = x[0]
        self.loss_up, self.loss_down = x[1:3] / max(1, self.n)
        self.bins, self.scored = x[3 : 3 + SIZE] / max(1, self.n), x[3 + SIZE : 3 + 2 * SIZE] / max(1, self.n)
        self.slope = x[3 + 2 * SIZE :].reshape(SIZE, SIZE) / max(1, self.n)


def _batch(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(b.num_rows, -1)


def _evaluate(table: DataFrame, bins: Bins, w: np.ndarray) -> tuple[_Parts, _Parts]:
    """Sums over the positives and over all rows of ``table`` (x, positive). Tasks send one row each, which are added up in two
    steps by tasks, so that one row reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((2, 3 + 2 * SIZE + SIZE * SIZE))
        for b in batches:
            at, known = bins(_batch(b)), b.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            total[0] += _sums(at[known], w)
            total[1] += _sums(at, w)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    def add(parts: Iterator[pd.DataFrame]):
        total = sum((np.frombuffer(x) for p in parts for x in p["sums"]), np.zeros(2 * (3 + 2 * SIZE + SIZE * SIZE)))
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = table.mapInArrow(run, "sums binary").repartition(8).mapInPandas(add, "sums binary")
    got = [np.frombuffer(bytes(r.sums)) for r in parts.coalesce(1).mapInPandas(add, "sums binary").collect()]
    both = sum(got, np.zeros(2 * (3 + 2 * SIZE + SIZE * SIZE))).reshape(2, -1)
    return _Parts(both[0]), _Parts(both[1])


def _minimise(table: DataFrame, bins: Bins, risk) -> np.ndarray:
    """Newton's method on ``risk(positives, all)`` = (value, gradient, slopes); a step that raises the value is halved."""
    w, at, least, step = np.zeros(SIZE), np.zeros(SIZE), math.inf, None
    for _ in range(ROUNDS):
        positive, every = _evaluate(table, bins, w)
        value, gradient, slopes = risk(positive, every)
        ridge = RIDGE / max(1, every.n)
        value += ridge / 2 * (w @ w)
        if value > least:
            step = step / 2
            w = at + step
            continue
        gain, at, least = least - value, w, value
        if gain < GAIN:
            break
        step = -np.linalg.solve(slopes + ridge * np.eye(SIZE), gradient + ridge * w)
        w = at + step
    return at


def _apart(p: _Parts, u: _Parts):
    """Positives against all: the risk of telling which of the two a text was drawn from."""
    return p.loss_up + u.loss_down, p.scored - p.bins + u.scored, p.slope + u.slope


def _non_negative(prior: float):
    """The risk pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]). Where the second term, the risk of negatives, would be
    below 0, a step goes the way that raises it, so that the model doesn't learn the unlabelled rows by heart."""

    def risk(p: _Parts, u: _Parts):
        negative = u.loss_down - prior * p.loss_down
        down, up = u.scored - prior * p.scored, prior * (p.scored - p.bins)
        return prior * p.loss_up + max(0.0, negative), down + up if negative >= 0 else -down, u.slope

    return risk


def best_bin(positive: np.ndarray, every: np.ndarray) -> float:
    """The class prior from counts of scores, ascending: the least ratio of all rows to positives above a score, at the one
    where that ratio with what chance adds is least; between 0.01 and 0.99."""
    p, u = (np.cumsum(x[::-1]) / max(1, x.sum()) for x in (positive, every))
    wide = sum(math.sqrt(math.log(4 / FAIL) / (2 * max(1, x.sum()))) for x in (positive, every))
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.nanargmin(np.where(p > 0, u / p + wide / p, np.inf))
    return float(np.clip(u[at] / p[at] if p[at] > 0 else 0.5, 0.01, 0.99))


def _prior(table: DataFrame, bins: Bins) -> float:
    """Half of the rows tell positives from all, and the scores of the others give the prior."""
    half = F.pmod(F.xxhash64("x"), F.lit(2))
    w = _minimise(table.where(half == 0), bins, _apart)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            g = w[bins(_batch(b))].sum(axis=1)
            at = np.minimum(SCORES - 1, (SCORES / (1 + np.exp(-g))).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"at": at, "positive": b.column("positive")})

    counts = np.zeros((2, SCORES))
    scored = table.where(half == 1).mapInArrow(run, "at long, positive boolean")
    for r in scored.groupBy("at").agg(F.sum(F.col("positive").cast("long")), F.count("*")).collect():  # SCORES rows
        counts[:, r[0]] = r[1:]
    return best_bin(*counts)


def measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``docs`` and x: what is measured of ``text``, as 4-byte floats."""
    numbered = [f"c{i}" for i in range(len(names))]
    slim = docs.select(*names, "text").toDF(*numbered, "whole")

    def run(batches):
        for b in sliced(batches):
            x = [measures(t).tobytes() for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.binary())], names=[*numbered, "x"])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:-1], T.StructField("x", T.BinaryType())])).toDF(*names, "x")


def classify(docs: DataFrame, positives: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text): the chance, 0 to 1, that its whole text is of good quality.

    ``positives`` holds the doc_ids of trusted texts, ``learn`` is the condition on ``docs`` for rows that are learned from;
    of the others neither the text nor a label is used. All rows that are learned from count as unlabelled, those with a bad label and the
    positives themselves included, so that they are drawn as the corpus is. A model is a weight for each bin of each
    measure; it is found by Newton's method, whose sums Spark adds up over all rows of each round: nothing is sampled. A null
    text is scored as an empty one. Repeated doc_ids are rows of their own, null doc_ids are never positives. Without
    positives the score is 0.5 for every text; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    x = scratch.cut(measured(slim, ["doc_id", "learn"]), "measured")
    known = positives.where("doc_id is not null").select("doc_id").distinct().withColumn("positive", F.lit(True))
    table = x.where("learn").join(known, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    table = scratch.cut(table, "learned")
    if table.where("positive").isEmpty():
        return x.select("doc_id", F.lit(0.5).alias("score"))

    def floats(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _batch(b).T)], names=MEASURES)

    schema = T.StructType([T.StructField(m, T.FloatType()) for m in MEASURES])
    bins = Bins(table.mapInArrow(floats, schema).approxQuantile(MEASURES, CUTS, 0.0005))
    prior = _prior(table, bins)
    w = _minimise(table, bins, _non_negative(prior))

    def score(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            g = w[bins(_batch(b))].sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-g)))], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(score, T.StructType([x.schema["doc_id"], T.StructField("score", T.DoubleType())]))
