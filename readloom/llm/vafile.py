"""Hard negatives by a vector-approximation file (Weber, Schek and Blott, 1998): each component is kept as the number of its
cell, bounds of a score are sums of table entries, and only rows that the bounds leave possible are scored exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.vectors import in_tasks, matrix, whole_numbers
from readloom.plans.store import Scratch

#: Rows of a shard, anchors of a block, cells of a component.
SHARD, ANCHORS, CELLS = 4096, 1024, 256


class Approximation:
    """The cells of a matrix of whole numbers. In each dimension the sorted values are cut in CELLS parts of even count, and
    a cell holds from the least to the largest value in it."""

    def __init__(self, v: np.ndarray):
        n, dim = v.shape
        cells = min(CELLS, n)
        self.cell = np.empty((dim, n), np.uint8)
        self.low, self.high = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
        for d in range(dim):
            first = np.sort(v[:, d])[np.arange(cells) * n // cells]
            at = np.searchsorted(first, v[:, d], side="right") - 1
            self.cell[d] = at
            np.minimum.at(low := np.full(cells, np.iinfo(np.int64).max), at, v[:, d])
            np.maximum.at(high := np.full(cells, np.iinfo(np.int64).min), at, v[:, d])
            used = low <= high
            self.low[d, used], self.high[d, used] = low[used], high[used]

    def stored(self) -> tuple[bytes, bytes, bytes]:
        return self.cell.tobytes(), self.low.tobytes(), self.high.tobytes()

    @classmethod
    def read(cls, dim: int, cell: bytes, low: bytes, high: bytes) -> Approximation:
        a = cls.__new__(cls)
        a.cell = np.frombuffer(cell, np.uint8).reshape(dim, -1) if dim else np.zeros((0, 0), np.uint8)
        a.low, a.high = (np.frombuffer(x, np.int64).reshape(dim, -1) if dim else np.zeros((0, 0), np.int64) for x in (low, high))
        return a

    def bounds(self, q: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product with ``q`` that rows lo to hi can have by their cells."""
        a, b = q[:, None] * self.low, q[:, None] * self.high
        least, most = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        for under, over, cell in zip(np.minimum(a, b), np.maximum(a, b), self.cell[:, lo:hi]):
            least += under.take(cell)
            most += over.take(cell)
        return least, most


def _kth(x: np.ndarray, k: int) -> int:
    """The k-th largest, or less than all if there are fewer."""
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else np.iinfo(np.int64).min


class Shard:
    """Rows by label and id, and their approximation."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, file: Approximation):
        self.ids, self.labels, self.v, self.file = ids, labels, v.astype(np.int64), file

    def _best(self, q: np.ndarray, at: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The first k of the rows ``at``, scored exactly."""
        s = self.v[at] @ q
        return [(int(self.ids[at[i]]), int(s[i])) for i in np.lexsort((self.ids[at], -s))[:k]]

    def positives(self, me: int, label: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the first k rows of the label that have another id."""
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        if lo == hi:
            return []
        least, most = self.file.bounds(q, lo, hi)
        other = self.ids[lo:hi] != me
        return self._best(q, lo + np.flatnonzero(other & (most >= _kth(least[other], k))), k)

    def negatives(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores, (id, score) of the first k rows of other labels whose scores are in it."""
        least, most = self.file.bounds(q, 0, len(self.ids))
        other, out = self.labels != label, []
        for low, high in windows:
            # Of rows that surely are in the window, the k-th best bounds what can still be among the first k.
            sure = other & (least >= low) & (most <= high)
            at = np.flatnonzero(other & (least <= high) & (most >= max(low, _kth(least[sure], k))))
            s = self.v[at] @ q
            fits = (s >= low) & (s <= high)
            at, s = at[fits], s[fits]
            out.append([(int(self.ids[at[i]]), int(s[i])) for i in np.lexsort((self.ids[at], -s))[:k]])
        return out


def window(score: int) -> tuple[int, int]:
    """The whole scores s with 50 * score <= 100 * s <= 95 * score."""
    return -(-score // 2), 95 * score // 100


def _packed(rows: DataFrame, size: int, file: bool = False) -> DataFrame:
    """Rows (vec_id, label, v) packed by the length of their vectors, at most ``size`` in one, with their approximation if
    that is wanted."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        for b in batches:
            lengths = np.array([len(x) for x in b.column(2)], dtype=np.int64)
            for dim in np.unique(lengths).tolist():
                some = b.filter(pa.array(lengths == dim))
                part = (some.column(0).to_numpy(), some.column(1).to_numpy(), matrix(some.column(2), dim))
                ids, labels, v = (np.concatenate(x) for x in zip(*[*held.pop(dim, []), part]))
                while len(ids) >= size:
                    yield pack(dim, ids[:size], labels[:size], v[:size])
                    ids, labels, v = ids[size:], labels[size:], v[size:]
                held[dim] = [(ids, labels, v)]
            while sum(len(x[0][0]) for x in held.values()) > 4 * size:
                dim = max(held, key=lambda d: len(held[d][0][0]))
                yield pack(dim, *held.pop(dim)[0])
        for dim, parts in held.items():
            if len(parts[0][0]):
                yield pack(dim, *parts[0])

    def pack(dim, ids, labels, v):
        o = np.lexsort((ids, labels))
        row = {"dim": [dim], "ids": [ids[o].tobytes()], "labels": [labels[o].tobytes()], "v": [v[o].tobytes()]}
        row |= {c: [x] for c, x in zip(_FILE, Approximation(v[o]).stored())} if file else {}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in row if c != "dim")]))

    more = "".join(f", {c} binary" for c in _FILE) if file else ""
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"dim int, ids binary, labels binary, v binary{more}")


_FILE = ["cell", "low", "high"]


def _unpacked(p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(p.ids, np.int64)
    return ids, np.frombuffer(p.labels, np.int64), np.frombuffer(p.v, np.int32).reshape(len(ids), p.dim)


def _shards(s: pd.DataFrame) -> Iterator[Shard]:
    for p in s.itertuples():
        yield Shard(*_unpacked(p), Approximation.read(p.dim, p.cell, p.low, p.high))


def _meet(shards: DataFrame, blocks: DataFrame, scratch: Scratch):
    """Both sides with the keys (dim, shard, block), so that each shard meets each block of its length in a task's group."""
    of = shards.groupBy("dim").agg(F.count("*").alias("shards"))
    cells = of.join(blocks.groupBy("dim").agg(F.count("*").alias("blocks")), "dim")
    cells = scratch.cut(cells, "cells")  # a row a length

    def deal(n: str):
        return F.pmod(F.xxhash64("ids", F.lit(n)), F.col(n))

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = shards.join(cells, "dim").select("dim", deal("shards").alias("shard"), all_of("blocks").alias("block"), "ids", "labels", "v", *_FILE)
    right = blocks.join(cells, "dim").select("dim", all_of("shards").alias("shard"), deal("blocks").alias("block"), "ids", "labels", "v", *(c for c in blocks.columns if c == "windows"))
    keys = ["dim", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def hard_negatives(table: DataFrame, anchors, positives: int = 5, negatives: int = 3, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``table`` (vec_id, embedding, label).

    Rows without vec_id or label, and those whose vector is null or has a component that is null, non-finite or 2^24 or
    more once scaled, take no part; equal rows are one. Components become floor(scale * x), and a score is the inner product with
    the anchor, among vectors of one length. Higher scores come first, ties by smaller vec_id. ``anchors`` is the condition
    on vec_id. An anchor's positives are its first ``positives`` rows of its label with another vec_id, all if fewer; for
    each the first ``negatives`` rows of other labels are returned whose score is at least half and at most 0.95 of the
    positive's. So a positive with a negative score has none. An empty table gives no rows.

    Rows are packed in shards and anchors in blocks, and each block meets each shard twice: for the positives, and then for
    what their windows hold. Both keep a fixed number of rows an anchor and shard before they are shuffled.
    """
    scratch = Scratch(table.sparkSession, "vafile")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers("embedding", scale).alias("v"))
    rows = scratch.cut(rows.where("vec_id is not null and label is not null and v is not null").distinct(), "rows")
    shards = scratch.cut(_packed(in_tasks(rows), SHARD, file=True), "shards")
    blocks = scratch.cut(_packed(rows.where(anchors), ANCHORS), "blocks")

    def find(s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for shard in _shards(s):
            for ids, labels, v in map(_unpacked, b.itertuples()):
                for at, (me, label, q) in enumerate(zip(ids.tolist(), labels.tolist(), v.astype(np.int64))):
                    out += [(me, label, q.astype(np.int32).tobytes(), *x) for x in shard.positives(me, label, q, positives)]
        return pd.DataFrame(out, columns=["anchor_id", "label", "q", "positive_id", "positive_score"]).astype({c: "int64" for c in ("anchor_id", "label", "positive_id", "positive_score")})

    # An anchor is its id, label and vector; of rows that share an id each is one.
    whole = "anchor_id long, label long, q binary, positive_id long, positive_score long"
    order = Window.partitionBy("anchor_id", "label", "q").orderBy(F.desc("positive_score"), "positive_id")
    pairs = _meet(shards, blocks, scratch).applyInPandas(find, whole)
    pairs = scratch.cut(pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives), "pairs")

    def open_windows(batches: Iterator[pd.DataFrame]):
        """Blocks of anchors with the scores of their positives, as _packed makes them of one anchor a row."""
        for b in batches:
            for dim, part in b.groupby(b["q"].map(len) // 4):
                for at in range(0, len(part), ANCHORS):
                    p = part.iloc[at : at + ANCHORS]
                    yield pd.DataFrame({"dim": [dim], "ids": [p["anchor_id"].to_numpy(np.int64).tobytes()], "labels": [p["label"].to_numpy(np.int64).tobytes()], "v": [b"".join(p["q"])], "windows": [[list(map(int, x)) for x in p["scores"]]]})

    asked = pairs.groupBy("anchor_id", "label", "q").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))  # a few each
    asked = asked.mapInPandas(open_windows, "dim int, ids binary, labels binary, v binary, windows array<array<long>>")
    asked = scratch.cut(asked, "asked")

    def mine(s: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for shard in _shards(s):
            for p in b.itertuples():
                ids, labels, v = _unpacked(p)
                for me, label, q, scores in zip(ids.tolist(), labels.tolist(), v.astype(np.int64), p.windows):
                    found = shard.negatives(label, q, [window(int(x)) for x in scores], negatives)
                    out += [(me, label, q.astype(np.int32).tobytes(), int(x), *y) for x, each in zip(scores, found) for y in each]
        return pd.DataFrame(out, columns=["anchor_id", "label", "q", "positive_score", "negative_id", "negative_score"]).astype({c: "int64" for c in ("anchor_id", "label", "positive_score", "negative_id", "negative_score")})

    found = _meet(shards, asked, scratch).applyInPandas(mine, "anchor_id long, label long, q binary, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "label", "q", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return pairs.join(found, ["anchor_id", "label", "q", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
