"""Suffix-array deduplication with a run-length index: bytes covered by long strings that start elsewhere too.

A suffix array of a whole corpus fits no machine, so equal strings are first brought together. Each window of ``length``
bytes has an anchor: the string of ANCHOR bytes in it with the smallest hash, the leftmost of equals. Equal windows have
the same anchor at the same place, and the windows that share one occurrence of an anchor are neighbours; the bytes under
them are its context. Contexts that are equal as a whole are settled by counting. Of anchors with several contexts the
distinct ones are indexed together: their Burrows-Wheeler transform is cut in runs of equal bytes, matches are compared at
the ends of runs only, and streamed from there along the text, as a match at one byte leaves one shorter by a byte at the
next unless a run ends between. An anchor of more contexts than an index holds is split over several indexes: its windows
are anchored anew, by strings twice as long, which fewer of them share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.batches import sliced
from readloom.plans.store import Scratch

LENGTH, ANCHOR = 200, 64
#: Bytes of text that are hashed at a time; bytes of contexts that one index holds on average; contexts, of
#: 2 * LENGTH - ANCHOR bytes at most, that fill an index: an anchor of more is split.
CHUNK_BYTES, INDEX_BYTES = 1 << 20, 2 << 20
MANY = INDEX_BYTES // (2 * LENGTH - ANCHOR)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each byte on that has so many."""
    part, m, h, n = _BYTES[data], 1, None, 0  # h: of n bytes; part: of m bytes, a power of two
    while True:
        if k & m:
            h = part if h is None else h[: len(h) - m] * np.uint64(pow(_BASE, m, 1 << 64)) + part[n:]
            n += m
        if n == k:
            break
        part = part[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + part[m:]
        m *= 2
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` values in a row."""
    m = 1
    while 2 * m <= w:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (w - m)], x[w - m :]) if w > m else x


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For each anchor occurrence: number of the text, first window, windows, hash of the anchor, hash of the context.
    Anchors are strings of ``gram`` bytes. Texts of any length are hashed CHUNK_BYTES at a time."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    runs: list[np.ndarray] = []  # text, first window, windows, place of the anchor, hash of the anchor
    for at in range(0, len(data) - length + 1, CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES + length - 1]
        h = _gram_hashes(part, gram)
        place = (_least(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        first = at + np.arange(len(place))
        doc = np.searchsorted(off, first, side="right") - 1
        own = np.flatnonzero(first + length <= off[doc + 1])  # windows that lie in one text
        if not len(own):
            continue
        place, first, doc = place[own], first[own], doc[own]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(doc) != 0)]))
        wins = np.diff(np.concatenate([new, [len(place)]]))
        got = np.stack([doc[new], first[new], wins, place[new] + at, h[place[new]].view(np.int64)])
        if runs and (runs[-1][[0, 3], -1] == got[[0, 3], 0]).all():  # an anchor's windows go on from the part before
            runs[-1][2, -1] += got[2, 0]
            got = got[:, 1:]
        if got.shape[1]:
            runs.append(got)
    if not runs:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    doc, first, wins, _, anchor = np.concatenate(runs, axis=1)
    view = memoryview(data)
    ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(first.tolist(), (first + wins + length - 1).tolist())), np.uint64, len(first))
    return doc, first - off[doc], wins, anchor, ctx.view(np.int64)


class RunLengthIndex:
    """The run-length compressed Burrows-Wheeler transform of some strings, with text places sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"\xff".join([b"", *strings, b""]), dtype=np.uint8)  # a byte that UTF-8 never has
        n = len(self.text)
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | padded[j : j + n]
        self.ranks: dict[int, np.ndarray] = {}  # by the first 8, 16, ... bytes
        m = 8
        while True:
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            self.ranks[m] = rank.astype(np.int32)
            if rank[order[-1]] == n - 1 or m >= 2 * n:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - m)] = rank[m:] + 1
            key = (rank << 32 | after).astype(np.uint64)
            m *= 2
        bwt = self.text[order - 1]
        ends = np.flatnonzero(bwt[1:] != bwt[:-1])
        self.heads = np.concatenate([[0], ends + 1])  # of runs, in suffix order
        self.tails = np.concatenate([ends, [n - 1]])
        self.runs = bwt[self.heads]
        #: Text places at run ends, and those of the suffixes before heads and after tails.
        self.head_at, self.tail_at = order[self.heads], order[self.tails]
        self.before, self.after = order[self.heads - 1], order[(self.tails + 1) % n]

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes agree from two places on: ranks settle powers of two from 8 on, single bytes the rest."""
        n, start = len(self.text), i
        i, j = i.copy(), j.copy()
        for m in sorted(self.ranks, reverse=True):
            rank = self.ranks[m]
            ok = np.flatnonzero((np.maximum(i, j) + m <= n))
            ok = ok[rank[i[ok]] == rank[j[ok]]]
            i[ok] += m
            j[ok] += m
        for _ in range(7):
            ok = np.flatnonzero(np.maximum(i, j) < n)
            ok = ok[self.text[i[ok]] == self.text[j[ok]]]
            i[ok] += 1
            j[ok] += 1
        return i - start

    def matches(self) -> np.ndarray:
        """Matching statistics: for each place, the length of its longest match with any other place.

        The suffix next to a place in suffix order gives its longest match on that side. Where the byte before is in the
        same run as its neighbour's, the match is that of the place before, less one byte.
        """
        best = np.zeros(len(self.text), np.int64)
        for at, other in ((self.head_at, self.before), (self.tail_at, self.after)):
            value = np.full(len(self.text), -1, np.int64)
            found = self._common(at, other)
            edge = (at == self.head_at[0]) if other is self.before else (at == self.tail_at[-1])
            value[at] = np.where(edge, 0, found)  # nothing comes before the first suffix, or after the last
            last = np.maximum.accumulate(np.where(value >= 0, np.arange(len(value)), 0))
            best = np.maximum(best, np.maximum(value[last], 0) - (np.arange(len(value)) - last))
        return best


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each string, the runs (from, to) of windows of ``length`` bytes that start elsewhere in the strings as well."""
    hit = RunLengthIndex(strings).matches() >= length
    out, at = [], 1
    for s in strings:
        out.append(_runs(hit[at : at + max(0, len(s) - length + 1)]))
        at += len(s) + 1
    return out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_id, first, windows, anchor, context) of every anchor occurrence in ``docs`` (doc_id, text_id, text)."""
    names = ["doc_id", "text_id", "first", "windows", "anchor", "context"]

    def work(rows: list[tuple]) -> pa.RecordBatch:
        doc, first, wins, anchor, ctx = contexts([r[2] for r in rows], length, gram)
        ids = [pa.array([r[k] for r in rows], pa.int64()).take(pa.array(doc)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(x, pa.int64()) for x in (first, wins, anchor, ctx))], names=names)

    def run(batches):
        rows, size = [], 0
        for b in sliced(batches):
            for row in zip(*(b.column(k).to_pylist() for k in range(3))):
                if len(row[2]) < length:
                    continue
                if rows and size + len(row[2]) > CHUNK_BYTES:
                    yield work(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield work(rows)

    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _distinct_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, context, many, data): the bytes of each context of ``wanted``, cut from the text that it names."""
    each = F.struct("first", "windows", "anchor", "context", "many")
    lists = wanted.groupBy("doc_id", "text_id").agg(F.collect_list(each).alias("wanted"))
    lists = lists.select(F.col("doc_id").alias("w_doc"), F.col("text_id").alias("w_text"), "wanted")
    # Rows that repeat both doc_id and text give the same bytes; one of each is enough.
    found = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_id") == F.col("w_text")))
    cut = found.select("text", F.explode("wanted").alias("w"))
    data = F.substring(F.col("text"), (F.col("w.first") + 1).cast("int"), (F.col("w.windows") + length - 1).cast("int"))
    return cut.select("w.anchor", "w.context", "w.many", data.alias("data"))


def covers(docs: DataFrame, length: int, scratch: Scratch, gram: int = ANCHOR) -> DataFrame:
    """(doc_id, text_id, first, past): runs of windows, in ``docs`` (doc_id, text_id, text: binary), that start elsewhere.

    Windows are brought together by anchors of ``gram`` bytes. The contexts of an anchor that has more of them than an
    index holds are themselves searched as texts, by anchors of twice as many bytes: their windows have that anchor in
    common, so none is equal to one of another anchor. At ``length`` bytes an anchor is its window, and has one context.
    """
    every = scratch.cut(_anchors(docs, length, gram), f"anchors{gram}")
    # Counted before they are dealt out, so that an anchor of a third of all texts loads no task.
    shared = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
    shared = scratch.cut(shared.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), f"shared{gram}")
    hits = scratch.cut(every.join(shared, "anchor"), f"hits{gram}")
    scratch.drop(f"anchors{gram}", f"shared{gram}")
    same = hits.where("not mixed").select("doc_id", "text_id", "first", (F.col("first") + F.col("windows")).alias("past"))

    mixed = hits.where("mixed")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id", "first", "windows")
    distinct = scratch.cut(mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(at).alias("at")), f"contexts{gram}")
    # A table of its own, so that adaptive execution can split an anchor's contexts in the join.
    large = scratch.cut(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")).where(F.col("contexts") > MANY).select("anchor", F.lit(True).alias("many")), f"large{gram}")
    wanted = distinct.join(large, "anchor", "left").select("anchor", "context", F.coalesce("many", F.lit(False)).alias("many"), "at.doc_id", "at.text_id", "at.first", "at.windows")
    pieces = scratch.cut(_distinct_bytes(docs, wanted, length).dropDuplicates(["anchor", "context"]), f"pieces{gram}")
    total = pieces.where("not many").agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]

    def index(group: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows([bytes(x) for x in group["data"]], length)
        rows = [(a, c, i, j) for a, c, runs in zip(group["anchor"], group["context"], found) for i, j in runs]
        return pd.DataFrame(rows, columns=["anchor", "context", "i", "j"]).astype("int64")

    few = pieces.where("not many").withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(1 + total // INDEX_BYTES)))
    found = few.groupBy("part").applyInPandas(index, "anchor long, context long, i long, j long")
    if large.limit(1).count():
        texts = pieces.where("many").select(F.col("anchor").alias("doc_id"), F.col("context").alias("text_id"), F.col("data").alias("text"))
        found = found.unionByName(covers(texts, length, scratch, min(2 * gram, length)).toDF("anchor", "context", "i", "j"))
    whole = distinct.where("n > 1").select("anchor", "context", F.lit(0).cast("long").alias("i"), F.col("at.windows").alias("j"))
    once = distinct.where("n = 1").select("anchor", "context")
    parts = scratch.cut(found.join(once, ["anchor", "context"]).unionByName(whole), f"parts{gram}")
    cut = mixed.join(parts, ["anchor", "context"]).select("doc_id", "text_id", (F.col("first") + F.col("i")).alias("first"), (F.col("first") + F.col("j")).alias("past"))
    return same.unionByName(cut)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): each row of ``docs`` (doc_id, text) as UTF-8 bytes without those that
    are covered by a string of ``length`` bytes that also starts anywhere else in ``docs``, the same text included.

    ``kept`` is what is left, joined; ``n_spans`` counts the maximal removed runs. Null texts are empty. Rows that repeat
    both doc_id and text are copies of each other like any. Other columns are ignored. ``length`` is over ANCHOR.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    scratch = Scratch(docs.sparkSession, "runlength")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = covers(slim, length, scratch).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first", "past")).alias("runs"))
    found = scratch.cut(found.select(F.col("doc_id").alias("r_doc"), F.col("text_id").alias("r_text"), "runs"), "runs")
    scratch.drop(*(set(scratch.paths) - {"runs"}))
    full = slim.join(found, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_id") == F.col("r_text")), "left")
    full = full.select("doc_id", "text", F.col("runs.first").alias("first"), F.col("runs.past").alias("past"))

    def run(batches):
        for b in sliced(batches):
            rows = [_cut(t, i, j, length) for t, i, j in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            out = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))] if rows else [pa.array([], k) for k in (pa.binary(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return full.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _cut(text: bytes, first: list[int] | None, past: list[int] | None, length: int) -> tuple[bytes, int, int, int]:
    kept, end, spans, at = [], 0, 0, 0
    for i, j in sorted(zip(first or [], past or [])):
        if i > end or not spans:
            kept.append(text[at:i])
            spans += 1
        end = max(end, j - 1 + length)
        at = end
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text), len(text) - len(left), spans
