"""Packing token sequences: shortest-pack-first over the histogram of lengths (Krell et al., 2021)."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.batches import sliced
from readloom.plans.store import Scratch
from readloom.llm.tokens import encoder

#: Rows that a block of equal lengths holds on average while ranks are given.
BLOCK_ROWS = 1 << 16


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """The ids of each row of ``docs`` (doc_id, text; null text: empty), then ``end_id``, in pieces of ``size`` at most:
    (doc_id, start, length, doc_tokens, ids, ids_crc32), ids as little-endian unsigned 32-bit integers."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        enc = encoder(tokenizer, special=True)
        for b in sliced(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, at, len(piece) // 4, n, piece, zlib.crc32(piece)))
            if rows:
                yield batch(rows)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: places}) of the packs that hold ``histogram`` (length -> count) in ``size`` each.

    Lengths are placed longest first. Each goes to the packs that have most room left; if it fits in none, new packs are
    opened, as many as that length alone needs. Packs of one content are one entry with a count, so that the work depends
    on the number of lengths, and not on how many documents have them.
    """
    room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        free = max((f for f in room if room[f]), default=-1)
        while left:
            while free >= length and not room[free]:
                free -= 1
            if free < length:
                room[size].append((-(-left // (size // length)), {}))
                free = size
            times, held = room[free].pop()
            put = min(times, left)
            if put < times:
                room[free].append((times - put, held))
            room[free - length].append((put, held | {length: held.get(length, 0) + 1}))
            left -= put
    return [p for f in sorted(room) for p in room[f] if p[1]]


def slots(packs: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """Which ranks of each length go where: from ``rank`` on, ``places`` in turn to each sequence from ``sequence`` on,
    the first at ``offset``. At most one row for each pack and length in it: bounded by the size, not by the documents."""
    rows, rank, sequence = [], defaultdict(int), 0
    for times, held in packs:
        offset = 0
        for length, places in sorted(held.items(), reverse=True):
            rows.append((length, rank[length], places, sequence, offset))
            rank[length] += times * places
            offset += length * places
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "places", "sequence", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def ranked(lengths: DataFrame) -> DataFrame:
    """``lengths`` (doc_id, start, length) with ``rank``, from 0 within each length. There are at most as many lengths as a
    sequence has tokens.

    Rows of a length, however many, are dealt to blocks by a hash; blocks are counted, and only within one are rows sorted.
    """
    counts = lengths.groupBy("length").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 40)) / float(1 << 40)
    dealt = lengths.join(F.broadcast(counts), "length").withColumn("block", F.floor(share * F.ceil(F.col("rows") / BLOCK_ROWS))).drop("rows")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start")) - 1
    return dealt.withColumn("inside", inside).join(blocks, ["length", "block"]).select("doc_id", "start", "length", (F.col("before") + F.col("inside")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) placed in sequences of ``size`` tokens: (doc_id, start, length, doc_tokens, ids,
    ids_crc32, sequence_id, offset).

    A document longer than ``size`` is cut at its multiples. Null and empty texts are the end id alone. Rows of one doc_id
    are documents of their own. Only the histogram of lengths, at most ``size`` counts, reaches the driver. Without the
    column ``ids`` the texts' ids are not read again; with it they are joined to their places.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = tokenize(docs, tokenizer, end_id, size).withColumn("piece", F.monotonically_increasing_id())
    pieces = scratch.cut(pieces, "pieces")
    # A number of its own tells rows with one doc_id apart.
    lengths = pieces.select(F.col("piece").alias("doc_id"), "start", "length")
    histogram = {r["length"]: r["count"] for r in lengths.groupBy("length").count().collect()}
    table = slots(patterns(histogram, size))
    keys = (table["length"].to_numpy() << 40) + table["rank"].to_numpy()
    columns = [table[c].to_numpy() for c in ("length", "rank", "places", "sequence", "offset")]

    def run(batches):
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, (n << 40) + r, side="right") - 1
            length, first, places, sequence, offset = (c[at] for c in columns)
            turn, place = np.divmod(r - first, places)
            out = [b.column("doc_id"), pa.array(sequence + turn), pa.array(offset + place * length)]
            yield pa.RecordBatch.from_arrays(out, names=["piece", "sequence_id", "offset"])

    places = ranked(lengths).mapInArrow(run, "piece long, sequence_id long, offset long")
    return pieces.join(places, "piece").select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "sequence_id", "offset")
