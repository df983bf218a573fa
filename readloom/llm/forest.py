"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest; Bawa, Condie and Ganesan, 2005)."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.plans.store import Scratch

#: Symbols of a hash string, bits of one, and the components that it is made from; vectors of a shard and queries of a block,
#: on average.
SYMBOLS, BITS, WIDTH, SHARD_ROWS, BLOCK_ROWS, SEED = 6, 5, 16, 16384, 4096, 11
#: Vectors that are hashed at a time.
HASHED = 256


@cache
def _planes(dim: int, trees: int) -> np.ndarray:
    """(dim, trees * SYMBOLS * width): for each symbol of each tree, orthonormal directions; as many as the vectors have
    components, if that is under WIDTH."""
    rng, width = np.random.default_rng(SEED), min(WIDTH, dim)
    each = [np.linalg.qr(rng.standard_normal((dim, width)))[0] for _ in range(trees * SYMBOLS)]
    return np.concatenate(each, axis=1).astype(np.float32)


class Forest:
    """Trees over vectors: for each, the sorted array of their hash strings of SYMBOLS symbols. A symbol is the one of some
    random directions, or of their opposites, that the vector lies nearest to (cross-polytope hashing; Andoni et al., 2015).

    A query descends each tree by binary search to the vectors that share its longest prefix. From there it ascends all
    trees together, one symbol at a time, until the vectors below have ``budget`` entries in the trees. The subtree of a
    prefix is a range of the sorted array, so ascending only widens ranges.
    """

    def __init__(self, vectors: np.ndarray, trees: int):
        self.planes, self.trees = _planes(vectors.shape[1], trees), trees
        hashes = self._strings(vectors)
        self.order = [np.argsort(h, kind="stable") for h in hashes]
        self.strings = [h[o] for h, o in zip(hashes, self.order)]

    def _strings(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, vectors): the strings as numbers, the first symbol in the highest bits."""
        out = np.empty((self.trees, len(vectors)), np.int64)
        large = np.abs(vectors).max(axis=1, keepdims=True)
        for at in range(0, len(vectors), HASHED):
            part = (vectors[at : at + HASHED] / large[at : at + HASHED]).astype(np.float32)
            z = (part @ self.planes).reshape(len(part), self.trees, SYMBOLS, -1)
            near = np.abs(z).argmax(axis=3)
            symbol = 2 * near + (np.take_along_axis(z, near[..., None], axis=3)[..., 0] > 0)
            out[:, at : at + HASHED] = (symbol << BITS * np.arange(SYMBOLS - 1, -1, -1)).sum(axis=2).T
        return out

    def candidates(self, queries: np.ndarray, budget: int):
        """For each query, the numbers of the vectors that it reaches."""
        hashes = self._strings(queries)
        depth = np.zeros(len(queries), dtype=np.int64)
        open_ = np.ones(len(queries), dtype=bool)
        for d in range(SYMBOLS, -1, -1):
            lo, hi = self._ranges(hashes, np.full(len(queries), d))
            enough = open_ & ((hi - lo).sum(axis=0) >= budget)
            depth[enough] = d
            open_ &= ~enough
            if not open_.any():
                break
        lo, hi = self._ranges(hashes, depth)
        for q in range(len(queries)):
            yield np.unique(np.concatenate([o[lo[t, q] : hi[t, q]] for t, o in enumerate(self.order)]))

    def _ranges(self, hashes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = BITS * (SYMBOLS - depth)
        lo = [np.searchsorted(s, h >> shift << shift) for h, s in zip(hashes, self.strings)]
        hi = [np.searchsorted(s, ((h >> shift) + 1) << shift) for h, s in zip(hashes, self.strings)]
        return np.array(lo), np.array(hi)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows whose vector has no null or non-finite component and isn't null, empty or zero; once each."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    return table.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()


def nearest(table: DataFrame, queries, k: int = 10, trees: int = 320, budget: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each row of ``table`` (vec_id, embedding) that
    the condition ``queries`` on vec_id holds for, by Euclidean distance in double precision, ties to smaller vec_id.

    Equal vectors are one entry of the index with their k + 1 smallest ids; more can't be among anyone's k nearest. They
    are cut to that before they are shuffled, however many they are, and queries with equal vectors are searched once.
    Entries are dealt to shards by hash; each shard has a forest, and blocks of queries meet each shard, so that a task
    holds SHARD_ROWS entries and BLOCK_ROWS queries on average. In a shard ``budget`` entries of the trees are reached at
    least, or all. Vectors of different lengths are never compared. Rows that repeat both vec_id and vector are one.
    """
    scratch = Scratch(table.sparkSession, "forest")
    rows = scratch.cut(usable(table), "rows")
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = entries.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v"))
    entries = scratch.cut(entries, "entries")
    asked = rows.where(queries)
    classes = asked.groupBy("v").agg(F.min("vec_id").alias("rep")).withColumn("dim", F.size("v"))
    classes = scratch.cut(classes, "classes")

    # One row for each length of vector.
    shards = entries.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards"))
    blocks = classes.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    cells = scratch.cut(shards.join(blocks, "dim"), "cells")

    def deal(n: str):
        return F.pmod(F.xxhash64(F.col("v"), F.lit(n)), F.col(n))

    left = entries.join(cells, "dim").select("dim", deal("shards").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "v", "ids")
    right = classes.join(cells, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), deal("blocks").alias("block"), "v", "rep")

    def search(key, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(e) and len(q):
            e = e.iloc[np.argsort([x[0] for x in e["ids"]], kind="stable")]
            data, asked_v = np.stack(e["v"].to_numpy()), np.stack(q["v"].to_numpy())
            forest, ids = Forest(data, trees), e["ids"].to_numpy()
            for v, rep, found in zip(asked_v, q["rep"], forest.candidates(asked_v, budget)):
                far = np.sqrt(((data[found] - v) ** 2).sum(axis=1))
                best = np.flatnonzero(far <= np.partition(far, k)[k]) if len(far) > k + 1 else np.arange(len(far))
                each = sorted((far[i], x) for i in best for x in ids[found[i]])[: k + 1]
                out += [(key[0], rep, x, d) for d, x in each]
        return pd.DataFrame(out, columns=["dim", "rep", "vec_id", "score"]).astype({"dim": "int32", "rep": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(search, "dim int, rep long, vec_id long, score double")
    order = Window.partitionBy("dim", "rep").orderBy("score", "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    found = scratch.cut(found, "found")
    own = asked.join(classes, "v").select(F.col("vec_id").alias("query_id"), "dim", "rep")
    each = Window.partitionBy("query_id", "dim", "rep").orderBy("score", "vec_id")
    pairs = own.join(found, ["dim", "rep"]).where("vec_id <> query_id").withColumn("rank", F.row_number().over(each))
    return pairs.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
