"""Lloyd's k-means by two trees (dual-tree k-means; Curtin, 2017): one over vectors, built once, and one over centroids, built
each round. Pairs of nodes are pruned by bounds on their distance, and what is left at the leaves is compared exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.vectors import in_tasks, matrix, whole_numbers
from readloom.plans.store import Scratch

#: Vectors under one tree, points of a leaf, and how much nearer children lie than the farthest point of their node.
BLOCK, LEAF, BASE = 2048, 24, 1.3
#: Differences that are held at a time.
CELLS = 1 << 21
#: Bounds are held to be equal within this share, so that rounding never prunes a tie.
SLACK = 1e-9


class CoverTree:
    """A simplified cover tree (Izbicki and Shelton, 2015) over the rows of a matrix.

    A node has a point of its own as centre and covers all its points within ``radius``. Children lie within radius / BASE of
    their centres, which are farther than that from one another. Children of a single point are held by the node
    itself, as are all points of a leaf. Points are reordered so that a node's are the rows lo to hi, its own first
    (lo to own); nodes come parents first, and ``after`` is the number of the first node that isn't below.
    """

    def __init__(self, points: np.ndarray):
        order: list[np.ndarray] = []
        nodes: list[list] = []
        values, placed = points.astype(np.float64), 0

        def build(at: np.ndarray, far: np.ndarray) -> None:
            nonlocal placed
            radius = far.max()
            node = [at[0], radius, placed, placed, placed, 0]
            nodes.append(node)
            groups, own = [], at
            if len(at) > LEAF and radius > 0:
                reach, rest, d, single = radius / BASE, at, far, []
                while len(rest):
                    near = d <= reach
                    (groups if near.sum() > 1 else single).append((rest[near], d[near]))
                    rest = rest[~near]
                    if len(rest):
                        d = np.sqrt(((values[rest] - values[rest[0]]) ** 2).sum(axis=1))
                own = np.concatenate([*(g for g, _ in single), at[:0]])
            order.append(own)
            placed += len(own)
            node[3] = placed
            for g, d in groups:
                build(g, d)
            node[4], node[5] = placed, len(nodes)

        if len(points):
            build(np.arange(len(points)), np.sqrt(((values - values[0]) ** 2).sum(axis=1)))
        self.order = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        table = np.array(nodes, np.float64).reshape(-1, 6)
        self.center = back[table[:, 0].astype(np.int64)]
        self.radius = table[:, 1]
        self.lo, self.own, self.hi, self.after = table[:, 2:].astype(np.int64).T

    def children(self, node: int) -> Iterator[int]:
        at = node + 1
        while at < self.after[node]:
            yield at
            at = int(self.after[at])


class Block:
    """The vectors of one tree in the tree's order, with running sums, so that a whole node is added in one step."""

    def __init__(self, vectors: np.ndarray, tree: CoverTree):
        self.vectors, self.tree = vectors.astype(np.int64), tree
        self.sums = np.zeros((len(vectors) + 1, vectors.shape[1]), np.int64)
        np.cumsum(self.vectors, axis=0, out=self.sums[1:])
        self.centers = self.vectors[tree.center].astype(np.float64)


class Centroids:
    """The tree over a round's centroids; numbers are those of the unordered centroids."""

    def __init__(self, centroids: np.ndarray):
        self.tree = CoverTree(centroids)
        self.number = self.tree.order
        self.values = centroids[self.number].astype(np.int64)
        self.places = self.values.astype(np.float64)
        # A candidate is a node, or a single centroid: a point of radius 0 behind the nodes.
        t, n = self.tree, len(self.tree.center)
        self.at = np.concatenate([t.center, np.arange(len(centroids))])
        self.radius = np.concatenate([t.radius, np.zeros(len(centroids))])
        self.nodes = n
        self.below = [[*range(n + t.lo[i], n + t.own[i]), *t.children(i)] for i in range(n)]

    def nearest(self, b: Block) -> Iterator[tuple[int, int, np.ndarray | int]]:
        """(lo, hi, place): rows lo to hi of the block and the place of the centroid nearest to them, or one of each."""
        tree, todo = b.tree, [(0, np.array([0]))] if len(b.tree.center) else []
        while todo:
            q, found = todo.pop()
            radius = tree.radius[q]
            while True:
                far = np.sqrt(((self.places[self.at[found]] - b.centers[q]) ** 2).sum(axis=1))
                # Some centroid is no farther from any point of the node than this.
                most = (far + radius).min()
                found = found[far - radius - self.radius[found] <= most * (1 + SLACK) + SLACK]
                wide = [c for c in found if c < self.nodes and (self.radius[c] >= radius or not self.radius[c] or tree.own[q] > tree.lo[q])]
                if not wide:
                    break
                found = np.array(sorted({*found.tolist()} - {*wide} | {x for c in wide for x in self.below[c]}))
            if len(found) == 1 and found[0] >= self.nodes:
                yield int(tree.lo[q]), int(tree.hi[q]), int(found[0]) - self.nodes
                continue
            lo, own = int(tree.lo[q]), int(tree.own[q])
            if own > lo:
                # With points of its own a node's candidates have all come down to single centroids.
                each = np.sort(found - self.nodes)
                each = each[np.argsort(self.number[each], kind="stable")]
                rows = max(1, CELLS // (len(each) * self.values.shape[1]))
                for at in range(lo, own, rows):
                    to = min(own, at + rows)
                    d = ((b.vectors[at:to, None, :] - self.values[None, each, :]) ** 2).sum(axis=2)
                    yield at, to, each[d.argmin(axis=1)]
            todo += [(c, found) for c in tree.children(q)]


def _packed(df: DataFrame, dim: int) -> DataFrame:
    """Vectors (vec_id, v) in blocks, a row a block, each with its tree; a block is made of rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                held.append(b.slice(at, BLOCK))
                if sum(x.num_rows for x in held) >= BLOCK:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    def pack(held):
        table = pa.Table.from_batches(held)
        ids, v = table.column(0).combine_chunks(), np.concatenate([matrix(b.column(1), dim) for b in held])
        tree = CoverTree(v)
        nodes = np.stack([tree.center, tree.lo, tree.own, tree.hi, tree.after]).astype(np.int64)
        row = {"ids": [ids.take(pa.array(tree.order)).to_pylist()], "v": [v[tree.order].tobytes()], "nodes": [nodes.tobytes()], "radius": [tree.radius.tobytes()]}
        return pa.RecordBatch.from_pydict(row, schema=_BLOCK)

    return df.mapInArrow(run, "ids array<long>, v binary, nodes binary, radius binary")


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("nodes", pa.binary()), ("radius", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Block]]:
    for b in batches:
        for ids, v, nodes, radius in zip(*(b.column(c) for c in ("ids", "v", "nodes", "radius"))):
            tree = CoverTree.__new__(CoverTree)
            tree.center, tree.lo, tree.own, tree.hi, tree.after = np.frombuffer(nodes.as_py(), np.int64).reshape(5, -1)
            tree.radius = np.frombuffer(radius.as_py())
            yield ids.values, Block(np.frombuffer(v.as_py(), np.int32).reshape(-1, dim), tree)


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors moves to the floor of their mean. What tasks send is a row a centroid."""
    k, dim = centroids.shape

    def run(batches):
        tree, sums, n = Centroids(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, b in _blocks(batches, dim):
            for lo, hi, at in tree.nearest(b):
                if isinstance(at, int):
                    sums[tree.number[at]] += b.sums[hi] - b.sums[lo]
                    n[tree.number[at]] += hi - lo
                else:
                    np.add.at(sums, tree.number[at], b.vectors[lo:hi])
                    np.add.at(n, tree.number[at], 1)
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(k, dtype=np.int32), "parts": pa.array([[*map(int, s), int(c)] for s, c in zip(sums, n)], pa.list_(pa.int64()))})

    parts = blocks.mapInArrow(run, "cluster int, parts array<long>").select("cluster", F.posexplode("parts"))
    moved = centroids.copy()
    total: dict[tuple[int, int], int] = {(r[0], r[1]): int(r[2]) for r in parts.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)"))).collect()}
    for c in range(k):
        if n := total.get((c, dim), 0):
            moved[c] = [total[c, d] // n for d in range(dim)]
    return moved


def lloyd(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row of ``table`` (vec_id, embedding)
    whose vector has ``dim`` components, none null, non-finite or of 2^24 or more once scaled; others take no part.

    Components become floor(scale * x). Centroids 0, 1, ... start as the ``k`` vectors with the smallest sha256 of
    ``<seed>:<vec_id>``, all if there are fewer; equal ids are told apart by their vectors, and a row without vec_id is
    clustered but no start. Each round assigns every vector to the nearest centroid, ties to the smaller number, and moves
    each centroid that has vectors to the floor of their mean. Repeated rows count each time. An empty table gives no rows.

    Vectors are packed in blocks of BLOCK with a tree each, written once. A round is one scan of them: each task sends a
    sum a centroid, and only those, k * dim numbers, reach the driver.
    """
    scratch = Scratch(table.sparkSession, "dualtree")
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers("embedding", scale).alias("v")).where(F.size("v") == dim)
    kept = scratch.cut(in_tasks(kept), "kept")
    start = kept.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = start.orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dim)
    blocks = scratch.cut(_packed(kept, dim), "blocks")
    if len(centroids) == 0:
        blocks = blocks.limit(0)
    else:
        for _ in range(rounds):
            centroids = _round(blocks, centroids)

    def assign(batches):
        tree = Centroids(centroids)
        for ids, b in _blocks(batches, dim):
            at = np.empty(len(b.vectors), np.int64)
            for lo, hi, place in tree.nearest(b):
                at[lo:hi] = place
            d = ((b.vectors - tree.values[at]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(tree.number[at].astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    placed = scratch.cut(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "placed")
    inertia = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = inertia.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # k rows
    sha = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    each = table.sparkSession.createDataFrame(sha, "cluster int, centroid_sha256 string").join(inertia, "cluster")
    each = F.broadcast(each)  # k rows
    return placed.join(each, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
