"""SimHash near-duplicates: 64-bit fingerprints linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.batches import sliced
from readloom.plans.components import connected_components
from readloom.plans.store import Scratch

SHINGLE = 3
RADIUS = 3
#: First and one past the last bit of the three segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 42), (42, 64))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text (UTF-8); 0 if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=n)
    return int(np.packbits(majority(hashes), bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """Which of the 64 bits are set in over half the hashes, from the lowest bit on."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so many rows of 64 bytes at a time
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones > len(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long. A null text counts as one without words."""

    def run(batches):
        for b in sliced(batches):
            fps = np.fromiter((fingerprint(x, shingle) for x in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]))


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(fp: Column, radius: int) -> Column:
    """The keys under which a fingerprint is dealt out.

    Two fingerprints at distance 2 or less share a word at distance 1 or less from both, so up to that distance each
    emits itself and its 64 neighbours. A distance of 3 has no such middle word. Of three segments, though, one then
    holds at least one of the differing bits, and without it 2 remain: so each fingerprint emits, for each segment left
    out, itself and its neighbours in the other bits.
    """
    every = (1 << 64) - 1
    kept = [every] if radius <= 2 else [every ^ ((1 << b) - (1 << a)) for a, b in SEGMENTS]
    flips = [0, *(1 << i for i in range(64))]
    return F.array(*(fp.bitwiseAND(F.lit(_long(k))).bitwiseXOR(F.lit(_long(f))) for k in kept for f in flips if f & k == f))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct values of ``fps.fp`` that differ in at most ``radius`` bits (0 to 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    # Few bytes make many rows here: as many tasks as a shuffle has, whatever the size of the fingerprints.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = fps.select("fp").distinct().repartition(tasks).select("fp", F.explode(_ball(F.col("fp"), radius)).alias("key"))
    a, b = balls.select("key", F.col("fp").alias("u")), balls.select("key", F.col("fp").alias("v"))
    # By sorting: Spark takes the keys to be as small as the fingerprints they come from, and would broadcast them.
    near = a.join(b.hint("merge"), "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
    return near.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): each document, its fingerprint as 16 hex digits, the smallest doc_id
    that it reaches by links of at most ``radius`` differing bits, and how many other fingerprints its own is linked to.

    Fingerprints are grouped first, so a group of equal texts, however large, is one node. Texts that are null, empty or
    without words have fingerprint zero and are linked like any other. Rows with one doc_id are each returned; a null
    doc_id is returned and never names a component, unless its component has no other. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(docs, shingle), "fps")
    classes = scratch.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = scratch.cut(links(classes, radius), "links")
    ends = found.select(F.col("u").alias("fp")).unionByName(found.select(F.col("v").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = connected_components(found, scratch).withColumnRenamed("node", "fp")
    linked = roots.join(classes, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    nodes = classes.join(named, "fp", "left").join(ends, "fp", "left")
    nodes = scratch.cut(nodes.select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "nodes")
    scratch.drop(*(set(scratch.paths) - {"fps", "nodes"}))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(nodes, "fp").select("doc_id", hexed, "component_id", "n_links")
