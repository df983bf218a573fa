"""Near-duplicates by word shingles: SimHash words gather pairs by ball hashing, and the shingles decide each pair."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.batches import sliced
from readloom.plans.components import connected_components
from readloom.llm.simhash import majority
from readloom.plans.store import Scratch

SHINGLE = 5
SIMILARITY = 0.8
#: Independent SimHash words of a text and their bits. Two texts meet if one of their words differs in 2 bits at most.
WORDS, BITS = 6, 44
#: Words of the beginning and of the end of a text, so that texts that differ in one stretch meet: these must be equal. They are
#: of the two largest sizes LEAST_PART * GRID^i up to PART of the text. A stretch that leaves a similarity of 0.8 holds a
#: ninth of the text, and so leaves four ninths before or behind it as they are; texts so alike share a size.
LEAST_PART, GRID, PART = 8, 1.25, 0.42
#: Longs of the parity sketch by which pairs are sorted out before their shingles are compared: these at least, and more for
#: texts of more shingles than they have bits.
LONGS = 32
_MIX = np.random.default_rng(42).integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles (UTF-8); a text of fewer words, or none, is one shingle."""
    words = (text or b"").lower().split()
    if len(words) < shingle:
        each = iter([b" ".join(words)])
    else:
        each = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(42)), dtype="<u8", count=n))


def simhash_bits(hashes: np.ndarray, longs: int) -> np.ndarray:
    """64 * ``longs`` bits of the SimHash of a set of hashes: each 64 from the hashes mixed anew."""
    out = []
    for k in range(longs):
        x = hashes * _MIX[k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out.append(majority(x))
    return np.concatenate(out)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits, a power of two of them and no fewer than hashes or 64 * LONGS: whether an odd number of the hashes falls on each.

    Two sets differ in as many elements at least as their sketches differ in bits, so a bound on the one is a bound on the
    other without error. A sketch folded in half is the one of half the size.
    """
    m = max(64 * LONGS, 1 << (len(hashes) - 1).bit_length())
    return np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1


def _packed(bits: np.ndarray) -> list[int]:
    wide = np.zeros((len(bits), 64), dtype=bool)
    wide[:, :BITS] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def part_sizes(n: int) -> list[tuple[int, int]]:
    """(number, size) of the parts of a text of n words; none if it has too few."""
    last = int(math.log(max(PART * n / LEAST_PART, 0.5)) // math.log(GRID))
    return [(i, int(LEAST_PART * GRID**i)) for i in range(max(0, last - 1), last + 1)]


def simhash_words(text: bytes | None) -> list[int | None]:
    """WORDS SimHash words of BITS bits over the distinct words of a text, and one of each of its parts, at the place of its
    size's number: even or odd, of the beginning or the end. A changed word changes one of them and five shingles, so texts of similar
    shingles are nearer by their words than by their shingles."""
    words = (text or b"").lower().split() or [b""]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), dtype="<u8", count=len(words))
    out: list[int | None] = _packed(simhash_bits(np.unique(hashes), -(-WORDS * BITS // 64))[: WORDS * BITS].reshape(WORDS, BITS))
    parts: list[int | None] = [None] * 4
    for number, size in part_sizes(len(words)):
        both = [simhash_bits(np.unique(x), 1)[:BITS] for x in (hashes[:size], hashes[-size:])]
        for end, word in enumerate(_packed(np.stack(both))):
            parts[2 * (number % 2) + end] = (word ^ xxhash.xxh64_intdigest(str(size))) & ((1 << BITS) - 1)
    return out + parts


def _text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid")


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, words) of each row."""

    def run(batches):
        for b in sliced(batches):
            words = pa.array([simhash_words(x) for x in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words], names=["doc_id", "tid", "words"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, tid long, words array<long>")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(tid, hashes, n, sketch) of the texts in ``ids`` (tid): shingles, their number, and their parity sketch as longs."""

    def run(batches):
        for b in sliced(batches):
            sets = [shingles(x, shingle) for x in b.column(1).to_pylist()]
            bits = [np.packbits(parity_sketch(x).astype(bool), bitorder="little").view("<i8") for x in sets]
            out = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int32()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=["tid", "hashes", "n", "sketch"])

    slim = docs.select(_text_id(), F.col("text").cast("binary").alias("text")).join(ids.hint("merge"), "tid", "left_semi")
    return slim.groupBy("tid").agg(F.first("text").alias("text")).mapInArrow(run, "tid long, hashes array<long>, n int, sketch array<long>")


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ, the larger one folded once if their sizes aren't the same."""
    x, y = F.col(a), F.col(b)
    short = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, LONGS)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))
    n = F.least(F.size(x), F.size(y))

    def folded(s: Column) -> Column:
        head = F.slice(s, F.lit(1), n)
        return F.when(F.size(s) == n, head).otherwise(F.zip_with(head, F.slice(s, n + 1, n), lambda p, q: p.bitwiseXOR(q)))

    long = F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    return F.when(F.greatest(F.size(x), F.size(y)) == LONGS, short).otherwise(long)


def _may_be_near(similarity: float) -> Column:
    """False only for texts (nx, sx and ny, sy: their number of shingles and sketch) that are below the similarity: sets of
    similarity s differ in (1 - s) / (1 + s) of the sum of their sizes at most, and in size by less than half."""
    differ = (1 + similarity) * _apart("sx", "sy") <= (1 - similarity) * (F.col("nx") + F.col("ny")) + 0.001  # for rounding
    return (F.least("nx", "ny") >= similarity * F.greatest("nx", "ny")) & differ


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of texts whose shingles have the similarity or more."""
    x = sets.select(F.col("tid").alias("u"), F.col("hashes").alias("hx"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    y = sets.select(F.col("tid").alias("v"), F.col("hashes").alias("hy"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    near = pairs.join(x, "u").join(y, "v").where(_may_be_near(similarity))
    same = F.size(F.array_intersect("hx", "hy"))
    return near.where(same >= similarity * (F.col("nx") + F.col("ny") - same)).select("u", "v")


def _first_meeting(x: str, y: str, key: Column) -> Column:
    """Whether two texts with the words ``x`` and ``y`` meet under their common ``key`` first: in the first pair of words
    that differ in 2 bits at most, or are equal if they are of parts, and under one of the keys that these share. It makes one
    pair of many."""
    k = F.shiftrightunsigned(key, BITS)
    first = F.lit(WORDS + 4)
    for i in reversed(range(WORDS + 4)):
        first = F.when(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) <= (2 if i < WORDS else 0), i).otherwise(first)
    a, b = F.get(x, k.cast("int")), F.get(y, k.cast("int"))
    value = key.bitwiseAND(F.lit((1 << BITS) - 1))
    differ = a.bitwiseXOR(b)
    one = differ.bitwiseAND(-differ)  # the lowest of the differing bits
    # Equal words share all keys, words 1 apart their own two, words 2 apart the two between them.
    least = F.when(differ == 0, a).when(differ == one, F.least(a, b)).otherwise(F.least(a.bitwiseXOR(one), b.bitwiseXOR(one)))
    return (value == least) & (k == first)


def links(docs: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, similarity: float) -> DataFrame:
    """Pairs (u, v) of distinct texts of the similarity or more, enough to connect all that meet.

    Each text emits every SimHash word and its one-bit variants, and the words of its parts as they are; texts with a key in
    common meet. A text is first held
    against the first and the last under its keys, one of each a word. Then those that aren't in the group of a key's
    first text are held against all others of the key: pairs within a group are connected already. A large group of near
    copies so costs no more than its texts, and no pair under a key is left out unless its two texts are connected.
    """
    word = F.shiftleft(F.col("k").cast("long"), BITS).bitwiseOR(F.col("word")).alias("own")
    members = scratch.cut(texts.select("tid", F.posexplode("words").alias("k", "word")).where("word is not null").select("tid", word), "members")
    classes = scratch.cut(members.groupBy("own").agg(F.count("*").alias("n")), "classes")
    flips = [0, *(1 << i for i in range(BITS))]
    # Few bytes make many rows: as many tasks as a shuffle has, whatever the size of the words.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = classes.where(F.shiftrightunsigned("own", BITS) < WORDS)
    balls = whole.select("own").repartition(tasks).select("own", F.explode(F.array(*(F.col("own").bitwiseXOR(F.lit(f)) for f in flips))).alias("key"))
    # Each word once, so a key has BITS + 1 rows at most and no task more than its share. Dealt out by key once, for both
    # the sums and the join.
    balls = balls.repartition(tasks, "key")
    # Two words share two keys, or all if they are equal. They meet under the lesser one alone, which is the one where the
    # higher of their two flipped bits isn't set; so of a key's words those stay that meet another one there.
    flip = F.col("own").bitwiseXOR(F.col("key"))
    unset = flip.bitwiseAND(F.col("key")) == 0
    shared = balls.groupBy("key").agg(F.count("*").alias("n"), F.min(flip).alias("least"), F.max(F.when(unset, flip)).alias("top"))
    met = balls.join(shared.where("n > 1").drop("n").hint("merge"), "key").where((F.col("top") > flip) | unset & (F.col("least") < flip))
    met = met.select("key", "own").unionByName(classes.where("n > 1").select(F.col("own").alias("key"), "own"))
    met = scratch.cut(met.distinct(), "met")
    hits = scratch.cut(met.join(members, "own").select("key", "tid"), "hits")
    # A table of its own, so that adaptive execution can split a key's texts in the join.
    ends = scratch.cut(hits.groupBy("key").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")), "ends")
    hits = scratch.cut(hits.join(ends, "key"), "dealt")
    scratch.drop("members", "classes", "met", "hits", "ends")

    def other(end: str) -> Column:
        return F.when(F.col(end) != F.col("tid"), F.col(end))

    star = hits.groupBy("tid", F.shiftrightunsigned("key", BITS).alias("k")).agg(F.min(other("lo")).alias("lo"), F.max(other("hi")).alias("hi"))
    star = star.select("tid", F.explode(F.array("lo", "hi")).alias("end")).where("end is not null")
    pairs = scratch.cut(star.select(F.least("tid", "end").alias("u"), F.greatest("tid", "end").alias("v")).distinct(), "pairs")
    sets = scratch.cut(_sets(docs, hits.select("tid").distinct(), shingle), "sets")
    found = scratch.cut(_verified(pairs, sets, similarity), "found")
    roots = scratch.cut(connected_components(found, scratch), "roots")
    placed = hits.select("key", "tid", "lo").join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    placed = placed.join(roots.select(F.col("node").alias("lo"), F.col("root").alias("main")), "lo", "left")
    placed = placed.withColumn("out", F.col("root") != F.coalesce("main", "lo"))
    placed = placed.join(sets.select("tid", "n", "sketch"), "tid").join(texts.select("tid", "words"), "tid")
    placed = scratch.cut(placed.select("key", "tid", "root", "out", "n", "sketch", "words"), "placed")
    scratch.drop("dealt", "roots")
    x = placed.where("out").toDF("key", "tidx", "rootx", "outx", "nx", "sx", "wx").drop("outx")
    y = placed.toDF("key", "tidy", "rooty", "outy", "ny", "sy", "wy")
    # A pair of two outsiders comes once from each.
    apart = (F.col("rootx") != F.col("rooty")) & (~F.col("outy") | (F.col("tidx") < F.col("tidy")))
    rest = x.join(y, (x["key"] == y["key"]) & apart & _first_meeting("wx", "wy", x["key"]) & _may_be_near(similarity))
    rest = rest.select(F.least("tidx", "tidy").alias("u"), F.greatest("tidx", "tidy").alias("v"))
    rest = scratch.cut(rest.join(pairs.hint("merge"), ["u", "v"], "left_anti").distinct(), "rest")
    scratch.drop("placed", "pairs")
    out = scratch.cut(found.unionByName(_verified(rest, sets, similarity)), "links")
    scratch.drop("sets", "found", "rest")
    return out


def _components(docs: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid) of each row, and (tid, root, rep): the component of each distinct text, and the smallest doc_id that has it."""
    if similarity < SIMILARITY:
        raise ValueError(f"similarity must be {SIMILARITY} or more")
    sketches = scratch.cut(_sketches(docs), "sketches")
    texts = scratch.cut(sketches.groupBy("tid").agg(F.min("doc_id").alias("rep"), F.first("words").alias("words")), "texts")
    found = links(docs, texts, scratch, shingle, similarity)
    roots = scratch.cut(connected_components(found, scratch), "nodes").withColumnRenamed("node", "tid")
    named = texts.select("tid", "rep").join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    return sketches.select("doc_id", "tid"), scratch.cut(named, "named")


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of each row: the smallest doc_id that it reaches by links of the similarity or more."""
    scratch = Scratch(docs.sparkSession, "similar")
    rows, named = _components(docs, shingle, similarity, scratch)
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("tid", "component_id")
    out = scratch.cut(rows.join(named, "tid").select("doc_id", "component_id"), "groups")
    scratch.drop(*(set(scratch.paths) - {"groups"}))
    return out


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates: the first by doc_id, of one doc_id by the hash of its text; a row with a null
    doc_id only if all are. Rows are told apart by doc_id and text, so that another text under a doc_id that goes isn't
    touched; of rows that agree in both one stays, the first by the other columns."""
    scratch = Scratch(docs.sparkSession, "similar-keep")
    rows, named = _components(docs, shingle, similarity, scratch)
    each = rows.join(named.select("tid", "root"), "tid").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid").alias("row"))
    kept = scratch.cut(each.groupBy("root").agg(F.min("row").alias("row")).select("row.*"), "kept")
    scratch.drop(*(set(scratch.paths) - {"kept"}))
    key = ["_none", "_id", "_tid"]
    kept = kept.select(F.col("none").alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("tid").alias("_tid"))
    marked = docs.select("*", F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), _text_id().alias("_tid"))
    found = marked.join(kept.hint("merge"), key, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(*key).orderBy(*others) if others else Window.partitionBy(*key).orderBy("_id")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*docs.columns)
