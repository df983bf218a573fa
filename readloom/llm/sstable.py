"""Token ids in sorted-string-table shards, looked up by document identifier.

A shard is a run of documents in ascending order of their keys::

    blocks   entries of about BLOCK_BYTES each, then the CRC-32 of the block (4 bytes)
             entry: bytes shared with the key before it, other key bytes, value bytes (three varints), key rest, value
    index    for each block: key bytes (varint), its last key, offset, length and ids before it in the shard (u64 each)
    filter   Bloom filter over the keys: number of hashes (u32), then the bits
    footer   offset and length of index and filter, documents, ids, bytes an id (u64 each), magic (8 bytes)

Integers are little-endian. A key is one byte (0: null, 1: not) and the identifier as a big-endian integer whose order
as bytes is its order as a number. A value is the document's ids, two bytes each if the vocabulary allows, else four.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.batches import sliced
from readloom.plans.store import new_path
from readloom.llm.tokens import encoder

MAGIC = b"RLOOMSS1"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
BITS_PER_KEY, HASHES = 10, 7
_FOOTER = struct.Struct("<7Q8s")


def _key(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def _doc_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bits(keys: np.ndarray, n_bits: int, hashes: int) -> np.ndarray:
    """The bits of each key's hash: double hashing from its two halves."""
    a, b = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(n_bits)


class ShardWriter:
    """Collects documents in ascending key order; ``finish`` gives the bytes of the shard."""

    def __init__(self, width: int):
        self.width, self.out, self.block = width, bytearray(), bytearray()
        self.last, self.index, self.hashes = b"", [], []
        self.docs = self.tokens = self.before = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian, of the shard's width."""
        key = _key(doc_id)
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last))) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.docs += 1
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, len(self.out), len(self.block), self.before))
            self.out += self.block
            self.block, self.before = bytearray(), self.tokens

    def __len__(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._close()
        at, index = len(self.out), b"".join(_varint(len(k)) + k + struct.pack("<3Q", *x) for k, *x in self.index)
        n_bits = max(64, -(-len(self.hashes) * BITS_PER_KEY // 8) * 8)
        bits = np.zeros(n_bits, dtype=bool)
        if self.hashes:
            bits[_bits(np.array(self.hashes, dtype=np.uint64), n_bits, HASHES).astype(np.int64).ravel()] = True
        bloom = struct.pack("<I", HASHES) + np.packbits(bits, bitorder="little").tobytes()
        foot = _FOOTER.pack(at, len(index), at + len(index), len(bloom), self.docs, self.tokens, self.width, MAGIC)
        return bytes(self.out) + index + bloom + foot


class Shard:
    """Reads the bytes of one shard."""

    def __init__(self, data: bytes):
        self.data = data
        at, n, bloom, m, self.docs, self.tokens, self.width, magic = _FOOTER.unpack(data[-_FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = data[bloom : bloom + m]
        self.keys, self.blocks, end = [], [], at + n
        while at < end:
            k, at = _read_varint(data, at)
            self.keys.append(data[at : at + k])
            self.blocks.append(struct.unpack_from("<3Q", data, at + k))
            at += k + 24

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        off, n, _ = self.blocks[block]
        body = self.data[off : off + n - 4]
        if zlib.crc32(body) != struct.unpack_from("<I", self.data, off + n - 4)[0]:
            raise ValueError(f"block {block} is damaged")
        key, at = b"", 0
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(len(self.blocks)):
            for key, value in self._entries(b):
                yield _doc_id(key), self._ids(value)

    def may_hold(self, doc_id: int | None) -> bool:
        hashes = struct.unpack_from("<I", self.bloom)[0]
        n_bits = (len(self.bloom) - 4) * 8
        h = np.array([xxhash.xxh64_intdigest(_key(doc_id))], dtype=np.uint64)
        return all(self.bloom[4 + int(i) // 8] >> (int(i) % 8) & 1 for i in _bits(h, n_bits, hashes)[0])

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry with this identifier: Bloom filter, binary search of the index, then its block."""
        found, key = [], _key(doc_id)
        if not self.may_hold(doc_id):
            return found
        for b in range(bisect.bisect_left(self.keys, key), len(self.blocks)):
            for k, value in self._entries(b):
                if k > key:
                    return found
                if k == key:
                    found.append(self._ids(value))
        return found


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) with the file ``tokenizer``, appends ``end_id`` to each document, and writes shards
    in ascending order of doc_id under ``path``. Null doc_ids come first; rows of one doc_id are ordered by text. A null or
    empty text is the end id alone. Other columns are ignored.

    Returns the manifest (file, part, seq, n_docs, n_tokens): the shards of the attempts that Spark committed, in order of
    (part, seq). What a lost attempt left under ``path`` isn't in it. Each task holds one shard of about ``shard_bytes``.
    """

    def run(batches):
        import os
        import uuid

        from pyarrow import fs

        enc = encoder(tokenizer, special=True)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        end = np.array([end_id], dtype="<u4").tobytes()

        def put(shard: ShardWriter, seq: int) -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}-{attempt}.sst"
            with store.open_output_stream(os.path.join(base, name)) as f:
                f.write(shard.finish())
            rows = {"file": [name], "part": [part], "seq": [seq], "n_docs": [shard.docs], "n_tokens": [shard.tokens]}
            return pa.RecordBatch.from_pydict(rows, schema=_MANIFEST)

        shard, seq = ShardWriter(width), 0
        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                shard.add(doc_id, ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                if len(shard) >= shard_bytes:
                    yield put(shard, seq)
                    shard, seq = ShardWriter(width), seq + 1
        if shard.docs:
            yield put(shard, seq)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # How texts begin splits the rows of one doc_id, or of none, between tasks; whole texts aren't sampled for it.
    dealt = slim.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc_nulls_first(F.substring("text", 1, 64)))
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    manifest = ordered.mapInArrow(run, "file string, part long, seq long, n_docs long, n_tokens long")
    manifest.write.parquet(f"{path}-manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{path}-manifest")


_MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read(manifest: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(file, doc_id, at, n_tokens, ids_crc32, ids) of every document in the files under ``path``: ``at`` counts the ids
    before it in its shard, and ``ids`` holds little-endian unsigned 32-bit integers, whose checksum is ``ids_crc32``.
    Without ``with_ids`` they are null: they are read and summed, but don't leave the task. Pass the result, or what is
    made of it, to ``with_start``."""
    spark = manifest.sparkSession
    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary"
    if not manifest.limit(1).count():
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, shard, at = b.column(0)[i].as_py().rpartition("/")[2], Shard(b.column(1)[i].as_py()), 0
                rows = []
                for doc_id, ids in shard:
                    data = ids.tobytes()
                    rows.append((name, doc_id, at, len(ids), zlib.crc32(data), data if with_ids else None))
                    at += len(ids)
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(f"{path}/*.sst").select("path", "content")
    return files.mapInArrow(run, schema)


def with_start(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """``rows`` of the manifest's shards with ``start``, the ids of all documents before each, for ``file`` and ``at``.

    Call it when the ids are no longer needed, as the join may shuffle ``rows``.
    """
    # One row a shard, thus 1 / SHARD_BYTES of the data: a running sum over them all is small.
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "file").withColumn("start", F.col("before") + F.col("at")).drop("file", "at", "before")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])


def write_new(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """``write`` to a new folder beside the cluster's checkpoints: the manifest and the folder."""
    path = new_path(docs.sparkSession, "shards")
    return write(docs, tokenizer, end_id, path), path
