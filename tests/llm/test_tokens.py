import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readloom.llm import packing, sstable
from readloom.llm.tokens import Encoder, encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "a", " a  b\t c\n\nd ", "it's they'll 'x", "ÉTÉ œuf İstanbul ΣΑΣ ß", "é ́x", "a b c", "x\x1cy\x1d z", "<|endoftext|> a<|endoftext|>", "1234 5,6 ...!!!", "日本語 テスト", "a,b. c; d: e! f?", "😀 👨‍👩‍👧", "ªº ŉ ǆ"]


def ids(name, text):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    for t in ODD:
        assert np.frombuffer(encoder(P.path(name)).encode(t), "<u4").tolist() == ids(name, t), t


@pytest.mark.parametrize("name", FILES)
def test_any_text(name):
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("abcÉß .,'\n\t́ \x1c1"), st.characters(blacklist_categories=["Cs"])), max_size=40))
    def check(t):
        assert np.frombuffer(encoder(P.path(name)).encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids

    check()


ROWS = [(5, "hello world"), (-3, "a b c " * 3000), (None, "null id"), (7, None), (8, ""), (5, "again, same id"), (2**40, "far"), (5, "hello world")]


def test_sstable_round_trip(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    manifest = sstable.write(make_docs(ROWS), P.path(FILES[0]), 2, path, shard_bytes=4000)
    rows = sstable.with_start(sstable.read(manifest, path).withColumnRenamed("ids", "data"), manifest).collect()
    want, at = [], 0
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = np.array([*ids(FILES[0], t or ""), 2], "<u4")
        want.append((d, at, len(x), x.tobytes()))
        at += len(x)
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.data)) for r in rows), key=lambda r: r[1]) == want
    assert manifest.count() > 1


def test_sstable_lookup():
    w = sstable.ShardWriter(2)
    data = {i * 7 - 300: np.arange(i % 50, dtype="<u2") for i in range(3000)}
    for k, v in sorted(data.items()):
        w.add(k, v.tobytes())
    blob = w.finish()
    s = sstable.Shard(blob)
    assert len(s.blocks) > 1 and s.docs == 3000 and s.tokens == sum(map(len, data.values()))
    assert all([x.tolist() for x in s.get(k)] == [data[k].tolist()] for k in list(data)[::37])
    assert s.get(-301) == [] and sum(s.may_hold(i * 7 + 2) for i in range(3000)) < 150
    assert [k for k, _ in s] == sorted(data)
    bad = bytearray(blob)
    bad[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Shard(bytes(bad)))


def test_sstable_empty(spark, make_docs, tmp_path):
    manifest = sstable.write(make_docs([]), P.path(FILES[0]), 2, f"file://{tmp_path}/none")
    assert sstable.read(manifest, f"file://{tmp_path}/none").collect() == []


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(2)
    for size in (16, 100):
        for _ in range(50):
            h = {int(k): int(v) for k, v in zip(rng.integers(1, size + 1, 12), rng.integers(1, 5000, 12))}
            packs = packing.patterns(h, size)
            got = {}
            for times, held in packs:
                assert sum(k * v for k, v in held.items()) <= size
                for k, v in held.items():
                    got[k] = got.get(k, 0) + times * v
            assert got == h


@pytest.mark.parametrize("size", [8, 64])
def test_packing(spark, make_docs, size):
    rows = ROWS + [(100 + i, "w " * (i % 11)) for i in range(200)]
    got = packing.pack(make_docs(rows), P.path(FILES[1]), 2, size).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= size
    assert set(by_seq) == set(range(len(by_seq)))
    want = {}
    for d, t in rows:
        x = np.array([*ids(FILES[1], t or ""), 2], "<u4")
        want.setdefault(d, []).extend((i, x[i : i + size].tobytes()) for i in range(0, len(x), size))
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in want.items()}
    filled = sum(r.length for r in got)
    assert filled > 0.9 * size * (len(by_seq) - 1)


def test_packing_empty(spark, make_docs):
    assert packing.pack(make_docs([]), P.path(FILES[1]), 2).collect() == []


@pytest.mark.parametrize("name", FILES)
def test_white_space_found_by_lookup(name):
    """Texts aren't searched for odd white space: a word that holds it isn't kept, and sends its text another way."""
    enc, whole = Encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    alphabet, rng = list("ab  \n\n\té.,'\x1c\r\xa0 B1"), random.Random(5)
    texts = ["\n", "\n\n", "a\n", "\na", "\n a", " a", "a ", "a \nb", "a\n\nb", "a\tb", "a\x1cb", "a b\nc d"]
    for t in texts + ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(3000)]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert not any(not p or re.search(r"\s", p) for p in [*enc.plain, *enc.spaced])
    assert name != FILES[0] or enc.odd
