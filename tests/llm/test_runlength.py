import random
from collections import Counter

import numpy as np
import pytest

from readloom.llm import runlength as R


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(b and not a for a, b in zip(b"\0" + bytes(gone), gone))
        out.append((d is None, d or 0, bytes(b for b, g in zip(t, gone) if not g), len(t), sum(gone), spans))
    return sorted(out)


def test_index_like_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(60):
        base = bytes(rng.integers(97, 99 if trial % 3 else 104, 60).astype(np.uint8))
        strings = set()
        for _ in range(rng.integers(1, 12)):
            t = bytearray(base[rng.integers(0, 20) : rng.integers(30, 60)])
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(0, len(t))] = 97 + rng.integers(0, 3)
            strings.add(bytes(t))
        strings, length = sorted(strings, key=hash), int(rng.integers(3, 15))
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, runs in zip(strings, R.repeated_windows(strings, length)):
            got = {i for a, b in runs for i in range(a, b)}
            assert got == {i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1}


def texts():
    rng = random.Random(8)

    def words(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(2, 9))) for _ in range(n))

    shared, base = words(60), words(300)
    rows = [(1, base), (2, base), (3, base[:700] + "X" + base[701:]), (4, None), (5, ""), (6, "short"), (7, "a" * 500), (8, shared * 3)]
    rows += [(20 + i, f"{words(20)} {shared} {words(20)}") for i in range(30)] + [(None, base[100:500]), (60, words(20_000)), (20, words(50)), (61, shared[:199]), (62, shared[:200])]
    return rows + [rows[-1]]


@pytest.mark.parametrize("many", [R.MANY, 3])
def test_like_brute_force(spark, make_docs, monkeypatch, many):
    monkeypatch.setattr(R, "MANY", many)
    monkeypatch.setattr(R, "CHUNK_BYTES", 3000)
    got = R.remove_repeats(make_docs(texts())).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got) == brute(texts(), 200)


def test_long_single_text(monkeypatch):
    monkeypatch.setattr(R, "_PLACE", np.uint64(R._PLACE))
    t = bytes(np.random.default_rng(0).integers(97, 123, 20_000_000).astype(np.uint8))
    doc, first, wins, _, _ = R.contexts([t])
    assert wins.sum() == len(t) - 199 and (first[1:] == (first + wins)[:-1]).all() and not doc.any()


@pytest.mark.parametrize("gram", [64, 128, 200])
def test_texts_over_many_parts(monkeypatch, gram):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 10_150, 199, 200, 5_000, 0, 7_077, 4_196)] + [b"a" * 9_000]
    want = R.contexts(texts, gram=gram)
    for size in (1 << 12, 5_000, 4_996, 1_000):
        monkeypatch.setattr(R, "CHUNK_BYTES", size)
        assert all((x == y).all() for x, y in zip(R.contexts(texts, gram=gram), want))
    for more in range(60, 210, 10):  # the last window's anchor lies behind the last part's windows
        t = texts[1][: 2 * 4_000 + more]
        monkeypatch.setattr(R, "CHUNK_BYTES", 4_000)
        assert R.contexts([t])[2].sum() == len(t) - 199


def test_empty(spark, make_docs):
    assert R.remove_repeats(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        R.remove_repeats(make_docs([]), 64)
