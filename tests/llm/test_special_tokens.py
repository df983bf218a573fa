import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from readloom.llm import packing, sstable
from readloom.llm.tokens import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = ["a<|endoftext|>b", "<|endoftext|> a <|startoftext|>", "<|STARTOFTEXT|> x", "x <|endof text|> y", "é<|endoftext|>\n\nÉ it's", "plain words, here", "<|", ""]


@pytest.mark.parametrize("name", FILES)
def test_library_default(name):
    whole = Tokenizer.from_file(P.path(name))
    for t in TEXTS:
        assert np.frombuffer(encoder(P.path(name), special=True).encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert encoder(P.path(name)).encode(TEXTS[0]) != encoder(P.path(name), special=True).encode(TEXTS[0])


def test_operators(spark, make_docs, tmp_path):
    docs, path = make_docs(list(enumerate(TEXTS))), f"file://{tmp_path}/shards"
    want = [{i: np.array([*Tokenizer.from_file(P.path(n)).encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(TEXTS)} for n in FILES]
    got = sstable.read(sstable.write(docs, P.path(FILES[0]), 2, path), path).collect()
    assert {r.doc_id: bytes(r.ids) for r in got} == {i: x.tobytes() for i, x in want[0].items()}
    placed = packing.pack(docs, P.path(FILES[1]), 2).collect()
    assert {r.doc_id: r.ids_crc32 for r in placed} == {i: zlib.crc32(x.tobytes()) for i, x in want[1].items()}
