"""Token ids of whole texts by a ``tokenizers`` file, with the ids of pieces that come again kept in memory.

Two families of files split a text at white space before they merge anything, so a text's ids are those of its pieces,
one after another. For these a piece is encoded once in a Python worker, and letters with at most one mark behind them
go to the merge table directly. For any other file whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

#: Bytes that the pieces which a worker keeps take, and those of an entry beside its text and ids; pieces that come later
#: are encoded each time.
KEPT_BYTES, ENTRY_BYTES = 240 << 20, 190
_PIECE = re.compile(r"\s*\S+|\s+")
_SPACE = re.compile(r"\s")
#: Characters that Python takes for white space and Unicode doesn't.
_UNSURE = re.compile("[\x1c-\x1f]")
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


_LETTERS = _byte_letters()


def _family(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre, post = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec.get("post_processor")
    model = spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or spec.get("truncation") or spec.get("padding") or post:
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    steps = [(x.get("type"), x.get("behavior"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
    norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    if norms == ["NFC", "Replace", "Lowercase"] and steps == [("Split", "Removed", None), ("ByteLevel", None, False)]:
        return "words"
    return "whole"


class _Pieces(dict):
    """Piece of a text, without the ``before`` that stands in front of it -> its ids as little-endian unsigned 32-bit
    integers. Of letters with a mark behind them, or in upper case where that is folded, only the plain letters are kept.
    With ``words`` a piece that is empty or holds white space is a KeyError."""

    def __init__(self, encoder: Encoder, before: str, words: bool = True):
        super().__init__()
        self.encoder, self.before, self.words = encoder, before, words

    def __missing__(self, piece: str) -> bytes:
        if self.words and (not piece or _SPACE.search(piece)):
            raise KeyError(piece)
        enc = self.encoder
        mark = enc.marks.get(piece[-1:])
        body = piece if mark is None else piece[:-1]
        if body.isalpha() and (body.isascii() or max(body) < "İ"):
            plain = body if enc.family == "spaced" else body.lower()
            if plain is not piece and plain != piece:
                return self[plain] + (mark or b"")
            got = enc.letters(self.before + body)
        else:
            got = array("I", enc.tokenizer.encode(self.before + piece, add_special_tokens=False).ids).tobytes()
        if enc.room > 0:
            enc.room -= ENTRY_BYTES + len(piece) + len(got)
            self[piece] = got
        return got


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers. With ``special`` the strings of special tokens become those
    tokens, as by the library's default; without, they are ordinary text."""

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        #: What sends a text whole to the library; upper case may be folded before tokens are looked for.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.merge = self.tokenizer.model.tokenize
        self.family = _family(path)
        self.marks = {m: self.letters(m) for m in _MARKS} if self.family != "whole" else {}
        self.room = KEPT_BYTES
        self.plain, self.spaced, self.odd = _Pieces(self, ""), _Pieces(self, " "), _Pieces(self, "", words=False)
        self.line = self.odd["\n"] if self.family == "spaced" else b""

    def letters(self, word: str) -> bytes:
        """The ids of letters, or a mark, that the file doesn't split before it merges."""
        return array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text; none for null."""
        if not text:
            return b""
        if self.family == "whole" or self.added and self.added.search(text):
            return self._whole(text)
        if self.family == "words":
            return self._whole(text) if _UNSURE.search(text) else b"".join(map(self.plain.__getitem__, text.split()))
        try:
            return self._lines(text)
        except KeyError:
            return self._whole(text) if _UNSURE.search(text) else b"".join(map(self.odd.__getitem__, _PIECE.findall(text)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _lines(self, text: str) -> bytes:
        """The ids of a text whose white space is single spaces and line ends between words; a KeyError for any other."""
        out = []
        lines = text.split("\n")
        for i, line in enumerate(lines):
            first, *rest = line.split(" ")
            out.append(self.line)
            if first:
                out.append(self.plain[first])
            elif i and (rest or i < len(lines) - 1):
                raise KeyError(first)
            out += map(self.spaced.__getitem__, rest)
        return b"".join(out[1:])


@cache
def encoder(path: str, special: bool = False) -> Encoder:
    """This worker's encoder for a file."""
    return Encoder(path, special)
