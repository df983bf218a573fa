"""Substring deduplication by sliding sentence spans: runs of consecutive sentences that occur before are removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.batches import sliced
from readloom.plans.store import Scratch

#: Consecutive sentences in a span, and the fewest words of a span that counts.
RUN, MIN_WORDS = 2, 10
#: Words from which a sentence is a span by itself, where that is asked for.
ALONE = 20
#: A sentence runs to its end marks or line end, with the white space behind them; the sentences of a text are the text.
SENTENCE = r"[^.!?\n]*[.!?\n][.!? \t-\r]*|[^.!?\n]+"
_SENTENCE, _SENTENCE_BYTES = re.compile(SENTENCE), re.compile(SENTENCE.encode())
_END = b".!? \t\n\v\f\r"


def spans_of(text: str, run: int = RUN, min_words: int = MIN_WORDS, alone: int | None = None) -> tuple[list[int], list[bytes]]:
    """Number of the first sentence, and 128-bit hash, of each run of ``run`` sentences with ``min_words`` words or more. A
    text with fewer sentences is one run. Sentences are compared in lower case, with words one space apart and no end
    marks; one without words counts as one word. With ``alone`` each sentence of so many words is a span too, told from a
    run by the complement of its number."""
    words = [s.rstrip(_END).split() for s in _SENTENCE_BYTES.findall(text.lower().encode())]
    if not words:
        return [], []
    plain = list(map(b" ".join, words))
    run = min(run, len(words))
    ends = np.cumsum([0, *(len(w) or 1 for w in words)])
    at = np.flatnonzero(ends[run:] - ends[:-run] >= min_words).tolist()
    one = np.flatnonzero(np.diff(ends) >= alone).tolist() if alone and run > 1 else []
    hashes = [xxhash.xxh3_128_digest(b"\n".join(plain[i : i + run])) for i in at] + [xxhash.xxh3_128_digest(plain[i]) for i in one]
    return at + [~i for i in one], hashes


def spans(docs: DataFrame, run: int, min_words: int, alone: int | None = None) -> DataFrame:
    """(doc_id, text_id, pos, h1, h2): each span of each row of ``docs`` by its 128-bit hash, from sentence ``pos`` on, or
    the sentence ``~pos`` alone."""
    names = ["doc_id", "text_id", "pos", "h1", "h2"]

    def work(batches):
        for b in sliced(batches):
            doc, pos, hashes = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                p, h = spans_of(text, run, min_words, alone)
                doc += [i] * len(p)
                pos += p
                hashes += h
            two = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            of = pa.array(doc, pa.int64())
            out = [b.column(0).take(of), b.column(1).take(of), pa.array(pos, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    slim = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return slim.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def covered(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, alone: int | None = None) -> DataFrame:
    """(doc_id, text_id, gone): for each text with sentences to remove, the set of the numbers of their spans.

    A span that occurs more than once is kept where it comes first, by (doc_id, number of the sentence, text hash); each
    sentence of its other occurrences goes. Occurrences are counted before they are dealt out, and joined to the first
    ones in a join that adaptive execution can split, so a span of a third of all documents loads no single task.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    every = scratch.cut(spans(docs, run, min_words, alone), "every")
    at = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.greatest("pos", F.bitwise_not("pos")).alias("pos"), "text_id")
    again = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").drop("n")
    again = scratch.cut(again, "again")
    hits = every.withColumn("at", at).join(again, ["h1", "h2"]).where("at <> first")
    gone = scratch.cut(hits.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("gone")), "gone")
    scratch.drop("every", "again")
    return gone


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, alone: int | None = None) -> DataFrame:
    """``docs`` with the repeated sentences removed from ``text``, and n_sentences and n_removed added. ``alone``: words from
    which a sentence that repeats goes by itself, whatever its neighbours.

    Null texts stay null and, like empty ones, have no sentences. Rows that repeat both doc_id and text are one document
    and are kept or cut alike. Null doc_ids come after all others.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    cuts = covered(docs, run, min_words, alone)
    # Columns by number, so that no name of theirs meets one of ours.
    at, numbered = names.index("text"), [f"c{i}" for i in range(len(names))]
    full = docs.select(*names).toDF(*numbered).withColumn("of", F.xxhash64(f"c{at}"))
    same = F.col(f"c{names.index('doc_id')}").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("text_id"))
    full = full.join(cuts.hint("merge"), same, "left").select(*numbered, "gone")  # one plan, whatever the size

    def work(batches):
        for b in sliced(batches):
            rows = [_without(text, gone, run) for text, gone in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            new = list(b.columns[:-1])
            new[at] = pa.array([r[0] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*new, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=[*numbered, "n_sentences", "n_removed"])

    more = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    return full.mapInArrow(work, T.StructType([*full.schema.fields[:-1], *more])).toDF(*names, "n_sentences", "n_removed")


def _without(text: str | None, starts: list[int] | None, run: int) -> tuple[str | None, int, int]:
    parts = _SENTENCE.findall(text or "")
    if not starts:
        return text, len(parts), 0
    gone = {i + k for i in starts if i >= 0 for k in range(run)} | {~i for i in starts if i < 0}
    kept = [s for i, s in enumerate(parts) if i not in gone]
    return "".join(kept), len(parts), len(parts) - len(kept)
