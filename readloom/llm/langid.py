"""Language of whole texts by rank-order profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.batches import sliced
from readloom.plans.store import Scratch

#: N-grams of a profile; texts of each language that are learned from, at most.
RANKS, MAX_TEXTS = 300, 2000
#: Languages whose profiles are sent to tasks at a time; code points of a text whose n-grams are counted at a time.
LANGS, PART = 1000, 1 << 18
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 characters within a text's words, and their counts. Words are runs of letters in lower case;
    longer n-grams may take in one space at either end. An n-gram is its code points, 21 bits each."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.concatenate([[32], np.where(_letters()[c], c, 32), [32]]).astype(np.uint32)
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(c), PART):  # n-grams by where they begin
        more, n = np.unique(_grams(c[at : at + PART + 2].astype(np.uint64), PART), return_counts=True)
        grams, back = np.unique(np.concatenate([grams, more]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(grams)).astype(np.int64)
    return grams, counts


def _grams(c: np.ndarray, starts: int) -> np.ndarray:
    """The n-grams that begin in the first ``starts`` of some code points, where 32 is no letter."""
    is_letter = c != 32
    one = c[:starts][is_letter[:starts]]
    two = (c[:-1] << np.uint64(21) | c[1:])[:starts][(is_letter[:-1] | is_letter[1:])[:starts]]
    three = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[:starts][is_letter[1:-1][:starts]]
    return np.concatenate([one, two, three])


def ranks(grams: np.ndarray, counts: np.ndarray, n: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, first the most frequent; ties by code."""
    return grams[np.lexsort((grams, -counts))[:n]]


class Profiles:
    """Languages and the ranked n-grams of each."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.langs = sorted(ranked)
        self.grams = np.unique(np.array([g for x in ranked.values() for g in x], dtype=np.uint64))
        self.place = np.full((len(self.grams) + 1, len(self.langs)), RANKS, dtype=np.int64)  # the last row: in no profile
        for k, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.grams, np.array(ranked[lang], dtype=np.uint64)), k] = np.arange(len(ranked[lang]))

    def predict(self, found: np.ndarray) -> tuple[str, float]:
        """The language with the least out-of-place distance to the ranked n-grams of a text, and how near it is, from 0 to
        1. An n-gram that a profile lacks counts as out of place by RANKS. Ties go to the first language by name."""
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, found)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != found)] = len(self.grams)
        place = self.place[at]
        far = np.where(place == RANKS, RANKS, np.abs(place - np.arange(len(found))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (RANKS * len(found)))


def train(docs: DataFrame) -> list[Profiles]:
    """Profiles, LANGS in each, of the languages in ``docs`` (doc_id, text, lang), from the MAX_TEXTS texts of each with the smallest
    hash of doc_id and text. Rows without text or language are left out, and rows that repeat both doc_id and text count
    once. Hashes alone are sorted to find the last one of each language; texts aren't shuffled. The profiles, RANKS n-grams
    a language, reach the driver."""
    scratch = Scratch(docs.sparkSession, "langid")
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    first = known.select("lang", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = scratch.cut(first.where(F.col("n") <= MAX_TEXTS).groupBy("lang").agg(F.max("h").alias("last")), "last")
    some = known.join(last, "lang").where(F.col("h") <= F.col("last")).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches):
        totals: dict[str, Counter] = {}
        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams, n = ngrams(text)
                totals.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), n.tolist())))
        for lang, total in totals.items():
            rows = {"lang": [lang] * len(total), "gram": list(total), "n": list(total.values())}
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    counts = scratch.cut(some, "texts").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = scratch.cut(counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS), "top")
    langs = [r[0] for r in top.select("lang").distinct().orderBy("lang").toLocalIterator()]
    out = []
    for at in range(0, len(langs), LANGS):
        found: dict[str, list[int]] = {}
        part = top.where(F.col("lang").between(langs[at], langs[min(at + LANGS, len(langs)) - 1])).collect()
        for r in sorted(part, key=lambda r: r["rank"]):
            found.setdefault(r["lang"], []).append(r["gram"])
        out.append(Profiles(found))
    return out


def predict(docs: DataFrame, profiles: list[Profiles]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` by its whole text; ``und`` and 0 if it is null or has no letter.
    With more than LANGS languages the texts are passed on from one group of profiles to the next, with the best so far."""
    spark = docs.sparkSession
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for k, p in enumerate(profiles):
        keep = ["doc_id", "text"] if k + 1 < len(profiles) else ["doc_id"]
        schema = ", ".join(f"{n} {kind}" for n, kind in found.dtypes if n != "text" or n in keep)
        found = found.mapInArrow(_better(spark.sparkContext.broadcast(p), keep), schema)
    return found.select("doc_id", "lang_pred", "score")


def _better(shared, keep: list[str]):
    """The columns ``keep`` of rows (doc_id, text, lang_pred, score), and the language of one group of profiles where that is
    nearer than the one so far."""

    def run(batches):
        p = shared.value
        for b in sliced(batches):
            got = [p.predict(ranks(*ngrams(x))) for x in b.column(1).to_pylist()]
            old = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            got = [x if y[0] == UNKNOWN or x[1] > y[1] else y for x, y in zip(got, old)]
            out = [*b.columns[: len(keep)], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "lang_pred", "score"])

    return run
