"""Operators that need the bases: alignment, recomputed traces, their statistics, tiles and CIGAR strings, extension of seeds.

``functions.edits`` gives the scripts between two sequences. Rows are independent, so operators are ``mapInArrow`` over rows that
a join has given their sequences.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from readloom.functions import edits
from readloom.functions.scalar import mirror, revcomp
from readloom.schema import TRACE

SPAN = ["aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos"]
_TRACED = [T.StructField("diffs", T.LongType()), T.StructField("trace", TRACE)]


def _longs(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def each_row(df: DataFrame, keep: list[str], fields: list[T.StructField], uses: list[str], make) -> DataFrame:
    """``make`` of the columns ``uses`` of each row, beside the columns ``keep``."""

    names = [f.name for f in fields]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for b in batches:
            rows = [make(*r) for r in zip(*(b.column(c).to_pylist() for c in uses))]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, *names])

    schema = T.StructType([df.schema[c] for c in keep] + fields)
    return df.select(*dict.fromkeys([*keep, *uses])).mapInArrow(run, schema)


def parts(rows: DataFrame) -> DataFrame:
    """Rows with aseq and bseq cut to their spans, so that only what is aligned reaches Python."""
    cut = {f"{x}seq": F.substring(F.col(f"{x}seq"), (F.col(f"{x}bpos") + 1).cast("int"), (F.col(f"{x}epos") - F.col(f"{x}bpos")).cast("int")) for x in "ab"}
    return rows.withColumns(cut)


_TILED = ["aseq", "bseq", "abpos", "aepos", "trace"]


def deep_check(ovl: DataFrame, keep: list[str], ts: int = 100) -> DataFrame:
    """Overlaps (with aseq, bseq and trace) and the statistics of their recomputed traces. ``error`` tells what is wrong, and the
    statistics are null where the trace can't be followed: ``span`` if a span leaves its read, ``tiles`` if the trace
    hasn't a tile for each of A's, ``length`` if it doesn't cover the B span; ``count`` if a tile can't be aligned with as few
    errors as it states, ``differences`` if diffs, where the table has it, is less than the errors found."""
    names = ["matches", "mismatches", "insertions", "deletions"]
    inside = (F.col("abpos") >= 0) & (F.col("abpos") < F.col("aepos")) & (F.col("aepos") <= F.length("aseq")) & (F.col("bbpos") >= 0) & (F.col("bbpos") <= F.col("bepos")) & (F.col("bepos") <= F.length("bseq"))
    said = F.col("diffs") if "diffs" in ovl.columns else F.lit(None).cast("long")
    rows = parts(ovl.withColumns({"_inside": inside, "_diffs": said}))

    def make(a, b, ab, ae, trace, ok, diffs):
        if not ok or trace is None:
            return (*[None] * 4, "span")
        if len(trace) != (ae - 1) // ts - ab // ts + 1:
            return (*[None] * 4, "tiles")
        if sum(t["blen"] for t in trace) != len(b) or any(t["blen"] < 0 for t in trace):
            return (*[None] * 4, "length")
        runs, at, bt, fewer = [], ab, 0, False
        for t in trace:
            end = min(ae, (at // ts + 1) * ts)
            tile = edits.align(a[at - ab : end - ab], b[bt : bt + t["blen"]])
            fewer |= edits.errors(tile) > t["err"]
            runs += tile
            at, bt = end, bt + t["blen"]
        s = edits.stats(runs)
        less = diffs is not None and diffs < edits.errors(runs)
        return (*(s[n] for n in names), "count" if fewer else "differences" if less else None)

    return each_row(rows, keep, [*_longs(names), T.StructField("error", T.StringType())], [*_TILED, "_inside", "_diffs"], make)


def change_spacing(ovl: DataFrame, keep: list[str], ts: int, new_ts: int) -> DataFrame:
    """Traces recomputed and cut in tiles of another spacing; differences are the errors of the new trace."""

    def make(a, b, ab, ae, trace):
        new = edits.tiles(edits.from_tiles(a, b, ab, ae, trace, ts), ab, new_ts)
        return sum(t["err"] for t in new), new

    return each_row(parts(ovl), keep, _TRACED, _TILED, make)


def swap_roles(ovl: DataFrame, keep: list[str] = (), ts: int = 100) -> DataFrame:
    """Overlaps (SPAN, alen, blen, trace; aseq and bseq, B oriented) seen from B: SPAN, alen, blen, diffs and trace of the twin, and
    the columns ``keep`` as they are.

    The tiles are aligned as they are, so that errors stay where they were; the script is exchanged, and read from the other end
    where B is reversed, before it is cut in B's tiles.
    """
    ab, ae = mirror(F.col("bbpos"), F.col("bepos"), F.col("blen"), F.col("is_inverse"))
    bb, be = mirror(F.col("abpos"), F.col("aepos"), F.col("alen"), F.col("is_inverse"))
    rows = parts(ovl).withColumns({"_ab": ab, "_ae": ae, "_bb": bb, "_be": be})

    def make(a, b, ab, ae, trace, inverse, begin):
        new = edits.tiles(edits.turned(edits.from_tiles(a, b, ab, ae, trace, ts), inverse), begin, ts)
        return sum(t["err"] for t in new), new

    names = list(dict.fromkeys([*keep, "aread", "bread", "is_inverse", "_ab", "_ae", "_bb", "_be", "alen", "blen"]))
    found = each_row(rows, names, _TRACED, [*_TILED, "is_inverse", "_ab"], make)
    twin = {"aread": "bread", "bread": "aread", "is_inverse": "is_inverse", "abpos": "_ab", "aepos": "_ae", "bbpos": "_bb", "bepos": "_be", "alen": "blen", "blen": "alen"}
    return found.select(*keep, *(F.col(old).alias(new) for new, old in twin.items() if new not in keep), "diffs", "trace")


def align_spans(rows: DataFrame, keep: list[str], ts: int = 100, window: int = 500) -> DataFrame:
    """Rows (aseq, abpos, aepos, bseq, bbpos, bepos) aligned from end to end: CIGAR, differences, trace and the worst window."""

    def make(a, b, ab):
        runs = edits.align(a, b)
        return edits.cigar(runs), edits.errors(runs), edits.tiles(runs, ab, ts), edits.window_error(runs, window)

    fields = [T.StructField("cigar", T.StringType()), *_TRACED, T.StructField("window_error", T.DoubleType())]
    names = [c for c in keep if c not in ("aseq", "bseq")]
    both = {f"_{c}": F.col(c) for c in ("aseq", "bseq") if c in keep}
    found = each_row(parts(rows.withColumns(both)), [*names, *both], fields, ["aseq", "bseq", "abpos"], make)
    return found.withColumnsRenamed({c: c[1:] for c in both}) if both else found


def from_cigar(rows: DataFrame, keep: list[str], ts: int = 100) -> DataFrame:
    """Rows (cigar, abpos; aseq, bseq from the alignment's begin on where M occurs, else null) with their trace, cut from the
    runs of the CIGAR string."""
    bases = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("aseq", "bseq")}

    def make(text, ab, a, b):
        new = edits.tiles(edits.parse(text, a or "", b or ""), ab, ts)
        return sum(t["err"] for t in new), new

    return each_row(rows.withColumns(bases), keep, _TRACED, ["cigar", "abpos", "aseq", "bseq"], make)


def sam_tags(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (cigar, aseq and bseq from the alignment's begin on) with nm, the errors, md, and as, matches less errors."""

    def make(text, a, b):
        runs = edits.parse(text, a, b)
        n = edits.errors(runs)
        return n, edits.md(runs, a), edits.stats(runs)["matches"] - n

    return each_row(rows, keep, [*_longs(["nm"]), T.StructField("md", T.StringType()), *_longs(["as"])], ["cigar", "aseq", "bseq"], make)


def scripts(ovl: DataFrame, keep: list[str], ts: int = 100) -> DataFrame:
    """Overlaps (with aseq, bseq and trace) with their CIGAR string, nm, md and as, all from one pass over their tiles."""

    def make(a, b, ab, ae, trace):
        runs = edits.from_tiles(a, b, ab, ae, trace, ts)
        n = edits.errors(runs)
        return edits.cigar(runs), n, edits.md(runs, a), edits.stats(runs)["matches"] - n

    fields = [T.StructField("cigar", T.StringType()), *_longs(["nm"]), T.StructField("md", T.StringType()), *_longs(["as"])]
    return each_row(parts(ovl), keep, fields, _TILED, make)


def _codes(seq: str, k: int) -> np.ndarray:
    """The k-mer at each place as a number; -1 where a base isn't one of ACGT."""
    of = np.full(256, -1, np.int64)
    of[list(b"ACGT")] = range(4)
    base = of[np.frombuffer(seq.encode(), np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Numbers of twice as many bases from two of half; those of the powers of two in k are joined.
    code, part, at, size = np.zeros(n, np.int64), np.maximum(base, 0), k, 1
    while True:
        if k & size:
            at -= size
            code += part[at : at + n] << 2 * (k - at - size)
        if 2 * size > k:
            break
        part = (part[:-size] << 2 * size) + part[size:]
        size *= 2
    if base.min() < 0:
        bad = np.concatenate([[0], np.cumsum(base < 0)])
        code[bad[k:] > bad[:-k]] = -1
    return code


#: Seeds of a pair that are listed at a time.
SEEDS = 1 << 20


def seeds_by_diagonal(a: str, b: str, k: int):
    """(diagonal, ascending places on A) of the k-mers that two sequences share, by ascending diagonal. Up to SEEDS are listed
    and sorted; if k-mers repeat so often that there are more, diagonals are searched one after another, so that only
    the seeds of one are held."""
    x = _codes(a, k)
    y = x if a == b else _codes(b, k)
    if not len(x) or not len(y):
        return
    order = np.argsort(y, kind="stable")
    ascending = y[order]
    first = np.searchsorted(ascending, x)
    of = np.flatnonzero((ascending[np.minimum(first, len(y) - 1)] == x) & (x >= 0))  # the places on A with a seed
    if not len(of):
        return
    first = first[of]
    n = np.searchsorted(ascending, x[of], "right") - first
    if n.sum() <= SEEDS:
        pa = np.repeat(of, n)
        d = pa - order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(pa))]
        sort = np.lexsort((pa, d))
        pa, d = pa[sort], d[sort]
        ends = np.flatnonzero(np.diff(d, append=d[-1:] + 1)) + 1
        for s, e in zip([0, *ends[:-1]], ends):
            yield int(d[s]), pa[s:e]
        return
    both = np.intersect1d(x[x >= 0], y[y >= 0])
    pa, pb = np.flatnonzero(np.isin(x, both)), np.flatnonzero(np.isin(y, both))
    if not len(pa):
        return
    have = np.full(len(y), -2, np.int64)
    have[pb] = y[pb]
    for d in range(int(pa[0] - pb[-1]), int(pa[-1] - pb[0]) + 1):
        part = pa[np.searchsorted(pa, pb[0] + d) : np.searchsorted(pa, pb[-1] + d, side="right")]
        hits = part[have[part - d] == x[part]]
        if len(hits):
            yield d, hits


class Covered:
    """Runs of matches of a diagonal as disjoint ascending intervals."""

    def __init__(self):
        self.begin: list[int] = []
        self.end: list[int] = []

    def add(self, begin: int, end: int) -> None:
        i, j = bisect.bisect_left(self.end, begin), bisect.bisect_right(self.begin, end)
        if i < j:
            begin, end = min(begin, self.begin[i]), max(end, self.end[j - 1])
        self.begin[i:j], self.end[i:j] = [begin], [end]

    def holds(self, begin: int, end: int) -> bool:
        i = bisect.bisect_right(self.begin, begin) - 1
        return i >= 0 and end <= self.end[i]

    def without(self, begin: np.ndarray, size: int) -> np.ndarray:
        """The first places of spans of ``size`` that no interval holds."""
        i = np.searchsorted(self.begin, begin, "right") - 1
        return begin[(i < 0) | (begin + size > np.asarray(self.end)[i])]


def through(a: str, b: str, apos: int, bpos: int, itself: bool = False) -> tuple[int, int, int, int, edits.Runs]:
    """The alignment that extends from a pair of places to both sides: abpos, aepos, bbpos, bepos and its script. ``itself``:
    both are one read, and no place is aligned with itself."""
    d = apos - bpos
    low, high = (1 - d, None) if itself and d > 0 else (None, -d - 1) if itself else (None, None)
    back = edits.extend(a[:apos][::-1], b[:bpos][::-1], None if high is None else -high, None if low is None else -low)
    ahead = edits.extend(a[apos:], b[bpos:], low, high)
    (i, j), (m, n) = edits.spans(back), edits.spans(ahead)
    ab, ae, bb, be = apos - i, apos + m, bpos - j, bpos + n
    runs = edits.merged([*back[::-1], *ahead])
    # Off its diagonal's ends a script of mismatches alone could align a read with itself.
    return ab, ae, bb, be, runs if itself and ab == bb else edits.straight(a[ab:ae], b[bb:be], runs)


def pair_alignments(a: str, b: str, itself: bool, k: int, min_length: int, ts: int) -> list[tuple]:
    """(abpos, aepos, bbpos, bepos, errors, trace) of the alignments between two sequences that start from their seeds.

    Seeds come by diagonal and place; one that lies on a match of an alignment found before is skipped. An alignment is kept
    if its A span has ``min_length``. Of two that share a trace point, where 95 % of the shorter A span lies in the other,
    the longer stays, the first if they are even. ``itself``: places aren't aligned with themselves.
    """
    covered: dict[int, Covered] = {}
    found: list[tuple] = []
    for d, places in seeds_by_diagonal(a, b, k):
        for gone in [x for x in covered if x < d]:
            del covered[gone]
        if itself and d == 0:
            continue
        while len(places := covered[d].without(places, k) if d in covered else places):
            apos, places = int(places[0]), places[1:]
            ab, ae, bb, be, runs = through(a, b, apos, apos - d, itself)
            for begin, size, at in edits.match_runs(runs, ab, bb):
                if at >= d:
                    covered.setdefault(at, Covered()).add(begin, begin + size)
            if ae - ab >= min_length:
                trace = edits.tiles(runs, ab, ts)
                points = set(zip(range((ab // ts + 1) * ts, ae, ts), (bb + np.cumsum([t["blen"] for t in trace])).tolist()))
                found.append((ab, ae, bb, be, edits.errors(runs), trace, points))
    kept: list[tuple] = []
    through_point: dict[tuple[int, int], list[tuple]] = {}
    for x in sorted(found, key=lambda x: (x[0] - x[1], x[:5])):
        near = (y for p in x[6] for y in through_point.get(p, ()))
        if not any(min(x[1], y[1]) - max(x[0], y[0]) >= 0.95 * (x[1] - x[0]) for y in near):
            kept.append(x)
            for p in x[6]:
                through_point.setdefault(p, []).append(x)
    return [x[:6] for x in kept]


def tandem_alignments(pairs: DataFrame, reads: DataFrame, k: int = 14, min_length: int = 1000, ts: int = 100) -> DataFrame:
    """Alignments (SPAN, diffs, trace) of each pair (aread, bread) on both strands of B, as by ``pair_alignments``; of a read with
    itself too (reads: read_id, seq). A pair listed several times counts once; one with an unknown read has none.

    Each pair and strand is a row of its own, so that the pairs of a frequent read are spread over all tasks.
    """
    strands = pairs.select("aread", "bread").distinct().withColumn("is_inverse", F.explode(F.array(F.lit(False), F.lit(True))))
    full = strands.join(reads.select(F.col("read_id").alias("aread"), F.col("seq").alias("aseq")), "aread")
    full = full.join(reads.select(F.col("read_id").alias("bread"), F.col("seq").alias("bseq")), "bread")
    full = full.withColumn("bseq", F.when(F.col("is_inverse"), revcomp(F.col("bseq"))).otherwise(F.col("bseq")))
    full = full.where(F.length("aseq") >= min_length).repartition("aread", "bread", "is_inverse")

    def make(a, b, aread, bread, inverse):
        return [[{"abpos": x[0], "aepos": x[1], "bbpos": x[2], "bepos": x[3], "diffs": x[4], "trace": x[5]} for x in pair_alignments(a, b, aread == bread and not inverse, k, min_length, ts)]]

    one = T.StructType([*_longs(["abpos", "aepos", "bbpos", "bepos", "diffs"]), T.StructField("trace", TRACE)])
    names = ["aread", "bread", "is_inverse"]
    found = each_row(full, names, [T.StructField("found", T.ArrayType(one))], ["aseq", "bseq", *names], make)
    return found.select(*names, F.inline("found"))


def correct_spans(rows: DataFrame, keep: list[str], ts: int = 100, k: int = 14) -> DataFrame:
    """Rows (aseq, bseq, and spans that are only roughly right) with the spans, diffs and trace of the alignment that extends to both
    sides from an anchor in the stated spans: both ends may move in or out.

    The anchor is the seed of ``k`` bases within the stated spans that lies nearest to their corners' diagonal, by its place at
    the middle if several do; without a seed the spans are aligned from end to end as they are.
    """
    rows = rows.withColumn("cigar", F.lit(None).cast("string"))
    return traced_spans(rows, [c for c in keep if c != "cigar"], ts, k, correct=True)


def traced_spans(rows: DataFrame, keep: list[str], ts: int = 100, k: int = 14, correct: bool = False) -> DataFrame:
    """``keep`` of rows (aseq, bseq, spans, and cigar or null), spans, diffs and trace, in one pass over all rows: a CIGAR string gives the
    trace, its M told apart by the bases; a row without one is aligned between its ends or, with ``correct``, as by ``correct_spans``."""
    ends = ["abpos", "aepos", "bbpos", "bepos"]
    names = [c for c in keep if c not in ends]

    def make(text, a, b, ab, ae, bb, be):
        x, y = a[ab:ae], b[bb:be]
        if text is not None:
            runs = edits.parse(text, x, y)
        elif not correct:
            runs = edits.align(x, y)
        else:
            seeds = seeds_by_diagonal(x, y, k)
            best = min(((abs(2 * d - len(x) + len(y)), abs(2 * int(p) - len(x)), d, int(p)) for d, at in seeds for p in at[[np.abs(2 * at - len(x)).argmin()]]), default=None)
            if best:
                ab, ae, bb, be, runs = through(a, b, ab + best[3], bb + best[3] - best[2])
            else:
                runs = edits.align(x, y)
        return ab, ae, bb, be, edits.errors(runs), edits.tiles(runs, ab, ts)

    found = each_row(rows, names, [*_longs([f"_{c}" for c in ends]), *_TRACED], ["cigar", "aseq", "bseq", *ends], make)
    return found.withColumnsRenamed({f"_{c}": c for c in ends})
