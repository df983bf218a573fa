"""Operators that are composed of others: exports, conversions with traces, long alignments, bridging."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar, edits
from readloom.operators import bridge, convert, export
from readloom.sources import text


def mutated(rng, a, share):
    return "".join(c if (x := rng.random()) > share else rng.choice("ACGT") if x > share / 2 else rng.choice(["", c + rng.choice("ACGT")]) for c in a)


def test_stored_bases(spark):
    rows = [(1, 0, 2, 6, 8, "4="), (1, 256, 2, 6, 8, "4="), (2, 16 | 2048, 1, 4, 4, "3=")]
    sam = spark.createDataFrame(rows, "bread long, flag int, bbpos long, bepos long, blen long, cigar string")
    reads = spark.createDataFrame([(1, "ACGTACGT"), (2, "AACC")], "read_id long, seq string")
    want = {"none": ["ACGTACGT", "*", "*"], "soft": ["ACGTACGT", "ACGTACGT", "GGTT"], "hard": ["ACGTACGT", "GTAC", "GTT"]}
    for strategy, seqs in want.items():
        got = sorted((r.flag, r.sam_cigar, r.seq) for r in convert.stored(sam, reads, strategy).collect())
        assert [x[2] for x in got] == seqs and [x[1] for x in got] == (["2S4=2S", "2H4=2H", "1H3="] if strategy == "hard" else ["2S4=2S", "2S4=2S", "1S3="])
    with pytest.raises(ValueError):
        convert.stored(sam, reads, "some")


def test_from_paf(spark):
    refs = spark.createDataFrame([(5, "t", 12, "ACGTACGTACGT")], "read_id long, name string, rlen long, seq string")
    reads = spark.createDataFrame([(7, "q", 6, "ACGTAC"), (8, "x", 2, "AC"), (9, "x", 2, "AC")], "read_id long, name string, rlen long, seq string")
    lines = ["q\t6\t1\t5\t-\tt\t12\t2\t6\t4\t4\t60\tcg:Z:4M", "q\t6\t0\t6\t+\tt\t12\t0\t7\t4\t4\t60", "x\t2\t0\t2\t+\tt\t12\t0\t2\t2\t2\t60\tcg:Z:2=", "no\t2\t0\t2\t+\tt\t12\t0\t2\t2\t2\t60\tcg:Z:2="]
    rows = text.paf_overlaps(text.paf(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")))
    got = sorted((r.line_no, r.aread, r.bread, r.is_inverse, r.abpos, r.aepos, r.bbpos, r.bepos, r.diffs, [tuple(t) for t in r.trace]) for r in convert.from_paf(rows, refs, reads, ["line_no"], 4).collect())
    assert got == [(0, 5, 7, True, 2, 6, 1, 5, sum("GTAC"[i] != "TACG"[i] for i in range(4)), [(2, 2), (2, 2)]), (1, 5, 7, False, 0, 7, 0, 6, 1, [(0, 4), (1, 2)])]
    wrong = text.paf_overlaps(text.paf(spark.createDataFrame([(0, "q\t9\t0\t6\t+\tt\t12\t0\t6\t6\t6\t60\tcg:Z:6=")], "line_no long, value string")))
    with pytest.raises(Exception, match="length"):
        convert.from_paf(wrong, refs, reads).collect()


def test_reference_position(spark):
    df = spark.createDataFrame([(i,) for i in range(-1, 14)], "at long").withColumn("c", F.lit("2S3=2I1D4M2H"))
    got = [r[0] for r in df.select(cigar.ref_position(F.col("c"), F.lit(100), F.col("at"))).collect()]
    assert got == [None, None, None, 100, 101, 102, 103, 103, 104, 105, 106, 107, None, None, None]


def test_exports(spark, tmp_path):
    records = spark.createDataFrame([(0, "a", "x y", "ACGN" * 30), (1, "b", "", "")], "at long, name string, comment string, seq string")
    got = [r.record.split("\n") for r in export.reformat(records, ["at"], "m", 7).orderBy("number").collect()]
    assert got[0][0] == ">m/7/0_120 RQ=0.851 a x y" and len("".join(got[0][1:])) == 120 and not set("".join(got[0][1:])) - set("ACGT") and got[1] == [">m/8/0_0 RQ=0.851 b"]
    with pytest.raises(Exception, match="indeterminate"):
        export.reformat(records, ["at"], replace=False).collect()
    (tmp_path / "a.fa").write_text(">a one > two\nACG\nT\n>b\n\n>c\nGG\n")
    assert [(r.name, r.comment, r.seq) for r in text.fasta(spark, str(tmp_path / "a.fa")).collect()] == [("a", "one > two", "ACGT"), ("b", "", ""), ("c", "", "GG")]
    for k in range(3):
        (tmp_path / f"{k}.fq").write_text("".join(f"@{k}r{i} c{i}\n{'ACGT' * i}\n+\n{'@+I>' * i}\n" for i in range(1, 40 + k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        rows = text.fastq_files(spark, str(tmp_path / "*.fq")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.name, r.comment, r.seq, r.qual) for r in rows) == sorted((f"{k}r{i}", f"c{i}", "ACGT" * i, "@+I>" * i) for k in range(3) for i in range(1, 40 + k))


def test_bridge(spark):
    """Against the same rounds over lists, on both strands; a gap of another length or of unlike bases isn't bridged."""
    rng = random.Random(12)
    a = "".join(rng.choices("ACGT", k=6000))
    b = mutated(rng, a, 0.02)
    c = a[:2500] + "".join(rng.choices("ACGT", k=1000)) + a[3500:]
    rc = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs = {1: a, 2: b, 3: rc, 4: c}
    reads = spark.createDataFrame([(i, len(s), s) for i, s in seqs.items()], "read_id long, rlen long, seq string")
    masks = [(1, 2000, 2600), (1, 2900, 3300), (1, 4500, 4600)]
    spans = [(0, 2550), (100, 2540), (1600, 3350), (1700, 3450), (2500, 3820), (2600, 5000), (4050, 6000)]
    shift = len(b) - len(a)
    rows = [(1, x, x == 3, s, e, s + shift * (s > 3000), e + shift * (e > 3000), len(a), len(seqs[x])) for x in (2, 3, 4) for s, e in spans]
    rows = [(*r[:5], min(r[5], len(seqs[r[1]])), min(r[6], len(seqs[r[1]])), *r[7:]) for r in rows] + [(1, 2, False, 0, 2600, 0, 5500, len(a), len(b))]
    ovl = spark.createDataFrame(rows, "aread long, bread long, is_inverse boolean, abpos long, aepos long, bbpos long, bepos long, alen long, blen long")
    got = bridge.bridge(ovl, spark.createDataFrame(masks, "read_id long, ifrom long, ito long"), reads, border=500).collect()

    every, want = {r[:7] for r in rows}, set()
    while True:
        new = set()
        for _, lo, hi in masks:
            for group in {r[:3] for r in every}:
                own = [r for r in every if r[:3] == group]
                if any(r[3] <= lo - 500 and r[4] >= hi + 500 for r in own):
                    continue
                for x in own:
                    for y in own:
                        if x[3] <= lo - 500 and x[4] >= lo + 500 and y[3] <= hi - 500 and y[4] >= hi + 500:
                            n, m = y[4] - x[3], y[6] - x[5]
                            s = b if group[2] else seqs[group[1]]
                            if m > 0 and abs(n - m) / min(n, m) <= 0.3 and edits.window_error(edits.align(a[x[3] : y[4]], s[x[5] : y[6]])) <= 0.4:
                                new.add((*group, x[3], y[4], x[5], y[6]))
        if not new - every:
            break
        want |= new
        every |= new
    assert {tuple(r[c] for c in bridge.SPAN) for r in got if r.aread == 1} == want and len({r[1] for r in want}) >= 2
    seen = {(r.bread, r.aread, r.is_inverse, r.alen - r.aepos if r.is_inverse else r.abpos) for r in got if r.aread != 1}
    assert seen == {(*w[:3], w[5]) for w in want}
    assert len(got) == 2 * len(want) and all(sum(t.blen for t in r.trace) == r.bepos - r.bbpos and sum(t.err for t in r.trace) == r.diffs for r in got)
    none = spark.createDataFrame(masks, "read_id long, ifrom long, ito long").where("ito < 0")
    assert bridge.bridge(ovl, none, reads).collect() == []
    with pytest.raises(RuntimeError):
        bridge.bridge(ovl, spark.createDataFrame(masks, "read_id long, ifrom long, ito long"), reads, rounds=1)
