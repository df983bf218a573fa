import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import edits, scalar
from readloom.operators import checks, convert, dedup, filters, intervals, joins, kernels, order, renumber, transform
from readloom.schema import order_keys
from readloom.sources import text
from readloom.streaming import arrivals

COLS = "aread long, bread long, is_inverse boolean, abpos long, aepos long, bbpos long, bepos long, diffs long, alen long, blen long, src_id long"
TRACED = COLS + ", trace array<struct<err:int,blen:int>>"


def ovl(spark, rows, cols=COLS):
    return spark.createDataFrame(rows, cols)


def span(a, b, n=0, inv=False, src=0):
    return (1, 2, inv, a, b, a, b, n, 1000, 1000, src)


def test_touching_intervals_merge(spark):
    i = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 21, 30), (2, 5, 6)], "read_id long, ifrom long, ito long")
    assert sorted(map(tuple, intervals.union(i).collect())) == [(1, 0, 20), (1, 21, 30), (2, 5, 6)]


def test_end_touching(spark):
    i = spark.createDataFrame([(1, 10, 20)], "read_id long, ifrom long, ito long")
    o = ovl(spark, [span(20, 30)])
    assert joins.touching(o, i, ["src_id"]).count() == 0
    assert joins.touching(o, i, ["src_id"], closed_end=True).count() == 1


def test_no_start_is_one_uncounted_chain(spark):
    o = ovl(spark, [span(0, 9, src=i) for i in range(3)]).withColumn("is_start", F.lit(False))
    rows = order.chain_numbers(o, ["src_id"]).collect()
    assert {(r.chain_id, r.n_chains, r.n_links) for r in rows} == {(0, 0, 3)}


@pytest.mark.parametrize(("spans", "want"), [([(0, 5), (4, 9), (8, 12)], {0, 2}), ([(8, 12), (4, 9), (0, 5)], {0, 2}), ([(4, 9), (0, 5), (8, 12)], {0})])
def test_greedy_primary(spark, spans, want):
    o = ovl(spark, [span(a, b, src=i) for i, (a, b) in enumerate(spans)])
    got = order.mark_primary(o, ["src_id"], ["src_id"])
    assert {r.src_id for r in got.where("is_primary").collect()} == want


def trace(n, blen=100):
    return [{"err": 1, "blen": blen}] * n


def test_containment_and_fusion(spark):
    row = lambda a, b: (1, 2, False, a, b, a, b, 0, 1000, 1000, 0, trace((b - a) // 100))

    def fused(*rows):
        out = dedup.fuse(ovl(spark, list(rows), TRACED)).collect()
        return [sorted((r.abpos, r.aepos, len(r.trace)) for r in out if r.removed == x) for x in (False, True)]

    assert fused(row(0, 500), row(100, 300)) == [[(0, 500, 5)], [(100, 300, 2)]]
    assert fused(row(0, 500), row(300, 800)) == [[(0, 800, 8)], [(0, 500, 5), (300, 800, 5)]]
    assert fused(row(0, 300), row(300, 600)) == [[(0, 300, 3), (300, 600, 3)], []]


def test_chain_links_stay_behind_their_head(spark):
    rows = [(5, 1, 0, 10, True), (1, 1, 0, 20, False), (3, 1, 0, 30, True)]
    o = spark.createDataFrame([(1, b, False, 0, 1, 0, 1, 0, 10, 10, s, st) for b, _, _, s, st in rows], COLS + ", is_start boolean")
    o = o.withColumn("c", F.when(F.col("src_id") <= 20, 0).otherwise(1))
    got = order.chain_sort(o, "canonical", ["src_id"], ["c"], "src_id").orderBy("rank").collect()
    assert [r.src_id for r in got] == [30, 10, 20]


def test_points_and_ranges(spark):
    assert filters.parse_points(["7", "7,9", "x", "1,2,3", ""]) == ([(0, 7, None), (1, 7, 9)], ["x", "1,2,3", ""])
    r = spark.range(10).withColumnRenamed("id", "read_id")
    assert [x.read_id for x in filters.read_range(r, "3-6").collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        filters.read_range(r, "a-b")
    with pytest.raises(ValueError):
        order_keys("nonsense")


def test_swap_twice_is_identity(spark):
    o = ovl(spark, [(1, 2, i % 2 == 0, 10 * i, 10 * i + 50, 5 * i, 5 * i + 60, 3, 900, 800, i) for i in range(20)])
    assert sorted(map(tuple, transform.swapped(transform.swapped(o)).collect())) == sorted(map(tuple, o.collect()))


def test_sample_holds_its_target(spark):
    reads = spark.createDataFrame([(i, 100 + i % 7) for i in range(500)], "read_id long, rlen long")
    total = reads.agg(F.sum("rlen")).first()[0]
    for p in (0.1, 0.5):
        kept = renumber.sample_reads(reads, p, 3).agg(F.sum("rlen")).first()[0]
        assert int(p * total + 0.5) <= kept < int(p * total + 0.5) + 107
    assert renumber.sample_reads(reads, 1.0).count() == 500


def test_read_outside_blocks_is_an_error(spark):
    reads = spark.createDataFrame([(0, 100)], "read_id long, rlen long")
    with pytest.raises(Exception, match="outside"):
        renumber.split(ovl(spark, [span(0, 9)]), renumber.blocks(reads, 50)).collect()


def test_shards_partition(spark):
    p = spark.createDataFrame([(i, j) for i in range(7) for j in range(3)], "aread long, bread long")
    parts = [{tuple(r) for r in renumber.shard(p, i, 4, ["aread", "bread"]).collect()} for i in range(4)]
    assert sum(map(len, parts)) == 21 and len(set.union(*parts)) == 21 and max(map(len, parts)) == 6
    with pytest.raises(ValueError):
        renumber.shard(p, 4, 4, ["aread", "bread"])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_trace_kernels(spark):
    rng = random.Random(3)
    a = "".join(rng.choices("ACGT", k=900))
    b = a[100:700]
    b = b[:200] + b[203:400] + "GG" + b[400:]
    runs = edits.align(a[100:700], b)
    t = edits.tiles(runs, 100, 100)
    rc = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, 2, inv, 100, 700, 0, len(b), sum(x["err"] for x in t), 900, len(b), i, t, a, b) for i, inv in enumerate([False, True])]
    o = spark.createDataFrame(rows, TRACED + ", aseq string, bseq string")
    assert rc != b
    assert [(r.insertions, r.deletions, r.error) for r in kernels.deep_check(o, ["src_id"]).collect()] == [(2, 3, None)] * 2
    wide = kernels.change_spacing(o, ["src_id", "abpos"], 100, 250).collect()
    assert [len(r.trace) for r in wide] == [3, 3] and all(r.diffs == 5 for r in wide)
    twins = kernels.swap_roles(o, ["src_id"])
    for r in twins.collect():
        assert r.diffs == 5 and sum(x.blen for x in r.trace) == 600 and (r.aread, r.bread, r.abpos, r.aepos) == (2, 1, 0, len(b))
        assert (r.bbpos, r.bepos) == ((200, 800) if r.is_inverse else (100, 700))
    flip = F.udf(lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    bases = twins.withColumns({"aseq": F.when(F.col("is_inverse"), F.lit(rc)).otherwise(F.lit(b)), "bseq": F.when(F.col("is_inverse"), flip(F.lit(a))).otherwise(F.lit(a))})
    again = {r.src_id: r for r in kernels.swap_roles(bases, ["src_id"]).collect()}
    for r in o.collect():
        x = again[r.src_id]
        assert (x.aread, x.bread, x.abpos, x.aepos, x.bbpos, x.bepos, x.alen, x.blen, x.diffs) == (r.aread, r.bread, r.abpos, r.aepos, r.bbpos, r.bepos, r.alen, r.blen, r.diffs)
        assert sum(t.blen for t in x.trace) == len(b)
    errors = {"span": {"aepos": F.lit(901).cast("long")}, "length": {"bepos": F.col("bepos") - 5}, "tiles": {"aepos": F.col("aepos") - 100}, "differences": {"diffs": F.lit(4).cast("long")}}
    for error, change in errors.items():
        assert {r.error for r in kernels.deep_check(o.withColumns(change), ["src_id"]).collect()} == {error}
    spans = kernels.align_spans(o, ["src_id", "aseq"]).collect()
    assert all(r.diffs == 5 and r.window_error <= 0.01 and r.aseq == a for r in spans)
    again = kernels.from_cigar(spark.createDataFrame([(edits.cigar(runs), 100)], "cigar string, abpos long"), ["abpos"]).first()
    assert [(x.err, x.blen) for x in again.trace] == [(x["err"], x["blen"]) for x in t]


def test_text_edges(spark, tmp_path):
    lines = spark.createDataFrame([(0, "q\t10\t1\t5\t*\tt\t20\t2\t6\t4\t4\t60")], "line_no long, value string")
    with pytest.raises(Exception, match="strand"):
        text.paf(lines).collect()
    (tmp_path / "x.fa").write_text(">a one\nACG\nT\n>b\n\n>c\nGG")
    got = text.fasta(spark, str(tmp_path / "x.fa")).collect()
    assert [(r.name, r.comment, r.seq) for r in got] == [("a", "one", "ACGT"), ("b", "", ""), ("c", "", "GG")]
    names = spark.createDataFrame([(7, "movie/1")], "read_id long, name string")
    rows = spark.createDataFrame([("movie/1/0_500",), ("movie/1",), ("other/1",)], "qname string")
    assert sorted(tuple(r) for r in joins.by_name_or_stem(rows, names, "qname", "id").collect()) == [("movie/1", 7), ("movie/1/0_500", 7)]


def test_empty_tables(spark):
    none = ovl(spark, [])
    for f in (filters.proper, dedup.exact, transform.swapped, transform.symmetric_closure, filters.length_error, joins.asymmetric, renumber.referenced):
        assert f(none).collect() == []
    assert renumber.subset(none)[0].collect() == [] and order.ranked(none, "ba", ["src_id"]).collect() == []
    assert intervals.tandem(none).collect() == []


def test_stream(spark, tmp_path):
    o = ovl(spark, [span(0, 1000, src=1), span(10, 90, src=2)]).drop("alen", "blen")
    o.write.parquet(str(tmp_path / "in"))
    reads = spark.createDataFrame([(1, 1000), (2, 1000)], "read_id long, rlen long")
    out = arrivals.proper_overlaps(arrivals.arriving(spark, str(tmp_path / "in"), o.schema), reads)
    q = out.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.src_id for r in spark.table("arrived").collect()] == [1]


def test_alphabets(spark):
    reads = spark.createDataFrame([(1, "acgTN"), (2, "ACGT"), (3, ""), (4, None), (5, "\u00df\nA\U0001f600x")], "read_id long, seq string")
    assert sorted(map(tuple, checks.indeterminate(reads).collect())) == [(1, 1, 4), (5, 4, 0)]
    mapped = {r.read_id: r.s for r in reads.select("read_id", scalar.four_letters(F.col("seq")).alias("s")).collect()}
    assert mapped == {1: "ACGTN", 2: "ACGT", 3: "", 4: None, 5: "NNANN"}
    cigars = {"3S4=1X": (True, True, ""), "4M": (False, True, ""), "4=2N1P3N": (False, False, "NP"), "*": (False, False, ""), "": (False, False, ""), "4": (False, False, "")}
    rows = checks.cigar_alphabet(spark.createDataFrame([(c,) for c in cigars], "cigar string")).collect()
    assert {r.cigar: (r.is_strict, r.is_resolvable, r.other) for r in rows} == cigars


def test_sam_with_m(spark):
    sam = spark.createDataFrame([("q", 0, "r", 11, "5M")], "qname string, flag int, rname string, pos long, cigar string")
    names = lambda n: spark.createDataFrame([(7, n, 100)], "read_id long, name string, rlen long")
    assert [(r.abpos, r.aepos) for r in convert.from_sam(sam, names("r"), names("q")).collect()] == [(10, 15)]
    with pytest.raises(Exception, match="unsupported CIGAR 5M"):
        convert.from_sam(sam, names("r"), names("q"), strict=True).collect()


def test_the_row_before_by_buckets(spark):
    """By buckets as by one window, across empty buckets, with null groups and values; without group or bucket an error."""
    import random

    import pytest
    from pyspark.sql import functions as F

    from readloom.operators import order

    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), i if i < 200 else i + 5000, rng.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, at long, name string")
    bucket = F.floor(F.col("at") / 16)
    for group in ([], ["g"]):
        last, want = {}, []
        for g, at, name in rows:
            k = g if group else 0
            want.append((at, name is not None and last.get(k) == name))
            last[k] = name
        assert sorted((r.at, r.is_secondary) for r in order.secondary_names(df, "name", ["at"], group, bucket).collect()) == want
    with pytest.raises(ValueError):
        order.secondary_names(df, "name", ["at"])
