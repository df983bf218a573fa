"""Queries of the operators that need bases, over mutated copies of the sequences, and the SQL of their results.

But for tandem alignment, read 2n is the sequence of document n, read 2n + 1 a copy in which the base at each place 50, 150, 250, ... is complemented. The
copies of odd documents are stored from the other strand. As a tile of 100 has one such place, its best alignment is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom import fixtures as fx
from readloom.catalog import query
from readloom.functions import trace
from readloom.functions.scalar import revcomp
from readloom.operators import bridge, convert, joins, kernels
from readloom.operators.kernels import SPAN

TS = fx.TS
LEAST = 200


def _complemented(seq):
    """A sequence with the bases at 50, 150, 250, ... complemented."""
    at = F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / 100).cast("int"))

    def tile(i):
        other = F.translate(F.substring(seq, i * 100 + 51, F.lit(1)), "ACGT", "TGCA")
        return F.concat(F.substring(seq, i * 100 + 1, F.lit(50)), other, F.substring(seq, i * 100 + 52, F.lit(49)))

    return F.array_join(F.transform(at, tile), "")


def _reads(spark, d):
    """(read_id, name, rlen, seq) of both reads of each pair, and its pairs (aread, bread, is_inverse, n)."""
    s = fx.sequences(spark, d).where(F.length("seq") >= LEAST).select((2 * F.col("read_id")).alias("aread"), "seq")
    inverse = F.col("aread") % 4 == 2
    both = s.withColumn("near", _complemented(F.col("seq")))
    near = both.withColumn("near", F.when(inverse, revcomp(F.col("near"))).otherwise(F.col("near")))
    each = F.inline(F.array(F.struct(F.col("aread").alias("read_id"), "seq"), F.struct((F.col("aread") + 1).alias("read_id"), F.col("near").alias("seq"))))
    reads = near.select(each).select("read_id", F.concat(F.lit("r"), "read_id").alias("name"), F.length("seq").cast("long").alias("rlen"), "seq")
    return reads, s.select("aread", (F.col("aread") + 1).alias("bread"), inverse.alias("is_inverse"), F.length("seq").cast("long").alias("n"))


def _whole(pairs):
    """Overlaps over the whole of both reads, with the trace that their making implies."""
    tiles = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TS).cast("int"))
    cells = F.transform(tiles, lambda i: F.struct((F.col("n") > i * TS + 50).cast("int").alias("err"), F.least(F.lit(TS).cast("long"), F.col("n") - i * TS).cast("int").alias("blen")))
    zero, n = F.lit(0).cast("long"), F.col("n")
    return pairs.select("aread", "bread", "is_inverse", zero.alias("abpos"), n.alias("aepos"), zero.alias("bbpos"), n.alias("bepos"), n.alias("alen"), n.alias("blen"), F.floor((n + 49) / 100).cast("long").alias("diffs"), cells.alias("trace"))


def _with_bases(pairs, reads):
    return joins.with_sequences(_whole(pairs), reads)


#: The pairs for DuckDB; u is the number of complemented bases.
PAIRS = fx.SEQ + f""",
p AS MATERIALIZED (SELECT 2 * read_id AS aread, 2 * read_id + 1 AS bread, read_id % 2 = 1 AS is_inverse, length(seq) AS n, (length(seq) + 49) // 100 AS u, seq FROM seqs WHERE length(seq) >= {LEAST})"""


def _shape(*without):
    """Shape of a trace: tiles, errors, errors weighted by the number of their tile, from 0, and length on B."""
    cols = {
        "tiles": F.size("trace").cast("long"),
        "errors": trace.error_sum(F.col("trace")),
        "weighted": F.aggregate(F.transform("trace", lambda t, i: t["err"] * i), F.lit(0).cast("long"), lambda s, x: s + x),
        "b_length": trace.b_length(F.col("trace")),
    }
    return [c.alias(k) for k, c in cols.items() if k not in without]


Z = "CAST(0 AS BIGINT)"


@query(f"""WITH {PAIRS} SELECT aread, bread, CASE aread % 8 // 2 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE n - u END AS matches, CASE aread % 8 // 2 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE u END AS mismatches,
  CASE aread % 8 // 2 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE {Z} END AS insertions, CASE aread % 8 // 2 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE {Z} END AS deletions,
  CASE aread % 8 // 2 WHEN 1 THEN 'length' WHEN 2 THEN 'count' WHEN 3 THEN 'tiles' END AS error FROM p""")
def deep_check(spark, d):
    """Recomputed statistics; of four documents one has a right trace, one a tile too long on B, one no errors, one a tile too few."""
    reads, pairs = _reads(spark, d)
    kind, t = F.floor(F.col("aread") % 8 / 2), F.col("trace")
    longer = F.transform(t, lambda x, i: F.struct(x["err"].alias("err"), (x["blen"] + (i == 0).cast("int")).alias("blen")))
    clean = F.transform(t, lambda x: F.struct(F.lit(0).alias("err"), x["blen"].alias("blen")))
    wrong = F.when(kind == 1, longer).when(kind == 2, clean).when(kind == 3, F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)
    return kernels.deep_check(_with_bases(pairs, reads).withColumn("trace", wrong), ["aread", "bread"])


@query(f"""WITH {PAIRS} SELECT aread, bread, (n + 249) // 250 AS tiles, u AS errors, CAST(list_sum(list_transform(range(0, u), lambda i: (100 * i + 50) // 250)) AS BIGINT) AS weighted, n AS b_length, u AS diffs FROM p""")
def change_spacing(spark, d):
    """Traces cut in tiles of 250 in place of 100."""
    reads, pairs = _reads(spark, d)
    found = kernels.change_spacing(_with_bases(pairs, reads), ["aread", "bread"], TS, 250)
    return found.select("aread", "bread", *_shape(), "diffs")


@query(f"""WITH {PAIRS} SELECT bread AS aread, aread AS bread, is_inverse, {Z} AS abpos, n AS aepos, {Z} AS bbpos, n AS bepos, (n + 99) // 100 AS tiles, u AS errors,
  CAST(list_sum(list_transform(range(0, u), lambda i: CASE WHEN is_inverse THEN (n - 100 * i - 51) // 100 ELSE i END)) AS BIGINT) AS weighted, n AS b_length, u AS diffs FROM p""")
def role_swap(spark, d):
    """Twins seen from B, with traces of their own."""
    reads, pairs = _reads(spark, d)
    return kernels.swap_roles(_with_bases(pairs, reads)).select(*SPAN, *_shape(), "diffs")


@query(f"""WITH {PAIRS}, q AS (SELECT *, n - 100 * u + 49 <= 3 AS short FROM p),
e AS (SELECT aread, bread, is_inverse, CASE WHEN short THEN 100 * u - 50 ELSE n END AS m, CASE WHEN short THEN u - 1 ELSE u END AS v, n FROM q)
SELECT aread, bread, is_inverse, {Z} AS abpos, m AS aepos, {Z} AS bbpos, m AS bepos, (m + 99) // 100 AS tiles, v AS errors, CAST(v * (v - 1) // 2 AS BIGINT) AS weighted, m AS b_length, v AS diffs FROM e""")
def paf_corrected(spark, d):
    """PAF lines without a CIGAR string whose spans stop a fifth short at each end, corrected to the whole;
    but for a last complemented base that at most 3 others follow, which are worth no more than an error."""
    from readloom.sources import text

    reads, pairs = _reads(spark, d)
    n, s = F.col("n"), F.floor(F.col("n") / 5)
    names = [F.concat(F.lit("r"), c) for c in ("aread", "bread")]
    rows = pairs.select("aread", names[1].alias("qname"), n.alias("qlen"), s.alias("qstart"), (n - s).alias("qend"), "is_inverse", names[0].alias("tname"), n.alias("tlen"), s.alias("tstart"), (n - s).alias("tend"), n.alias("matches"), n.alias("alen"), F.lit(60).alias("mapq"), F.lit(None).cast("string").alias("cigar"))
    lines = rows.select(F.col("aread").alias("line_no"), text.paf_text(rows).alias("value"))
    return convert.from_paf(text.paf_overlaps(text.paf(lines)), reads, reads, correct=True).select(*SPAN, *_shape(), "diffs")


@query(f"""WITH {PAIRS} SELECT aread, bread, is_inverse, CASE WHEN d THEN 2 ELSE 4 END AS abpos, n AS aepos, 4 AS bbpos, n AS bepos,
  CASE WHEN d THEN 2 ELSE 0 END + u AS diffs, (n + 99) // 100 AS tiles, CASE WHEN d THEN 2 ELSE 0 END + u AS errors, CAST(u * (u - 1) // 2 AS BIGINT) AS weighted, n - 4 AS b_length
  FROM (SELECT *, aread % 3 = 0 AS d FROM p) x""")
def sam_overlaps(spark, d):
    """SAM lines with clips, M and, of every third, a deletion before the first base, to overlaps with traces."""
    from readloom.sources import text

    reads, pairs = _reads(spark, d)
    body = F.concat(F.lit("4S"), F.when(F.col("aread") % 3 == 0, "2D").otherwise(""), (F.col("n") - 4).cast("string"), F.lit("M"))
    given = {"qname": F.concat(F.lit("r"), "bread"), "flag": F.when(F.col("is_inverse"), 16).otherwise(0), "rname": F.concat(F.lit("r"), "aread"), "pos": F.lit(5), "mapq": F.lit(60), "cigar": body, "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*"), "tags": F.array(F.lit("x:i:1"))}
    lines = text.sam_text(pairs.select(*(c.alias(k) for k, c in given.items()))).withColumn("line_no", F.lit(0))
    found = convert.sam_overlaps(text.sam(lines), reads, reads)
    longs = {c: F.col(c).cast("int") for c in ("abpos", "bbpos")}
    return found.withColumns(longs).select(*SPAN, "diffs", *_shape())


def _two_chains(pairs):
    """The whole overlap and, as a second chain, its beginning: half of the tiles, rounded down."""
    whole = _whole(pairs).withColumn("part", F.lit(0))
    half = F.floor(F.col("alen") / (2 * TS)).cast("long")
    cut = whole.withColumns({"part": F.lit(1), "aepos": half * TS, "bepos": half * TS, "trace": F.slice("trace", F.lit(1), half.cast("int")), "diffs": half})
    return whole.unionByName(cut).withColumn("is_start", F.lit(True))


def _records_sql(strategy: str) -> str:
    hard = strategy == "hard"
    return f"""WITH {PAIRS},
b AS (SELECT *, array_to_string(list_transform(string_split(seq, ''), lambda c, i: CASE WHEN (i - 1) % 100 = 50 THEN translate(c, 'ACGT', 'TGCA') ELSE c END), '') AS near FROM p),
r AS (SELECT *, n AS m, u AS v, 0 AS part FROM b UNION ALL SELECT *, n // 200 * 100 AS m, n // 200 AS v, 1 AS part FROM b)
SELECT aread, part, 'r' || bread AS qname, CAST(CASE WHEN part = 1 THEN 256 ELSE 0 END + CASE WHEN is_inverse THEN 16 ELSE 0 END AS INTEGER) AS flag, 'r' || aread AS rname, CAST(1 AS BIGINT) AS pos,
  '50=' || array_to_string(list_transform(range(0, v - 1), lambda i: '1X99='), '') || '1X' || CASE WHEN m - 100 * v + 49 > 0 THEN (m - 100 * v + 49) || '=' ELSE '' END || CASE WHEN m < n THEN (n - m) || '{"H" if hard else "S"}' ELSE '' END AS cigar,
  {"CASE WHEN part = 0 THEN near ELSE '*' END" if strategy == "none" else "substr(near, 1, m)" if hard else "near"} AS seq,
  'ci:i:' || part || ' cn:i:2 cj:i:0 cl:i:1 NM:i:' || v || ' MD:Z:50' || array_to_string(list_transform(range(0, v), lambda i: substr(seq, 100 * i + 51, 1) || CASE WHEN i + 1 < v THEN '99' ELSE '' END), '')
    || (m - 100 * v + 49) || ' AS:i:' || (m - 2 * v) AS tags
FROM r"""


def _records(spark, d, strategy):
    reads, pairs = _reads(spark, d)
    found = convert.sam_records(_two_chains(pairs), reads, reads, ["aread", "part"], strategy)
    return found.select("aread", "part", "qname", "flag", "rname", "pos", "cigar", "seq", F.array_join("tags", " ").alias("tags"))


@query(_records_sql("none"))
def sam_records_none(spark, d):
    """Whole SAM records; secondary ones hold no bases."""
    return _records(spark, d, "none")


@query(_records_sql("soft"))
def sam_records_soft(spark, d):
    """Whole SAM records; secondary ones hold their read."""
    return _records(spark, d, "soft")


@query(_records_sql("hard"))
def sam_records_hard(spark, d):
    """Whole SAM records; secondary ones hold what is aligned."""
    return _records(spark, d, "hard")


@query(f"""WITH {PAIRS}, both_ AS (SELECT aread, bread, is_inverse, n, u FROM p UNION ALL SELECT bread, aread, is_inverse, n, u FROM p)
SELECT aread, bread, is_inverse, {Z} AS abpos, n AS aepos, {Z} AS bbpos, n AS bepos, u AS diffs, (n + 99) // 100 AS tiles, u AS errors, n AS b_length FROM both_""")
def tandem_bridge(spark, d):
    """Three overlaps around two intervals of their A read: the second and third are anchored by a row of the first round."""
    reads, pairs = _reads(spark, d)
    n, c = F.col("n"), F.floor(F.col("n") / 2).cast("long")
    parts = F.explode(F.array(*(F.struct(b.alias("b"), e.alias("e")) for b, e in ((F.lit(0).cast("long"), c + 10), (c - 8, c + 18), (c, n)))))
    ovl = pairs.select("*", parts.alias("s")).select("aread", "bread", "is_inverse", *(F.col(f"s.{x}").alias(f"{y}{x}pos") for y in "ab" for x in "be"))
    masks = pairs.select(F.col("aread").alias("read_id"), F.explode(F.array(*(F.struct((c + x - 5).alias("ifrom"), (c + x + 5).alias("ito")) for x in (0, 6)))).alias("m")).select("read_id", "m.*")
    found = bridge.bridge(ovl, masks, reads, border=10)
    return found.where((F.col("abpos") == 0) & (F.col("aepos") == F.col("alen"))).select(*SPAN, "diffs", *_shape("weighted"))


def _tandem_reads(spark, d):
    """Of each customer a read 2n: a unit of 704 bases and the unit again with every hundredth base complemented; and a read
    2n + 1: the unit alone, of odd customers from the other strand. A unit's bases are hex digits of hashes of its number."""
    each = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("n"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda j: F.md5(F.concat_ws(":", F.col("n").cast("string"), j.cast("string"))))
    unit = each.withColumn("unit", F.translate(F.array_join(blocks, ""), "0123456789abcdef", "ACGT" * 4))
    both = unit.withColumn("again", _complemented(F.col("unit")))
    alone = F.when(F.col("n") % 2 == 1, revcomp(F.col("unit"))).otherwise(F.col("unit"))
    reads = both.select(F.inline(F.array(F.struct((2 * F.col("n")).alias("read_id"), F.concat("unit", "again").alias("seq")), F.struct((2 * F.col("n") + 1).alias("read_id"), alone.alias("seq")))))
    pairs = each.select((2 * F.col("n")).alias("aread"), F.explode(F.array(2 * F.col("n"), 2 * F.col("n") + 1)).alias("bread"))
    return reads, pairs


@query(f"""WITH c AS (SELECT CAST(2 * c_custkey AS BIGINT) AS a, c_custkey % 2 = 1 AS odd FROM customer),
x AS (SELECT a AS aread, a AS bread, FALSE AS is_inverse, 0 AS ab, 704 AS bb, 7 AS e FROM c UNION ALL SELECT a, a, FALSE, 704, 0, 7 FROM c
  UNION ALL SELECT a, a + 1, odd, 0, 0, 0 FROM c UNION ALL SELECT a, a + 1, odd, 704, 0, 7 FROM c)
SELECT aread, bread, is_inverse, CAST(ab AS BIGINT) AS abpos, CAST(ab + 704 AS BIGINT) AS aepos, CAST(bb AS BIGINT) AS bbpos, CAST(bb + 704 AS BIGINT) AS bepos, CAST(e AS BIGINT) AS diffs,
  CAST(8 AS BIGINT) AS tiles, CAST(e AS BIGINT) AS errors, CAST(704 AS BIGINT) AS b_length FROM x""")
def tandem_align(spark, d):
    """Alignments of reads that hold a unit twice, with themselves and with the unit, on both strands, from their seeds."""
    reads, pairs = _tandem_reads(spark, d)
    return kernels.tandem_alignments(pairs, reads, min_length=500).select(*SPAN, "diffs", *_shape("weighted"))
