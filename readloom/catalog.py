"""Queries of the overlap operators over the driver's tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import fixtures as fx
from readloom.functions import scalar, trace
from readloom.operators import checks, convert, dedup, export, filters, intervals, joins, order, renumber, summary, transform
from readloom.plans import sizing
from readloom.schema import ORDERS

TS, TIE = fx.TS, fx.TIE
T = ", ".join(TIE)
SPANS = ["aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos", "diffs"]
S = ", ".join(SPANS)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL of its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Filters and projections


@query(f"""WITH {fx.OVL}, c AS (SELECT *, CASE WHEN abpos=0 AND aepos=alen THEN 'a_contained' WHEN bbpos=0 AND bepos=blen THEN 'b_contained'
  WHEN aepos=alen AND bbpos=0 THEN 'a_suffix' WHEN bepos=blen AND abpos=0 THEN 'b_suffix' END AS class FROM ovl)
SELECT {T}, {S}, class FROM c WHERE class IS NOT NULL""")
def proper_overlap(spark, d):
    lengths = fx.reads(spark, d)
    ovl = joins.with_lengths(fx.overlaps(spark, d).drop("alen", "blen"), lengths)
    return filters.proper(ovl).select(*TIE, *SPANS, "class")


@query(f"WITH {fx.OVL} SELECT {T}, {S} FROM ovl WHERE aepos-abpos >= 1000 AND CAST(diffs AS DOUBLE)/(aepos-abpos) <= 0.05")
def filter_length_error(spark, d):
    return filters.length_error(fx.overlaps(spark, d), 1000, 0.05).select(*TIE, *SPANS)


@query(f"WITH {fx.OVL} SELECT {T}, {S} FROM ovl WHERE aread = 7 AND bread = 9")
def project_pair(spark, d):
    return filters.by_ids(fx.overlaps(spark, d), 7, 9).select(*TIE, *SPANS)


POINTS = ["7", "12,13", "x", "7,9", "7"]


@query(f"""WITH {fx.OVL}, p(pos, a, b) AS (VALUES (0, 7, NULL), (1, 12, 13), (3, 7, 9), (4, 7, NULL))
SELECT CAST(pos AS BIGINT) AS pos, {T}, {S} FROM ovl JOIN p ON aread = a AND (b IS NULL OR b = bread)""")
def project_list(spark, d):
    return filters.by_points(fx.overlaps(spark, d), POINTS).select("pos", *TIE, *SPANS)


@query(f"""WITH {fx.OVL} SELECT {T}, abpos=0 AND aepos=alen AS contained_a, bbpos=0 AND bepos=blen AS contained_b,
  CASE WHEN aepos>abpos THEN CAST(diffs AS DOUBLE)/(aepos-abpos) ELSE 0.0 END >= 0.08 AS high_error FROM ovl""")
def containment_flags(spark, d):
    return filters.containment_flags(fx.overlaps(spark, d), 0.08).select(*TIE, "contained_a", "contained_b", "high_error")


@query(f"WITH {fx.TILES}, bad AS (SELECT DISTINCT {T} FROM tiles WHERE err > 127 OR tlen > 127) SELECT {T} FROM ovl ANTI JOIN bad USING ({T})")
def small_trace(spark, d):
    return filters.small_trace(fx.traced(spark, d), 127).select(*TIE)


@query(f"WITH {fx.OVL} SELECT {T}, {S} FROM ovl WHERE aread = bread AND NOT is_inverse")
def self_forward(spark, d):
    return filters.self_forward(fx.overlaps(spark, d)).select(*TIE, *SPANS)


@query(f"WITH {fx.R} SELECT read_id, rlen FROM r WHERE read_id BETWEEN 3 AND 41")
def read_range(spark, d):
    return filters.read_range(fx.reads(spark, d), "3-42")


@query(f"WITH {fx.R} SELECT read_id AS untrimmed_id, rlen, row_number() OVER (ORDER BY read_id) - 1 AS read_id FROM r WHERE rlen >= 3000")
def trimmed_reads(spark, d):
    return filters.trimmed(fx.reads(spark, d), 3000).select("read_id", "untrimmed_id", "rlen")


@query(f"WITH {fx.R} SELECT read_id, rlen FROM r")
def read_lengths(spark, d):
    return summary.lengths(fx.reads(spark, d))


# Set operations and exact copies


@query(f"WITH {fx.DUP}, u AS (SELECT * FROM ovl UNION ALL SELECT * FROM dup) SELECT {T}, {S} FROM u")
def concat(spark, d):
    return transform.concat(fx.overlaps(spark, d), fx.with_copies(spark, d)).select(*TIE, *SPANS)


@query(f"WITH {fx.DUP} SELECT DISTINCT {S} FROM dup")
def dedup_exact(spark, d):
    return dedup.exact(fx.with_copies(spark, d)).select(*SPANS)


@query(f"WITH {fx.DUP}, s AS (SELECT *, src_id % 3 AS src FROM dup) SELECT DISTINCT {S}, src FROM s")
def dedup_exact_per_file(spark, d):
    return dedup.exact(fx.with_copies(spark, d).withColumn("src", F.col("src_id") % 3), per_file=True).select(*SPANS, "src")


@query(f"""WITH {fx.OVL}, u AS (SELECT aread, bread, is_inverse, abpos, aepos, bbpos, bepos FROM ovl
  UNION ALL SELECT aread, bread, is_inverse, abpos, aepos, bbpos, bepos FROM ({fx.SWAP} FROM ovl) x) SELECT * FROM u""")
def symmetric_closure(spark, d):
    return transform.symmetric_closure(fx.overlaps(spark, d)).select("aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos")


@query(f"WITH {fx.OVL} SELECT {T}, {fx.SWAP[7:]} FROM ovl")
def role_swap_coords(spark, d):
    return transform.swapped(fx.overlaps(spark, d)).select(*TIE, "aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos", "alen", "blen")


@query(f"WITH {fx.OVL} SELECT {T} FROM ovl WHERE NOT (aread % 5 = 0 AND abpos < 100)")
def kill_list(spark, d):
    ovl = fx.overlaps(spark, d)
    return joins.without_kills(ovl, ovl.where("aread % 5 = 0 AND abpos < 100")).select(*TIE)


# Joins


@query(f"WITH {fx.OVL} SELECT {T}, alen, blen FROM ovl")
def join_lengths(spark, d):
    return joins.with_lengths(fx.overlaps(spark, d).drop("alen", "blen"), fx.reads(spark, d)).select(*TIE, "alen", "blen")


SEQ_JOIN = f"""WITH {fx.OVL}, {fx.SEQ}
SELECT {T}, md5(a.seq) AS aseq, md5(CASE WHEN is_inverse THEN reverse(translate(b.seq, 'ACGT', 'TGCA')) ELSE b.seq END) AS bseq
FROM ovl JOIN seqs a ON a.read_id = aread JOIN seqs b ON b.read_id = bread"""


@query(SEQ_JOIN)
def join_sequences(spark, d):
    joined = joins.with_sequences(fx.overlaps(spark, d), fx.sequences(spark, d))
    return joined.select(*TIE, F.md5(F.col("aseq").cast("binary")).alias("aseq"), F.md5(F.col("bseq").cast("binary")).alias("bseq"))


@query(f"WITH {fx.OVL} SELECT {T} FROM ovl WHERE aread % 2 = 0 AND bread % 2 = 0")
def both_kept(spark, d):
    return joins.both_in(fx.overlaps(spark, d), fx.reads(spark, d).where("read_id % 2 = 0")).select(*TIE)


@query(f"WITH {fx.SYM} SELECT s.* FROM sym s WHERE NOT EXISTS (SELECT 1 FROM ({fx.SWAP} FROM sym) t WHERE " + " AND ".join(f"t.{c} = s.{c}" for c in SPANS[:-1]) + ")")
def symmetry_violations(spark, d):
    return joins.asymmetric(fx.symmetric(spark, d)).select("aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos", "alen", "blen")


@query(f"""WITH {fx.SYM}, m AS (SELECT s.* FROM sym s WHERE NOT EXISTS (SELECT 1 FROM ({fx.SWAP} FROM sym) t WHERE {" AND ".join(f"t.{c} = s.{c}" for c in SPANS[:-1])}))
SELECT (SELECT count(*) FROM sym) AS rows, (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM m) = 0 AS ok""")
def symmetry_check(spark, d):
    return checks.symmetry(fx.symmetric(spark, d))


@query(f"""WITH {fx.SEQ}, p AS (SELECT read_id AS a, read_id + 1 AS b FROM seqs WHERE read_id % 4 = 0),
k AS MATERIALIZED (SELECT read_id, i AS pos, substr(seq, i + 1, 14) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 13)) AS i FROM seqs) x)
SELECT p.a AS aread, p.b AS bread, x.pos AS apos, y.pos AS bpos, x.pos - y.pos AS diagonal
FROM p JOIN k x ON x.read_id = p.a JOIN k y ON y.read_id = p.b AND y.kmer = x.kmer""")
def kmer_seeds(spark, d):
    reads = fx.sequences(spark, d)
    pairs = reads.where("read_id % 4 = 0").select(F.col("read_id").alias("aread"), (F.col("read_id") + 1).alias("bread"))
    return joins.seeds(reads, pairs, 14)


@query(f"""WITH {fx.SEQ}, k AS MATERIALIZED (SELECT read_id, i AS pos, substr(seq, i + 1, 14) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 13)) AS i FROM seqs) x)
SELECT x.read_id AS aread, y.read_id AS bread, x.pos AS apos, y.pos AS bpos, x.pos - y.pos AS diagonal
FROM k x JOIN k y ON y.read_id = x.read_id + 1 AND y.kmer = x.kmer""")
def kmer_seeds_all(spark, d):
    """As ``kmer_seeds``, for every read with the next one."""
    reads = fx.sequences(spark, d)
    return joins.seeds(reads, reads.select(F.col("read_id").alias("aread"), (F.col("read_id") + 1).alias("bread")), 14)


# Intervals

TANDEM_SQL = """s AS (SELECT * FROM ovl WHERE aread = bread AND NOT is_inverse),
sp AS (SELECT aread AS read_id, least(abpos,bbpos) AS ifrom, greatest(aepos,bepos) AS ito FROM s WHERE abpos < bepos AND bbpos < aepos
  UNION ALL SELECT aread, abpos, aepos FROM s WHERE NOT (abpos < bepos AND bbpos < aepos)
  UNION ALL SELECT aread, bbpos, bepos FROM s WHERE NOT (abpos < bepos AND bbpos < aepos)),
w AS (SELECT *, max(ito) OVER (PARTITION BY read_id ORDER BY ifrom, ito ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sp),
w2 AS (SELECT *, sum(CASE WHEN pm IS NULL OR ifrom > pm THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY ifrom, ito ROWS UNBOUNDED PRECEDING) AS isl FROM w),
tandem AS MATERIALIZED (SELECT read_id, min(ifrom) AS ifrom, max(ito) AS ito FROM w2 GROUP BY read_id, isl)"""


@query(f"WITH {fx.OVL}, {TANDEM_SQL} SELECT read_id, ifrom, ito FROM tandem")
def tandem_intervals(spark, d):
    return intervals.tandem(fx.overlaps(spark, d))


@query(f"WITH {fx.OVL}, {TANDEM_SQL} SELECT t.read_id, ifrom, ito, greatest(0, ifrom) AS front, greatest(0, rlen - ito) AS back FROM tandem t JOIN r ON r.read_id = t.read_id")
def tandem_distances(spark, d):
    return intervals.end_distances(intervals.tandem(fx.overlaps(spark, d)), fx.reads(spark, d))


@query(f"""WITH {fx.OVL}, {TANDEM_SQL} SELECT DISTINCT aread, bread FROM ovl WHERE
  EXISTS (SELECT 1 FROM tandem t WHERE t.read_id = aread AND abpos < ito AND ifrom < aepos) OR EXISTS (SELECT 1 FROM tandem t WHERE t.read_id = bread AND bbpos < ito AND ifrom < bepos)""")
def tandem_pairs(spark, d):
    ovl = fx.overlaps(spark, d)
    return intervals.tandem_pairs(ovl, intervals.tandem(ovl), [*TIE, "aread"])


@query(f"WITH {fx.OVL}, {TANDEM_SQL} SELECT 'tan' AS track, t.read_id, row_number() OVER (PARTITION BY t.read_id ORDER BY ifrom, ito) - 1 AS idx, ifrom, ito, rlen FROM tandem t JOIN r ON r.read_id = t.read_id")
def mask_view(spark, d):
    return intervals.masks_view(intervals.tandem(fx.overlaps(spark, d)), fx.reads(spark, d), "tan")


RUNS_SQL = f"""g AS (SELECT read_id, t, t - row_number() OVER (PARTITION BY read_id ORDER BY t) AS run FROM qual WHERE q <= 25),
runs AS MATERIALIZED (SELECT read_id, CAST(min(t)*{TS} AS BIGINT) AS ifrom, CAST((max(t)+1)*{TS} AS BIGINT) AS ito FROM g GROUP BY read_id, run)"""


@query(f"WITH {fx.QUAL}, {RUNS_SQL} SELECT read_id, ifrom, ito FROM runs")
def quality_runs(spark, d):
    return intervals.quality_runs(fx.qualities(spark, d), 25, TS)


@query(f"WITH {fx.QUAL} SELECT read_id, CAST(t AS BIGINT) AS t, q FROM qual")
def quality_view(spark, d):
    return summary.quality_values(fx.qualities(spark, d))


# Orders


def _sorted(name: str):
    keys = order.order_keys(name, TIE)
    sql = f"WITH {fx.OVL} SELECT {T}, aread, bread, row_number() OVER (ORDER BY {', '.join(keys)}) - 1 AS rank FROM ovl"

    def f(spark, d):
        return order.ranked(fx.overlaps(spark, d), name, TIE).select(*TIE, "aread", "bread", "rank")

    f.__name__ = f"sort_{name}"
    query(sql)(f)


for _name in ORDERS:
    _sorted(_name)


@query(f"WITH {fx.OVL}, u AS (SELECT * FROM ovl WHERE src_id % 2 = 0 UNION ALL SELECT * FROM ovl WHERE src_id % 2 = 1) SELECT {T}, {S} FROM u")
def merge_sorted(spark, d):
    ovl = fx.overlaps(spark, d)
    return order.merge(ovl.where("src_id % 2 = 0"), ovl.where("src_id % 2 = 1"), order="ba", tie=TIE).select(*TIE, *SPANS)


@query(f"WITH {fx.OVL} SELECT {T}, aread, bread, row_number() OVER (ORDER BY {', '.join(order.order_keys('ba', TIE))}) - 1 AS place FROM ovl")
def merge_places(spark, d):
    """The places that rows have in the merged table as it comes."""
    from readloom.plans.prefix import rank

    ovl = fx.overlaps(spark, d)
    merged = order.merge(ovl.where("src_id % 2 = 0"), ovl.where("src_id % 2 = 1"), order="ba", tie=TIE)
    at = merged.select(*TIE, "aread", "bread", F.monotonically_increasing_id().alias("at"))
    return rank(at, F.shiftright("at", 33), ["at"], "place").drop("at")


CH = ["aread", "bread"]
CHAIN_SQL = f"""n AS (SELECT *, sum(CAST(is_start AS INT)) OVER (PARTITION BY aread, bread ORDER BY {T} ROWS UNBOUNDED PRECEDING) AS no FROM ovl),
n2 AS (SELECT *, no - min(no) OVER (PARTITION BY aread, bread) AS chain_id FROM n),
ch AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY aread, bread, chain_id ORDER BY {T}) - 1 AS chain_link FROM n2)"""


@query(f"""WITH {fx.OVL}, {CHAIN_SQL},
h AS (SELECT c.*, first_value((bread, aread, is_inverse, abpos, aepos, bbpos, bepos, diffs, {T})) OVER (PARTITION BY aread, bread, chain_id ORDER BY chain_link) AS head FROM ch c)
SELECT {T}, aread, bread, CAST(chain_id AS BIGINT) AS chain_id, chain_link, row_number() OVER (ORDER BY head, aread, bread, chain_id, chain_link) - 1 AS rank FROM h""")
def chain_sort(spark, d):
    ovl = order.chains(fx.overlaps(spark, d), CH, TIE)
    return order.chain_sort(ovl, "ba", TIE, [*CH, "chain_id"], "chain_link").select(*TIE, "aread", "bread", "chain_id", "chain_link", "rank")


@query(f"""WITH RECURSIVE {fx.OVL},
o AS MATERIALIZED (SELECT {T}, aread, abpos, aepos, row_number() OVER (PARTITION BY aread ORDER BY {T}) AS k FROM ovl),
g AS (
  SELECT {T}, aread, k, TRUE AS is_primary, [{{'b': abpos, 'e': aepos}}] AS sp FROM o WHERE k = 1
  UNION ALL
  SELECT o.src_id, o.src_line, o.src_supp, o.src_qty, o.src_price, o.aread, o.k,
         len(list_filter(g.sp, lambda p: o.abpos < p.e AND p.b < o.aepos)) = 0,
         CASE WHEN len(list_filter(g.sp, lambda p: o.abpos < p.e AND p.b < o.aepos)) = 0 THEN list_append(g.sp, {{'b': o.abpos, 'e': o.aepos}}) ELSE g.sp END
  FROM g JOIN o ON o.aread = g.aread AND o.k = g.k + 1)
SELECT {T}, aread, is_primary FROM g""")
def primary_mark(spark, d):
    return order.mark_primary(fx.overlaps(spark, d), TIE, [*TIE, "aread"])


@query(f"""WITH {fx.OVL},
n AS (SELECT *, sum(CAST(is_start AS INT)) OVER (PARTITION BY bread ORDER BY {T}, aread ROWS UNBOUNDED PRECEDING) AS no FROM ovl),
n2 AS (SELECT *, no - min(no) OVER (PARTITION BY bread) AS chain_id, sum(CAST(is_start AS INT)) OVER (PARTITION BY bread) AS n_chains FROM n),
n3 AS (SELECT *, row_number() OVER (PARTITION BY bread, chain_id ORDER BY {T}, aread) - 1 AS chain_link, count(*) OVER (PARTITION BY bread, chain_id) AS n_links FROM n2)
SELECT {T}, aread, bread, CAST(chain_id AS BIGINT) AS chain_id, CAST(n_chains AS BIGINT) AS n_chains, chain_link, n_links,
  CASE WHEN chain_link > 0 THEN 'supplementary' WHEN chain_id = 0 THEN 'primary' ELSE 'secondary' END AS role FROM n3""")
def chain_number(spark, d):
    return order.chain_numbers(fx.overlaps(spark, d), [*TIE, "aread"]).select(*TIE, "aread", "bread", "chain_id", "n_chains", "chain_link", "n_links", "role")


@query(f"WITH {fx.OVL} SELECT bread, CAST(sum(CAST(is_start AS INT)) AS BIGINT) AS n_chains FROM ovl GROUP BY bread")
def chain_count(spark, d):
    return summary.chain_counts(fx.overlaps(spark, d))


@query(f"""WITH {fx.OVL}, s AS (SELECT *, bepos-bbpos-diffs AS score, row_number() OVER (PARTITION BY bread ORDER BY bepos-bbpos-diffs DESC, {T}, aread) AS place FROM ovl)
SELECT {T}, aread, bread, score, CAST(place AS INTEGER) AS place, CASE WHEN place = 1 THEN 'primary' ELSE 'secondary' END AS role FROM s WHERE place <= 3""")
def best_m(spark, d):
    return order.best(fx.overlaps(spark, d), 3, [*TIE, "aread"]).select(*TIE, "aread", "bread", "score", "place", "role")


@query(f"""WITH {fx.OVL}, lagged AS (SELECT *, lag((aread, bread, is_inverse, abpos, aepos, bbpos, bepos, diffs)) OVER (PARTITION BY src_id % 3 ORDER BY src_id, src_line, src_supp, src_qty, src_price, aread) AS before FROM ovl)
SELECT {T}, aread FROM lagged WHERE before > (aread, bread, is_inverse, abpos, aepos, bbpos, bepos, diffs)""")
def unsorted_rows(spark, d):
    ovl = fx.overlaps(spark, d).withColumns({"src": F.col("src_id") % 3, "at": F.struct(*TIE, "aread")})
    return order.unsorted(ovl, "canonical", "at", ["src"], bucket=F.floor(F.col("src_id") / 1024)).select(*TIE, "aread")


@query(f"""WITH {fx.OVL}, n AS (SELECT {T}, aread, 'read' || bread AS name FROM ovl)
SELECT {T}, aread, name, coalesce(lag(name) OVER (PARTITION BY aread ORDER BY {T}) = name, FALSE) AS is_secondary FROM n""")
def secondary_names(spark, d):
    rows = fx.overlaps(spark, d).select(*TIE, "aread", F.concat(F.lit("read"), "bread").alias("name"))
    return order.secondary_names(rows, "name", TIE, ["aread"])


# Renumbering, samples, blocks


@query(f"""WITH {fx.OVL}, ids AS (SELECT aread AS id FROM ovl UNION SELECT bread FROM ovl), n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM ids)
SELECT {T}, x.new_id AS aread, y.new_id AS bread FROM ovl JOIN n x ON x.id = aread JOIN n y ON y.id = bread""")
def subset_renumber(spark, d):
    return renumber.subset(fx.overlaps(spark, d))[0].select(*TIE, "aread", "bread")


@query(f"WITH {fx.OVL} SELECT aread AS read_id FROM ovl UNION SELECT bread FROM ovl")
def referenced_reads(spark, d):
    return renumber.referenced(fx.overlaps(spark, d))


SAMPLE_SQL = """h AS (SELECT read_id, rlen, CAST(('0x' || substr(md5('5:' || read_id), 1, 15)) AS BIGINT) AS h FROM r),
b AS (SELECT *, coalesce(sum(rlen) OVER (ORDER BY h, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
kept AS MATERIALIZED (SELECT read_id, rlen FROM b WHERE before < floor((SELECT sum(rlen) FROM r) * 0.3::DOUBLE + 0.5))"""


@query(f"WITH {fx.OVL}, {SAMPLE_SQL} SELECT {T} FROM ovl WHERE aread IN (SELECT read_id FROM kept) AND bread IN (SELECT read_id FROM kept)")
def subsample(spark, d):
    return renumber.subsample(fx.overlaps(spark, d), fx.reads(spark, d), 0.3, 5).select(*TIE)


@query(f"""WITH {fx.OVL}, {SAMPLE_SQL}, n AS MATERIALIZED (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS new_id FROM kept)
SELECT {T}, x.new_id AS aread, y.new_id AS bread FROM ovl JOIN n x ON x.read_id = aread JOIN n y ON y.read_id = bread""")
def reduce(spark, d):
    return renumber.reduce(fx.overlaps(spark, d), fx.reads(spark, d), 0.3, 5)[0].select(*TIE, "aread", "bread")


@query(f"""WITH {fx.R}, {SAMPLE_SQL} SELECT CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM r) AS read_fraction, CAST(sum(rlen) AS DOUBLE) / CAST((SELECT sum(rlen) FROM r) AS DOUBLE) AS base_fraction FROM kept""")
def kept_fractions(spark, d):
    reads = fx.reads(spark, d)
    return summary.kept_fractions(reads, renumber.sample_reads(reads, 0.3, 5))


BLOCK_BASES = 100_000
BLOCK_SQL = f"blk AS MATERIALIZED (SELECT read_id, rlen, CAST(coalesce(sum(rlen) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_BASES} + 1 AS BIGINT) AS block FROM r)"


@query(f"WITH {fx.OVL}, {BLOCK_SQL} SELECT {T}, aread, block FROM ovl JOIN blk ON read_id = aread")
def block_split(spark, d):
    return renumber.split(fx.overlaps(spark, d), renumber.blocks(fx.reads(spark, d), BLOCK_BASES)).select(*TIE, "aread", "block")


@query(f"WITH {fx.OVL}, {BLOCK_SQL} SELECT block, count(*) AS rows FROM ovl JOIN blk ON read_id = bread GROUP BY block")
def block_counts(spark, d):
    return renumber.split(fx.overlaps(spark, d), renumber.blocks(fx.reads(spark, d), BLOCK_BASES), "bread").groupBy("block").agg(F.count("*").alias("rows"))


@query(f"WITH {fx.OVL} SELECT aread, abpos // 500 AS bin, count(*) AS rows FROM ovl GROUP BY ALL")
def bin_index(spark, d):
    return renumber.bins(fx.overlaps(spark, d), 500)


@query(f"""WITH {fx.OVL}, p AS (SELECT DISTINCT aread, bread FROM ovl), n AS (SELECT *, row_number() OVER (ORDER BY aread, bread) - 1 AS i, ceil(count(*) OVER () / 4.0) AS c FROM p)
SELECT aread, bread FROM n WHERE i >= c AND i < 2 * c""")
def pair_shard(spark, d):
    return renumber.shard(fx.overlaps(spark, d).select("aread", "bread").distinct(), 1, 4, ["aread", "bread"])


@query(f"WITH {fx.OVL} SELECT min(aread) AS lo, max(aread) AS hi FROM ovl")
def aread_range(spark, d):
    return summary.aread_range(fx.overlaps(spark, d))


# Checks


@query(f"WITH {fx.OVL} SELECT src_id % 4 AS src, count(*) AS rows, bool_and(abpos >= 0 AND aepos <= alen AND bbpos >= 0 AND bepos <= blen) AS ok FROM ovl GROUP BY 1")
def structural_check(spark, d):
    return checks.verdict(fx.traced(spark, d).withColumn("src", F.col("src_id") % 4), "src")


@query(f"WITH {fx.OVL} SELECT max(CAST(diffs AS DOUBLE)/(aepos-abpos)) AS max_error FROM ovl WHERE aepos > abpos")
def max_error_rate(spark, d):
    return summary.max_error(fx.overlaps(spark, d))


# Traces


@query(f"WITH {fx.TILES} SELECT {T}, t, tb, te FROM tiles")
def trace_tiles(spark, d):
    return fx.overlaps(spark, d).select(*TIE, F.inline(trace.tile_borders(F.col("abpos"), F.col("aepos"), TS)))


@query(f"WITH {fx.TILES} SELECT {T}, tb AS apos, tbb AS bpos FROM tiles WHERE i > 0")
def trace_points(spark, d):
    return fx.traced(spark, d).select(*TIE, F.inline(trace.points(F.col("abpos"), F.col("aepos"), F.col("bbpos"), F.col("trace"), TS)))


@query(f"""WITH {fx.TILES} SELECT {T}, CAST(sum(err) AS BIGINT) AS errors, CAST(sum(tlen) AS BIGINT) AS b_length, round(CAST(sum(err) AS DOUBLE)/(any_value(aepos)-any_value(abpos)), 9) AS rate
FROM tiles GROUP BY {T}, aread""")
def trace_sums(spark, d):
    rate = trace.error_rate(F.col("trace"), F.col("diffs"), F.col("abpos"), F.col("aepos"))
    return fx.traced(spark, d).select(*TIE, trace.error_sum(F.col("trace")).alias("errors"), trace.b_length(F.col("trace")).alias("b_length"), F.round(rate, 9).alias("rate"))


@query(f"""WITH {fx.TILES}, full_ AS (SELECT * FROM tiles WHERE te - tb = {TS})
SELECT {T}, min(tb) AS abpos, max(te) AS aepos, min(tbb) AS bbpos, max(tbb + tlen) AS bepos, count(*) AS tiles, CAST(sum(err) AS BIGINT) AS errors FROM full_ GROUP BY {T}, aread""")
def trace_align(spark, d):
    ovl = fx.traced(spark, d)
    cut = ovl.withColumns(trace.aligned(*(F.col(c) for c in ("abpos", "aepos", "bbpos", "bepos", "trace")), TS))
    return filters.not_empty(cut).select(*TIE, "abpos", "aepos", "bbpos", "bepos", F.size("trace").cast("long").alias("tiles"), trace.error_sum(F.col("trace")).alias("errors"))


@query(f"""WITH {fx.TILES}, g AS (SELECT r.read_id, t, t - row_number() OVER (PARTITION BY r.read_id ORDER BY t) AS run
  FROM (SELECT read_id, unnest(range(0, (rlen+{TS-1})//{TS})) AS t FROM r) r WHERE (r.read_id*31 + t*17) % 50 <= 25),
full_ AS (SELECT tiles.*, g.run FROM tiles JOIN g ON g.read_id = aread AND g.t = tiles.t WHERE te - tb = {TS})
SELECT {T}, min(tb) AS abpos, max(te) AS aepos, min(tbb) AS bbpos, max(tbb + tlen) AS bepos, count(*) AS tiles FROM full_ GROUP BY {T}, aread, run""")
def quality_clip(spark, d):
    from readloom.operators.trace import quality_clip as clip

    kept = clip(fx.traced(spark, d), intervals.quality_runs(fx.qualities(spark, d), 25, TS), TS)
    return kept.select(*TIE, "abpos", "aepos", "bbpos", "bepos", F.size("trace").cast("long").alias("tiles"))


KILL_SQL = f"""pts AS MATERIALIZED (SELECT {T}, aread, bread, is_inverse, abpos, aepos, tb AS apos, tbb AS bpos FROM tiles WHERE i > 0),
pairs AS (SELECT DISTINCT x.aread, x.bread, x.is_inverse, (x.abpos, {", ".join("x." + c for c in TIE)}) AS k1, (y.abpos, {", ".join("y." + c for c in TIE)}) AS k2,
    ({", ".join("x." + c for c in TIE)}) AS t1, ({", ".join("y." + c for c in TIE)}) AS t2, x.abpos AS b1, x.aepos AS e1, y.abpos AS b2, y.aepos AS e2
  FROM pts x JOIN pts y ON x.aread = y.aread AND x.bread = y.bread AND x.is_inverse = y.is_inverse AND x.apos = y.apos AND x.bpos = y.bpos),
kills AS (SELECT DISTINCT aread, bread, is_inverse, CASE WHEN b1 <= b2 AND e2 <= e1 THEN t2 ELSE t1 END AS k FROM pairs
  WHERE k1 < k2 AND ((b1 <= b2 AND e2 <= e1) OR (b2 <= b1 AND e1 <= e2)))"""


@query(f"WITH {fx.TILES}, {KILL_SQL} SELECT aread, bread, is_inverse, k[1] AS src_id, k[2] AS src_line, k[3] AS src_supp, k[4] AS src_qty, k[5] AS src_price FROM kills")
def dedup_contained(spark, d):
    return dedup.contained_kills(fx.traced(spark, d), TIE, TS)


@query()
def dedup_fuse(spark, d):
    return dedup.fuse(fx.traced(spark, d), TS).withColumn("errors", trace.error_sum(F.col("trace"))).drop("trace")


BRIDGE_SQL = f"""near AS MATERIALIZED (SELECT {T}, aread, bread, is_inverse, abpos, aepos, bbpos, bepos, ifrom, ito FROM ovl JOIN tandem ON read_id = aread),
spanned AS (SELECT DISTINCT aread, bread, is_inverse, ifrom, ito FROM near WHERE abpos <= ifrom - 100 AND aepos >= ito + 100),
both_ AS (SELECT x.aread, x.bread, x.is_inverse, x.ifrom, x.ito, x.src_id AS src_id1, y.src_id AS src_id2, x.src_line AS src_line1, y.src_line AS src_line2,
    y.aepos - x.abpos AS adif, y.bepos - x.bbpos AS bdif
  FROM near x JOIN near y ON x.aread = y.aread AND x.bread = y.bread AND x.is_inverse = y.is_inverse AND x.ifrom = y.ifrom AND x.ito = y.ito
  WHERE x.abpos <= x.ifrom - 100 AND x.aepos >= x.ifrom + 100 AND y.abpos <= y.ito - 100 AND y.aepos >= y.ito + 100)
SELECT b.* FROM both_ b WHERE bdif > 0 AND adif > 0 AND abs(adif - bdif) / CAST(least(adif, bdif) AS DOUBLE) <= 0.5
  AND NOT EXISTS (SELECT 1 FROM spanned s WHERE s.aread = b.aread AND s.bread = b.bread AND s.is_inverse = b.is_inverse AND s.ifrom = b.ifrom AND s.ito = b.ito)"""


@query(f"WITH {fx.OVL}, {TANDEM_SQL}, {BRIDGE_SQL}")
def bridge_candidates(spark, d):
    ovl = fx.overlaps(spark, d)
    found = joins.bridge_candidates(ovl, intervals.tandem(ovl), TIE, border=100, max_indel=0.5)
    return found.select("aread", "bread", "is_inverse", "ifrom", "ito", "src_id1", "src_id2", "src_line1", "src_line2", "adif", "bdif")


# Sequences and text


@query(f"WITH {fx.SEQ} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs")
def revcomp(spark, d):
    return fx.sequences(spark, d).select("read_id", scalar.revcomp(F.col("seq")).alias("rc"))


@query(f"WITH {fx.SEQ} SELECT read_id, array_to_string(list_transform(range(0, (greatest(length(seq),1)-1)//80 + 1), lambda i: substr(seq, i*80+1, 80)), chr(10)) AS wrapped FROM seqs")
def wrap_fasta(spark, d):
    return fx.sequences(spark, d).select("read_id", scalar.wrap(F.col("seq"), 80).alias("wrapped"))


@query(f"WITH {fx.SEQ} SELECT read_id, '@r' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('H', length(seq)) AS record FROM seqs")
def to_fastq(spark, d):
    return fx.sequences(spark, d).select("read_id", scalar.fastq(F.concat(F.lit("r"), "read_id"), F.col("seq")).alias("record"))


@query(f"WITH {fx.SEQ} SELECT read_id, 'p/' || read_id || '/0_' || length(seq) || ' RQ=0.851 r' || read_id AS name FROM seqs")
def reformat_names(spark, d):
    return fx.sequences(spark, d).select("read_id", scalar.reformatted_name("p", F.col("read_id"), F.col("seq"), F.concat(F.lit("r"), "read_id")).alias("name"))


@query(f"""WITH {fx.TILES}, e AS (SELECT {T}, aread, CAST(sum(err) AS BIGINT) AS errors FROM tiles GROUP BY {T}, aread)
SELECT o.aread || ' ' || o.bread || ' ' || CASE WHEN is_inverse THEN 'c' ELSE 'n' END || ' [' || abpos || ',' || aepos || ')/' || alen || ' [' || bbpos || ',' || bepos || ')/' || blen
  || ' diffs=' || diffs || ' errors=' || errors AS line, round(CAST(errors AS DOUBLE)/(aepos-abpos), 6) AS error_rate
FROM ovl o JOIN e ON {" AND ".join(f"e.{c} = o.{c}" for c in [*TIE, "aread"])}""")
def show(spark, d):
    return transform.report(fx.traced(spark, d)).select("line", "error_rate")


@query(f"""WITH {fx.R}, b AS (SELECT CAST(sum(rlen) AS BIGINT) AS bases FROM r), c AS (SELECT bases, CAST(floor(bases/50000.0::DOUBLE + 0.5) AS BIGINT) AS coverage, CAST(greatest(1, ceil(bases/{float(BLOCK_BASES)}::DOUBLE)) AS BIGINT) AS blocks FROM b)
SELECT *, 2400*coverage//blocks AS repeat1, 1800*coverage//blocks AS repeat2, 1200*coverage//blocks AS repeat3 FROM c""")
def coverage(spark, d):
    return sizing.coverage(fx.reads(spark, d), 50_000, BLOCK_BASES)


# Text formats, rendered from the overlaps and read again


def _lines(df: DataFrame, line) -> DataFrame:
    return df.select(F.struct(*TIE, "aread").alias("line_no"), line.alias("value"))


def _named(spark, d) -> DataFrame:
    o = fx.overlaps(spark, d)
    names = {"qname": F.concat(F.lit("movie/"), "bread"), "tname": F.concat(F.lit("ref"), "aread"), "tlen": F.col("alen"), "tstart": F.col("abpos"), "tend": F.col("aepos")}
    return o.withColumns({**names, "matches": F.col("aepos") - F.col("abpos") - F.col("diffs"), "mapq": F.lit(60).cast("long"), "cigar": F.concat((F.col("aepos") - F.col("abpos")).cast("string"), F.lit("M"))})


@query(f"WITH {fx.OVL} SELECT {T}, 'ref' || aread AS aname, 'movie/' || bread AS bname, is_inverse, abpos, aepos, bbpos, bepos, alen, blen, (aepos-abpos) || 'M' AS cigar FROM ovl WHERE src_id % 10 <> 0")
def paf_parse(spark, d):
    from readloom.sources import text

    n = _named(spark, d)
    q = {"qlen": F.col("blen"), "qstart": F.when(F.col("is_inverse"), F.col("blen") - F.col("bepos")).otherwise(F.col("bbpos")), "qend": F.when(F.col("is_inverse"), F.col("blen") - F.col("bbpos")).otherwise(F.col("bepos"))}
    line = text.paf_text(n.withColumns(q))
    rows = _lines(n.withColumns(q), F.when(F.col("src_id") % 10 == 0, F.lit("too\tfew\tfields")).otherwise(line))
    return text.paf_overlaps(text.paf(rows)).select(*(F.col(f"line_no.{c}").alias(c) for c in TIE), "aname", "bname", "is_inverse", "abpos", "aepos", "bbpos", "bepos", "alen", "blen", "cigar")


@query(f"""WITH {fx.OVL} SELECT {T}, 'movie/' || bread || '/0_500' AS qname, 'ref' || aread AS tname, is_inverse,
  CASE WHEN is_inverse THEN alen-aepos ELSE abpos END AS tstart, CASE WHEN is_inverse THEN alen-abpos ELSE aepos END AS tend,
  CASE WHEN is_inverse THEN blen-bepos ELSE bbpos END AS qstart, CASE WHEN is_inverse THEN blen-bbpos ELSE bepos END AS qend, bread AS qid
FROM ovl WHERE src_id % 10 <> 0 AND bread % 3 <> 0""")
def m4_parse(spark, d):
    from readloom.sources import text

    n = _named(spark, d)
    cells = [F.concat("qname", F.lit("/0_500")), "tname", F.lit("0"), F.col("is_inverse").cast("int"), F.lit("-100"), F.when(F.col("src_id") % 10 == 0, F.lit("bad")).otherwise(F.lit("87.5")), "abpos", "aepos", "alen", "bbpos", "bepos", "blen", F.lit("5")]
    rows = text.m4(_lines(n, F.concat_ws(" ", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells))))
    reads = fx.reads(spark, d).where("read_id % 3 <> 0").select("read_id", F.concat(F.lit("movie/"), "read_id").alias("name"))
    found = joins.by_name_or_stem(rows, reads, "qname", "qid")
    return found.select(*(F.col(f"line_no.{c}").alias(c) for c in TIE), "qname", "tname", (F.col("qstrand") == 1).alias("is_inverse"), "tstart", "tend", "qstart", "qend", "qid")


@query(f"WITH {fx.SEQ} SELECT 'r' || read_id AS name, 'len ' || length(seq) AS comment, seq FROM seqs")
def fasta_parse(spark, d):
    from readloom.sources import text

    seqs = fx.sequences(spark, d)
    name = F.concat(F.lit("r"), "read_id", F.lit(" len "), F.length("seq"))
    return text.parse_fasta(seqs.select(F.substr(scalar.fasta(name, F.col("seq")), F.lit(2)).alias("value")))


@query(f"WITH {fx.SEQ} SELECT 'r' || read_id AS name, '' AS comment, seq, repeat('H', length(seq)) AS qual FROM seqs")
def fastq_parse(spark, d):
    from readloom.sources import text

    seqs = fx.sequences(spark, d)
    lines = seqs.select("read_id", F.posexplode(F.split(scalar.fastq(F.concat(F.lit("r"), "read_id"), F.col("seq")), "\n")).alias("i", "value"))
    return text.fastq(lines.select((F.col("read_id") * 4 + F.col("i")).alias("line_no"), "value"))


@query(f"WITH {fx.R} SELECT 'r' || read_id AS qname, CAST(read_id % 2 * 16 AS INTEGER) AS flag, 'ref' AS rname, read_id + 1 AS pos, rlen || 'M' AS cigar FROM r WHERE read_id % 7 <> 0")
def sam_round_trip(spark, d):
    from readloom.sources import text

    r = fx.reads(spark, d)
    rows = r.select(F.concat(F.lit("r"), "read_id").alias("qname"), F.when(F.col("read_id") % 7 == 0, 4).otherwise(F.col("read_id") % 2 * 16).cast("int").alias("flag"), F.lit("ref").alias("rname"), (F.col("read_id") + 1).alias("pos"), F.lit(60).alias("mapq"), F.concat(F.col("rlen").cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), F.array(F.lit("NM:i:0")).alias("tags"))
    lines = text.sam_text(rows).withColumn("line_no", F.xxhash64("value"))
    return filters.mapped(text.sam(lines)).select("qname", "flag", "rname", "pos", "cigar")


@query(f"""WITH {fx.OVL} SELECT {T}, aepos-abpos AS ref_length, CAST(5 + (aepos-abpos) + src_line + 3 AS BIGINT) AS read_length, CAST(5 AS BIGINT) AS front_clip, CAST(3 AS BIGINT) AS back_clip,
  CAST(0 AS BIGINT) AS front_del, src_line AS errors FROM ovl""")
def cigar_lengths(spark, d):
    from readloom.functions import cigar

    o = fx.overlaps(spark, d)
    text = F.concat(F.lit("5S"), (F.col("aepos") - F.col("abpos")).cast("string"), F.lit("="), F.col("src_line").cast("string"), F.lit("I3S"))
    return o.withColumn("cigar", text).select(*TIE, *(v.alias(k) for k, v in cigar.lengths(F.col("cigar")).items()))


@query(f"WITH {fx.R}, n AS (SELECT 'read' || (read_id % 1500) AS name, read_id FROM r), o AS (SELECT name, min(read_id) AS read_id FROM n GROUP BY name HAVING count(*) = 1) SELECT 'read' || r.read_id AS qname, o.read_id AS id FROM r JOIN o ON o.name = 'read' || r.read_id")
def name_join(spark, d):
    r = fx.reads(spark, d)
    names = r.select("read_id", F.concat(F.lit("read"), F.col("read_id") % 1500).alias("name"))
    return joins.by_name(r.select(F.concat(F.lit("read"), "read_id").alias("qname")), names, "qname", "id")[0]


@query(f"WITH {fx.R} SELECT 'read' || read_id AS name, rlen + read_id % 3 AS stated, rlen FROM r WHERE read_id % 3 <> 0")
def length_mismatches(spark, d):
    r = fx.reads(spark, d).withColumn("name", F.concat(F.lit("read"), "read_id"))
    return joins.length_violations(r.select("name", (F.col("rlen") + F.col("read_id") % 3).alias("stated")), r, "name", "stated")


CHAINS_SQL = f"""n AS (SELECT *, sum(CAST(is_start AS INT)) OVER (PARTITION BY bread ORDER BY {T}, aread ROWS UNBOUNDED PRECEDING) AS no FROM ovl),
n2 AS (SELECT *, no - min(no) OVER (PARTITION BY bread) AS chain_id, sum(CAST(is_start AS INT)) OVER (PARTITION BY bread) AS n_chains FROM n),
n3 AS (SELECT *, row_number() OVER (PARTITION BY bread, chain_id ORDER BY {T}, aread) - 1 AS chain_link, count(*) OVER (PARTITION BY bread, chain_id) AS n_links FROM n2)"""


@query(f"""WITH {fx.OVL}, {CHAINS_SQL} SELECT {T}, 'b' || bread AS qname, 'a' || aread AS rname, abpos + 1 AS pos,
  CAST(CASE WHEN chain_link > 0 THEN 2048 WHEN chain_id > 0 THEN 256 ELSE 0 END + CASE WHEN is_inverse THEN 16 ELSE 0 END AS INTEGER) AS flag,
  CASE WHEN bbpos > 0 THEN bbpos || 'S' ELSE '' END || (aepos-abpos) || 'M' || CASE WHEN blen-bepos > 0 THEN (blen-bepos) || 'S' ELSE '' END AS sam_cigar,
  'ci:i:' || CAST(chain_id AS BIGINT) || ' cn:i:' || CAST(n_chains AS BIGINT) || ' cj:i:' || chain_link || ' cl:i:' || n_links AS tags FROM n3""")
def to_sam(spark, d):
    from readloom.operators import convert

    names = fx.reads(spark, d)
    o = fx.overlaps(spark, d).withColumn("cigar", F.concat((F.col("aepos") - F.col("abpos")).cast("string"), F.lit("M")))
    out = convert.to_sam(o, names.withColumn("name", F.concat(F.lit("a"), "read_id")), names.withColumn("name", F.concat(F.lit("b"), "read_id")), [*TIE, "aread"])
    return out.select(*TIE, "qname", "rname", "pos", "flag", "sam_cigar", F.array_join("tags", " ").alias("tags"))


@query(f"""WITH {fx.OVL}, s AS (SELECT *, row_number() OVER (PARTITION BY bread ORDER BY bepos-bbpos-diffs DESC, {T}, aread) AS place FROM ovl)
SELECT {T}, CAST(CASE WHEN place > 1 THEN 256 ELSE 0 END + CASE WHEN is_inverse THEN 16 ELSE 0 END AS INTEGER) AS flag,
  'ci:i:' || (place - 1) || ' cn:i:' || count(*) OVER (PARTITION BY bread) || ' cj:i:0 cl:i:1' AS tags FROM s WHERE place <= 5""")
def to_sam_best(spark, d):
    from readloom.operators import convert

    names = fx.reads(spark, d).withColumn("name", F.concat(F.lit("r"), "read_id"))
    return convert.to_sam(fx.overlaps(spark, d), names, names, [*TIE, "aread"], top=5).select(*TIE, "flag", F.array_join("tags", " ").alias("tags"))


@query(f"WITH {fx.OVL} SELECT aread, bread, is_inverse, abpos, aepos, bbpos, bbpos + (aepos-abpos) AS bepos, CAST(0 AS BIGINT) AS diffs, alen, blen FROM ovl WHERE src_line <> 3")
def from_sam(spark, d):
    from readloom.operators import convert

    o = fx.overlaps(spark, d)
    name = fx.reads(spark, d).withColumn("name", F.concat(F.lit("r"), "read_id"))
    sam = o.select(F.concat(F.lit("r"), "bread").alias("qname"), (F.when(F.col("is_inverse"), 16).otherwise(0) + F.when(F.col("src_line") == 3, 4).otherwise(0)).alias("flag"), F.concat(F.lit("r"), "aread").alias("rname"), (F.col("abpos") + 1).alias("pos"), F.concat(F.when(F.col("bbpos") > 0, F.concat(F.col("bbpos").cast("string"), F.lit("S"))).otherwise(""), (F.col("aepos") - F.col("abpos")).cast("string"), F.lit("=4S")).alias("cigar"))
    return convert.from_sam(sam, name, name).drop("cigar")


# Reads as FASTA, places on the reference, alignments with their traces

SEQ_WRAP = "CASE WHEN length(seq) > 0 THEN chr(10) || array_to_string(list_transform(range(0, (length(seq)-1)//80 + 1), lambda i: substr(seq, i*80+1, 80)), chr(10)) ELSE '' END"


@query(f"""WITH {fx.OVL}, {fx.SEQ}, ids AS (SELECT aread AS id FROM ovl UNION SELECT bread FROM ovl), n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM ids)
SELECT read_id, new_id, '>L0/' || read_id || '/0_' || length(seq) || {SEQ_WRAP} AS record FROM seqs JOIN n ON id = read_id""")
def subset_fasta(spark, d):
    return export.subset(fx.overlaps(spark, d), fx.sequences(spark, d))[1]


READ_SEQS = "rs AS MATERIALIZED (SELECT r.read_id, rlen, seq FROM r JOIN seqs ON seqs.read_id = r.read_id)"


@query(f"""WITH {fx.R}, {fx.SEQ}, {READ_SEQS}, {SAMPLE_SQL.replace("FROM r)", "FROM rs)")},
n AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS new_id FROM kept)
SELECT n.read_id, new_id, '>L0/' || new_id || '/0_' || length(seq) || ' ' || n.read_id || '[0,' || length(seq) || ')' || {SEQ_WRAP} AS record FROM n JOIN rs ON rs.read_id = n.read_id""")
def reduce_fasta(spark, d):
    reads = fx.reads(spark, d).join(fx.sequences(spark, d), "read_id")
    return export.reduce(fx.overlaps(spark, d), reads, 0.3, 5)[1]


@query(f"""WITH {fx.SEQ}, t AS (SELECT read_id AS old, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, row_number() OVER (ORDER BY read_id) - 1 AS read_id FROM seqs WHERE length(seq) >= 100)
SELECT read_id, '>r' || old || {SEQ_WRAP} AS record FROM t WHERE read_id BETWEEN 20 AND 699""")
def extract_fasta(spark, d):
    reads = fx.sequences(spark, d).select("read_id", F.concat(F.lit("r"), "read_id").alias("name"), F.length("seq").cast("long").alias("rlen"), "seq")
    return export.extract(reads, "20-700", cutoff=100, reverse=True)


@query(f"""WITH {fx.SEQ}, t AS (SELECT read_id, seq, row_number() OVER (ORDER BY read_id) - 1 + 3 AS number FROM seqs)
SELECT number, '>P/' || number || '/0_' || length(seq) || ' RQ=0.851 r' || read_id || CASE WHEN read_id % 2 = 0 THEN ' c' || read_id ELSE '' END || {SEQ_WRAP} AS record FROM t""")
def reformat_fasta(spark, d):
    comment = F.when(F.col("read_id") % 2 == 0, F.concat(F.lit("c"), "read_id")).otherwise("")
    records = fx.sequences(spark, d).select("read_id", F.concat(F.lit("r"), "read_id").alias("name"), comment.alias("comment"), "seq")
    return export.reformat(records, ["read_id"], "P", 3)


@query(f"""WITH l AS (SELECT doc_id AS read_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS raw, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents),
p AS (SELECT read_id, number, raw, unnest(range(length(raw))) AS i FROM l),
c AS (SELECT read_id, number, i, upper(substr(raw, i + 1, 1)) AS c FROM p),
b AS (SELECT number, string_agg(CASE WHEN c IN ('A', 'C', 'G', 'T') THEN c ELSE substr('ACGT', CAST((number * 31 + i * 17) % 4 AS BIGINT) + 1, 1) END, '' ORDER BY i) AS bases FROM c GROUP BY number),
t AS (SELECT l.read_id, l.number, CASE WHEN raw = '' THEN '' ELSE bases END AS seq FROM l LEFT JOIN b ON b.number = l.number)
SELECT number, '>L/' || number || '/0_' || length(seq) || ' RQ=0.851 r' || read_id || {SEQ_WRAP} AS record FROM t""")
def reformat_ambiguous(spark, d):
    """As ``reformat_fasta``, of the letters of whole texts, most of which are no bases and give way to one."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    records = docs.select("doc_id", F.concat(F.lit("r"), "doc_id").alias("name"), F.lit("").alias("comment"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    return export.reformat(records, ["doc_id"])


@query("SELECT doc_id AS read_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents")
def four_letters(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("read_id"), scalar.four_letters(F.col("text")).alias("seq"))


@query("""WITH b AS (SELECT doc_id AS read_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, '[^ACGTacgt]', '', 'g') END AS seq FROM documents)
SELECT read_id, length(regexp_replace(seq, '[ACGTacgt]', '', 'g')) AS n_bad, length(regexp_extract(seq, '^[ACGTacgt]*')) AS first_bad FROM b WHERE regexp_matches(seq, '[^ACGTacgt]')""")
def indeterminate_bases(spark, d):
    """Of every third document the text as it is, of others its bases, as reads."""
    seq = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[^ACGTacgt]", ""))
    return checks.indeterminate(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("read_id"), seq.alias("seq")))


CIGAR_OPS = "=XMNP*"


@query(f"""WITH {fx.OVL}, c AS (SELECT {T}, aread, src_id % 40 || 'S' || (aepos - abpos) || substr('{CIGAR_OPS}', CAST(src_id % 6 AS BIGINT) + 1, 1) || CASE WHEN src_line % 2 = 0 THEN '3I2D' ELSE '' END AS cigar FROM ovl)
SELECT {T}, aread, cigar, src_id % 6 < 2 AS is_strict, src_id % 6 < 3 AS is_resolvable, CASE WHEN src_id % 6 > 2 THEN substr('{CIGAR_OPS}', CAST(src_id % 6 AS BIGINT) + 1, 1) ELSE '' END AS other FROM c""")
def cigar_alphabet(spark, d):
    op = F.substring(F.lit(CIGAR_OPS), (F.col("src_id") % 6 + 1).cast("int"), F.lit(1))
    tail = F.when(F.col("src_line") % 2 == 0, "3I2D").otherwise("")
    cigar = F.concat((F.col("src_id") % 40).cast("string"), F.lit("S"), (F.col("aepos") - F.col("abpos")).cast("string"), op, tail)
    return checks.cigar_alphabet(fx.overlaps(spark, d).select(*TIE, "aread", cigar.alias("cigar")))


@query(f"WITH {fx.SEQ} SELECT 'r' || read_id % 700 AS name, min(length(seq)) AS rlen FROM seqs GROUP BY 1")
def fasta_lengths(spark, d):
    return export.name_lengths(fx.sequences(spark, d).select(F.concat(F.lit("r"), F.col("read_id") % 700).alias("name"), "seq"))


@query("SELECT p_partkey AS read_id, CASE p_partkey % 3 WHEN 0 THEN 'fasta' WHEN 1 THEN 'fastq' ELSE 'empty' END AS kind FROM part")
def text_kind(spark, d):
    from readloom.sources import text

    first = F.when(F.col("read_id") % 3 == 0, ">").when(F.col("read_id") % 3 == 1, "@").otherwise("")
    return fx.reads(spark, d).select("read_id", text.kind(first).alias("kind"))


@query(f"""WITH {fx.OVL} SELECT '=' AS op, count(*) AS runs, sum(aepos-abpos) AS length FROM ovl UNION ALL SELECT 'I', count(*), sum(src_line) FROM ovl
UNION ALL SELECT 'S', 2 * count(*), 8 * count(*) FROM ovl""")
def cigar_operators(spark, d):
    text = F.concat(F.lit("5S"), (F.col("aepos") - F.col("abpos")).cast("string"), F.lit("="), F.col("src_line").cast("string"), F.lit("I3S"))
    return summary.cigar_operators(fx.overlaps(spark, d).select(text.alias("cigar")))


@query(f"""WITH {fx.OVL} SELECT {T}, CASE WHEN src_line % 2 = 0 THEN '4S' ELSE '' END || (aepos-abpos) || '=' AS cigar, abpos + src_line + 2 AS pos FROM ovl""")
def cigar_shift(spark, d):
    from readloom.functions import cigar

    o = fx.overlaps(spark, d)
    text = F.concat(F.when(F.col("src_line") % 2 == 0, "4S").otherwise(""), F.col("src_line").cast("string"), F.lit("D2D"), (F.col("aepos") - F.col("abpos")).cast("string"), F.lit("="))
    return o.withColumn("text", text).select(*TIE, *(c.alias(k) for k, c in cigar.shifted(F.col("text"), F.col("abpos")).items()))


@query(f"""WITH {fx.R}, c AS (SELECT read_id, rlen, read_id % 2 = 1 AS back, 1000 + read_id AS pos, read_id % 4 + 1 AS k, rlen - 159 - read_id % 4 AS x, (read_id * 37) % (rlen - 200) AS ifrom FROM r),
p AS (SELECT *, ifrom + 150 AS ito, CASE WHEN back THEN rlen - ifrom - 150 ELSE ifrom END AS f, CASE WHEN back THEN rlen - ifrom - 1 ELSE ifrom + 149 END AS l FROM c)
SELECT read_id, ifrom, ito, {", ".join(f"CASE WHEN {v} < 5 THEN NULL WHEN {v}-5 < x THEN pos+{v}-5 WHEN {v}-5 < x+k THEN pos+x WHEN {v}-5 < x+k+100 THEN pos+{v}-5-k WHEN {v}-5 < x+k+150 THEN pos+{v}-5-k+2 END AS {n}" for v, n in (("f", "rfrom"), ("l", "rto")))} FROM p""")
def reference_places(spark, d):
    r = fx.reads(spark, d)
    k = F.col("read_id") % 4 + 1
    cigar = F.concat(F.lit("5S"), (F.col("rlen") - 158 - k).cast("string"), F.lit("="), k.cast("string"), F.lit("I100=2D50M3S"))
    records = r.select(F.col("read_id").alias("rec_no"), (F.col("read_id") % 2 * 16).cast("int").alias("flag"), (1000 + F.col("read_id")).alias("pos"), cigar.alias("cigar"))
    first = (F.col("read_id") * 37) % (F.col("rlen") - 200)
    return joins.on_reference(r.select("read_id", first.alias("ifrom"), (first + 150).alias("ito")), records)


@query(f"""WITH {fx.OVL}, lagged AS (SELECT src_id % 3 AS src, (aread, bread, is_inverse, abpos, aepos, bbpos, bepos, diffs) AS k,
  lag((aread, bread, is_inverse, abpos, aepos, bbpos, bepos, diffs)) OVER (PARTITION BY src_id % 3 ORDER BY src_id, src_line, src_supp, src_qty, src_price, aread) AS before FROM ovl)
SELECT src, count(*) FILTER (WHERE before > k) AS unsorted FROM lagged GROUP BY src""")
def sorted_check(spark, d):
    ovl = fx.overlaps(spark, d).withColumns({"src": F.col("src_id") % 3, "at": F.struct(*TIE, "aread")})
    return checks.sorted_verdict(ovl, "canonical", "at", "src", [], bucket=F.floor(F.col("src_id") / 1024))


@query(f"WITH {fx.OVL}, {BLOCK_SQL} SELECT {T}, aread, bread FROM ovl WHERE bread IN (SELECT read_id FROM blk WHERE block = 2)")
def block_members(spark, d):
    return joins.in_block(fx.overlaps(spark, d), renumber.blocks(fx.reads(spark, d), BLOCK_BASES), 2, "bread").select(*TIE, "aread", "bread")


@query(f"WITH {fx.OVL} SELECT {T}, aread, alen, rlen + 7 AS blen FROM ovl JOIN r ON read_id = bread WHERE bread % 3 = 0")
def join_other_reads(spark, d):
    """B reads from a database of their own."""
    other = fx.reads(spark, d).where("read_id % 3 = 0").withColumn("rlen", F.col("rlen") + 7)
    return joins.with_lengths(fx.overlaps(spark, d).drop("alen", "blen"), fx.reads(spark, d), other).select(*TIE, "aread", "alen", "blen")


def _near_reads(spark, d):
    """Each sequence of 3 bases or more, and a copy that lacks the base in its middle."""
    s = fx.sequences(spark, d).where(F.length("seq") >= 3).withColumn("h", F.floor(F.length("seq") / 2).cast("int"))
    refs = s.select("read_id", F.concat(F.lit("ref"), "read_id").alias("name"), F.length("seq").cast("long").alias("rlen"), "seq", "h")
    near = F.concat(F.substring(F.col("seq"), F.lit(1), F.col("h")), F.substring(F.col("seq"), F.col("h") + 2, F.length("seq")))
    return refs, refs.select("read_id", F.concat(F.lit("read"), "read_id").alias("name"), (F.col("rlen") - 1).alias("rlen"), near.alias("seq"))


@query(f"""WITH {fx.SEQ} SELECT read_id AS aread, read_id AS bread, FALSE AS is_inverse, CAST(0 AS BIGINT) AS abpos, length(seq) AS aepos, CAST(0 AS BIGINT) AS bbpos, length(seq) - 1 AS bepos,
  CAST(1 AS BIGINT) AS diffs, CAST((length(seq) + 99) // 100 AS BIGINT) AS tiles, CAST(1 AS BIGINT) AS errors, length(seq) - 1 AS b_length FROM seqs WHERE length(seq) >= 3""")
def paf_overlaps(spark, d):
    """PAF lines, half of them without a CIGAR string, to overlaps with ids and traces."""
    from readloom.sources import text

    refs, reads = _near_reads(spark, d)
    n, h = F.col("rlen"), F.col("h")
    cigar = F.concat(h.cast("string"), F.lit("M1D"), (n - h - 1).cast("string"), F.lit("="))
    zero = F.lit(0).cast("long")
    rows = refs.select("read_id", F.concat(F.lit("read"), "read_id").alias("qname"), (n - 1).alias("qlen"), zero.alias("qstart"), (n - 1).alias("qend"), F.lit(False).alias("is_inverse"), F.col("name").alias("tname"), n.alias("tlen"), zero.alias("tstart"), n.alias("tend"), (n - 1).alias("matches"), n.alias("alen"), F.lit(60).alias("mapq"), F.when(F.col("read_id") % 2 == 0, cigar).alias("cigar"))
    lines = rows.select(F.col("read_id").alias("line_no"), text.paf_text(rows).alias("value"))
    found = convert.from_paf(text.paf_overlaps(text.paf(lines)), refs, reads)
    sums = {"tiles": F.size("trace").cast("long"), "errors": trace.error_sum(F.col("trace")), "b_length": trace.b_length(F.col("trace"))}
    return found.select(*convert.SPAN, "diffs", *(c.alias(k) for k, c in sums.items()))


@query(f"""WITH {fx.SEQ} SELECT read_id, 'read' || read_id || '/0_9' AS qname, CAST(0 AS INTEGER) AS flag, 'ref' || read_id AS rname, CAST(1 AS BIGINT) AS pos, length(seq) AS ref_length, length(seq) - 1 AS read_length,
  CAST(1 AS BIGINT) AS errors FROM seqs WHERE length(seq) >= 3""")
def m4_records(spark, d):
    """m4 lines to SAM records, names by their stem."""
    from readloom.functions import cigar
    from readloom.sources import text

    refs, reads = _near_reads(spark, d)
    cells = [F.concat(F.lit("read"), "read_id", F.lit("/0_9")), F.col("name"), F.lit("0"), F.lit("0"), F.lit("-100"), F.lit("99"), F.lit("0"), F.col("rlen"), F.col("rlen"), F.lit("0"), F.col("rlen") - 1, F.col("rlen") - 1, F.lit("5")]
    lines = refs.select(F.col("read_id").alias("line_no"), F.concat_ws(" ", *(c.cast("string") for c in cells)).alias("value"))
    sam = convert.m4_to_sam(text.m4(lines), refs, reads, ["line_no"])
    n = cigar.lengths(F.col("cigar"))
    return sam.select(F.col("line_no").alias("read_id"), "qname", "flag", "rname", "pos", *(n[k].alias(k) for k in ("ref_length", "read_length", "errors")))


from readloom import catalog_bases  # noqa: E402, F401  (registers its queries here)
