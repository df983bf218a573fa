"""Overlap, read, sequence, quality and mask relations derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TS = 100
#: Columns that tell any two rows of ``overlaps`` apart.
TIE = ["src_id", "src_line", "src_supp", "src_qty", "src_price"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of a table dealt to all cores where it has fewer files than there are cores: a file of one row group is read
    by one task, and so would be all that follows without a shuffle. A table of more files is left as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("read_id"), (2000 + 40 * F.col("p_size")).cast("long").alias("rlen"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("src_id"),
        F.col("l_linenumber").cast("long").alias("src_line"),
        F.col("l_suppkey").cast("long").alias("src_supp"),
        F.col("l_quantity").cast("double").alias("src_qty"),
        F.col("l_extendedprice").cast("double").alias("src_price"),
        F.col("l_discount").cast("double").alias("discount"),
        F.col("l_partkey").cast("long").alias("aread"),
        (F.col("l_partkey") + F.col("l_suppkey") % 8).cast("long").alias("bread"),
        (F.col("l_returnflag") == "R").alias("is_inverse"),
        (F.col("l_linestatus") == "O").alias("is_start"),
    )
    j = _dealt(lines).join(r.select(F.col("read_id").alias("aread"), F.col("rlen").alias("alen")), "aread")
    j = j.join(r.select(F.col("read_id").alias("bread"), F.col("rlen").alias("blen")), "bread")
    abpos = F.when(F.col("src_id") % 11 == 0, 0).otherwise((50 * (F.col("src_qty").cast("long") - 1)) % (F.col("alen") - 1000))
    span = F.when(F.col("src_id") % 11 == 0, 5000).otherwise(100 + (F.col("src_id") % 13) * 150)
    j = j.withColumns({"abpos": abpos.cast("long"), "bbpos": F.when(F.col("src_id") % 17 == 0, 0).otherwise(100 * (F.col("src_id") % 5)).cast("long"), "span": span})
    j = j.withColumn("aepos", F.least("alen", F.col("abpos") + F.col("span")).cast("long"))
    reach = F.least("blen", F.col("bbpos") + F.col("aepos") - F.col("abpos") + 10 * (F.col("src_line") - 4))
    bepos = F.when(F.col("src_id") % 17 == 0, F.col("blen")).otherwise(reach).cast("long")
    diffs = F.round((F.col("aepos") - F.col("abpos")) * F.col("discount")).cast("long")
    j = j.withColumns({"bepos": bepos, "diffs": diffs})
    return j.select(*TIE, "aread", "bread", "is_inverse", "is_start", "alen", "blen", "abpos", "aepos", "bbpos", "bepos", "diffs")


def with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlaps(spark, sf_dir)
    return o.unionByName(o.where("src_id % 7 = 0"))


def symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.operators.transform import swapped

    names = ["aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos", "alen", "blen"]
    o = overlaps(spark, sf_dir)
    return o.select(*names).unionByName(swapped(o.where("(aread + bread) % 5 <> 0")).select(*names))


def traced(spark: SparkSession, sf_dir: str, ts: int = TS) -> DataFrame:
    """``overlaps`` with a trace: the B span spread evenly over the tiles, errors from the row and tile numbers."""
    from readloom.functions.trace import first_tile, last_tile

    o = overlaps(spark, sf_dir).withColumn("n", last_tile(F.col("aepos"), ts) - first_tile(F.col("abpos"), ts) + 1)
    s = F.col("bepos") - F.col("bbpos")

    def upto(i):
        return F.floor(s * i / F.col("n"))

    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(((F.col("src_id") + i) % 7).cast("int").alias("err"), (upto(i + 1) - upto(i)).cast("int").alias("blen")))
    return o.withColumn("trace", cells).drop("n")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("read_id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def qualities(spark: SparkSession, sf_dir: str, ts: int = TS) -> DataFrame:
    """One value for each tile of each read, lower is better."""
    q = F.transform(F.sequence(F.lit(0), F.ceil(F.col("rlen") / ts).cast("int") - 1), lambda t: ((F.col("read_id") * 31 + t * 17) % 50).cast("int"))
    return reads(spark, sf_dir).select("read_id", q.alias("q"))


#: The same relations for DuckDB, as common table expressions by name.
R = "r AS MATERIALIZED (SELECT CAST(p_partkey AS BIGINT) AS read_id, CAST(2000 + 40*p_size AS BIGINT) AS rlen FROM part)"
OVL = (
    R
    + """,
j AS (
  SELECT CAST(l_orderkey AS BIGINT) AS src_id, CAST(l_linenumber AS BIGINT) AS src_line, CAST(l_suppkey AS BIGINT) AS src_supp,
         CAST(l_quantity AS DOUBLE) AS src_qty, CAST(l_extendedprice AS DOUBLE) AS src_price, CAST(l_discount AS DOUBLE) AS discount,
         CAST(l_partkey AS BIGINT) AS aread, CAST(l_partkey + l_suppkey % 8 AS BIGINT) AS bread, ra.rlen AS alen, rb.rlen AS blen,
         l_returnflag = 'R' AS is_inverse, l_linestatus = 'O' AS is_start,
         CAST(CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE (50*(CAST(l_quantity AS BIGINT)-1)) % (ra.rlen-1000) END AS BIGINT) AS abpos,
         CAST(CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE 100*(l_orderkey % 5) END AS BIGINT) AS bbpos,
         CAST(CASE WHEN l_orderkey % 11 = 0 THEN 5000 ELSE 100 + (l_orderkey % 13)*150 END AS BIGINT) AS span
  FROM lineitem JOIN r ra ON ra.read_id = l_partkey JOIN r rb ON rb.read_id = l_partkey + l_suppkey % 8),
k AS (SELECT j.*, least(alen, abpos+span) AS aepos FROM j),
ovl AS MATERIALIZED (
  SELECT src_id, src_line, src_supp, src_qty, src_price, aread, bread, is_inverse, is_start, alen, blen, abpos, aepos, bbpos,
         CASE WHEN src_id % 17 = 0 THEN blen ELSE least(blen, bbpos + (aepos-abpos) + 10*(src_line-4)) END AS bepos,
         CAST(round((aepos-abpos)*discount) AS BIGINT) AS diffs
  FROM k)"""
)
DUP = OVL + ",\ndup AS MATERIALIZED (SELECT * FROM ovl UNION ALL SELECT * FROM ovl WHERE src_id % 7 = 0)"
SWAP = """SELECT bread AS aread, aread AS bread, is_inverse,
       CASE WHEN is_inverse THEN blen-bepos ELSE bbpos END AS abpos, CASE WHEN is_inverse THEN blen-bbpos ELSE bepos END AS aepos,
       CASE WHEN is_inverse THEN alen-aepos ELSE abpos END AS bbpos, CASE WHEN is_inverse THEN alen-abpos ELSE aepos END AS bepos,
       blen AS alen, alen AS blen"""
SYM = OVL + f""",
sym AS MATERIALIZED (
  SELECT aread, bread, is_inverse, abpos, aepos, bbpos, bepos, alen, blen FROM ovl
  UNION ALL {SWAP} FROM ovl WHERE (aread+bread) % 5 <> 0)"""
TILES = OVL + f""",
tiles AS MATERIALIZED (
  SELECT x.*, greatest(abpos, t*{TS}) AS tb, least(aepos, (t+1)*{TS}) AS te, t - t0 AS i, (src_id + t - t0) % 7 AS err,
         ((bepos-bbpos)*(t-t0+1))//n - ((bepos-bbpos)*(t-t0))//n AS tlen, bbpos + ((bepos-bbpos)*(t-t0))//n AS tbb
  FROM (SELECT *, abpos//{TS} AS t0, (aepos-1)//{TS} - abpos//{TS} + 1 AS n, unnest(range(abpos//{TS}, (aepos-1)//{TS} + 1)) AS t FROM ovl) x)"""
SEQ = "seqs AS MATERIALIZED (SELECT doc_id AS read_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
QUAL = R + f""",
qual AS MATERIALIZED (
  SELECT read_id, rlen, t, CAST((read_id*31 + t*17) % 50 AS INTEGER) AS q
  FROM (SELECT read_id, rlen, unnest(range(0, (rlen + {TS-1}) // {TS})) AS t FROM r) x)"""
