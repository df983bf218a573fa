"""Joins of overlaps with reads, intervals and one another. Spark chooses to broadcast by the size of a side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions.scalar import indel_error, revcomp
from readloom.functions.trace import points
from readloom.operators.transform import swapped

GROUP = ["aread", "bread", "is_inverse"]


def with_lengths(ovl: DataFrame, a_reads: DataFrame, b_reads: DataFrame | None = None) -> DataFrame:
    """``ovl`` with alen and blen. ``b_reads``: where B reads come from another database."""
    b = a_reads if b_reads is None else b_reads
    a = a_reads.select(F.col("read_id").alias("aread"), F.col("rlen").alias("alen"))
    return ovl.join(a, "aread").join(b.select(F.col("read_id").alias("bread"), F.col("rlen").alias("blen")), "bread")


def with_sequences(ovl: DataFrame, a_reads: DataFrame, b_reads: DataFrame | None = None) -> DataFrame:
    """``ovl`` with aseq and bseq, B in the orientation of the alignment."""
    b = a_reads if b_reads is None else b_reads
    both = ovl.join(a_reads.select(F.col("read_id").alias("aread"), F.col("seq").alias("aseq")), "aread")
    both = both.join(b.select(F.col("read_id").alias("bread"), F.col("seq").alias("bseq")), "bread")
    return both.withColumn("bseq", F.when(F.col("is_inverse"), revcomp(F.col("bseq"))).otherwise(F.col("bseq")))


def both_in(ovl: DataFrame, ids: DataFrame) -> DataFrame:
    """Overlaps whose reads are both in ``ids`` (read_id)."""
    kept = ids.select("read_id").distinct()
    return ovl.join(kept.withColumnRenamed("read_id", "aread"), "aread", "left_semi").join(kept.withColumnRenamed("read_id", "bread"), "bread", "left_semi")


def touching(ovl: DataFrame, intervals: DataFrame, key: list[str], closed_end: bool = False) -> DataFrame:
    """Overlaps whose A span hits an interval of A's read, or whose B span one of B's (``intervals``: read_id, ifrom, ito).

    ``closed_end`` takes ``ito`` as the last place in the interval. ``key`` tells rows of ``ovl`` apart.
    """
    return touching_either(ovl, intervals, closed_end).dropDuplicates(key)


def touching_either(ovl: DataFrame, intervals: DataFrame, closed_end: bool = False) -> DataFrame:
    """As ``touching``, with rows that both ends touch by twice: two semi joins on the read, one for each end, take the place
    of one join on either; both are hash or merge joins."""
    end = F.col("ito") + (1 if closed_end else 0)
    i = intervals.select("read_id", "ifrom", end.alias("iend"))
    on_a = ovl.join(i, (F.col("aread") == F.col("read_id")) & (F.col("abpos") < F.col("iend")) & (F.col("ifrom") < F.col("aepos")), "left_semi")
    on_b = ovl.join(i, (F.col("bread") == F.col("read_id")) & (F.col("bbpos") < F.col("iend")) & (F.col("ifrom") < F.col("bepos")), "left_semi")
    return on_a.unionByName(on_b)


def asymmetric(ovl: DataFrame) -> DataFrame:
    """Overlaps (with alen, blen) without their twin, seen from B, in the table."""
    key = ["aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos"]
    return ovl.join(swapped(ovl).select(*key).distinct(), key, "left_anti")


def by_name(rows: DataFrame, names: DataFrame, column: str, out: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``out``, the id of the one entry of ``names`` (read_id, name) named by ``column``; and the rows whose
    name is unknown or has several entries."""
    once = names.groupBy("name").agg(F.count("*").alias("n"), F.min("read_id").alias(out)).where("n = 1")
    once = once.select(F.col("name").alias(column), out)
    return rows.join(once, column), rows.join(once, column, "left_anti")


def by_name_or_stem(rows: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """As ``by_name``, but a name that is unknown is looked up without what follows its last ``/``. Others go."""
    once = names.groupBy("name").agg(F.count("*").alias("n"), F.min("read_id").alias("id")).where("n = 1")
    full = rows.join(once.select(F.col("name").alias(column), F.col("id").alias("full_id")), column, "left")
    full = full.withColumn("stem", F.regexp_extract(column, "^(.*)/[^/]*$", 1))
    both = full.join(once.select(F.col("name").alias("stem"), F.col("id").alias("stem_id")), "stem", "left")
    return both.withColumn(out, F.coalesce("full_id", "stem_id")).where(F.col(out).isNotNull()).drop("stem", "full_id", "stem_id")


def length_violations(rows: DataFrame, reads: DataFrame, name: str, length: str) -> DataFrame:
    """Rows whose stated length isn't that of the read with that name, with the right one as ``rlen``."""
    return rows.join(reads.select(F.col("name").alias(name), "rlen"), name).where(F.col(length) != F.col("rlen"))


#: Letters of reads, in the order of the digits 1 to 9 and 0.
LETTERS = "ACGTNacgtn"
#: Places of a read whose k-mers are cut from one piece of it.
STRETCH = 256


def kmers(reads: DataFrame, k: int, keep: list[str] = ("read_id",)) -> DataFrame:
    """``keep``, pos and kmer of reads (``keep``, seq): the k-mers as numbers, a digit each letter, or as text if ``k`` is over
    18. K-mers with other than LETTERS are left out."""
    # Translated below the explosions, once a read. A substring costs as its place, so reads are cut in stretches first.
    whole = reads.where(F.length("seq") >= k).select(*keep, F.translate("seq", LETTERS, "1234567890").alias("digits"))
    stretches = whole.select(*keep, "digits", F.explode(F.sequence(F.lit(0), F.length("digits") - k, F.lit(STRETCH))).alias("from"))
    stretches = stretches.select(*keep, "from", F.substring(F.col("digits"), F.col("from") + 1, F.lit(STRETCH + k - 1)).alias("part"))
    each = stretches.select(*keep, "from", "part", F.explode(F.sequence(F.lit(0), F.length("part") - k)).alias("i"))
    at = F.substring(F.col("part"), F.col("i") + 1, F.lit(k))
    pos = (F.col("from") + F.col("i")).cast("long").alias("pos")
    each = each.select(*keep, pos, (at.try_cast("long") if k <= 18 else F.when(at.rlike("^[0-9]*$"), at)).alias("kmer"))
    return each.where("kmer is not null")


def seeds(reads: DataFrame, pairs: DataFrame, k: int = 14) -> DataFrame:
    """(aread, bread, apos, bpos, diagonal): the places of each k-mer that the reads of a pair share. Pairs get their sequences
    first, so that only the k-mers of reads in pairs are made. The pair is part of the join key, so that a k-mer frequent over
    all reads meets only itself within a pair."""
    d, pair = pairs.select("aread", "bread").distinct(), ["aread", "bread"]
    # Few bytes make many rows here: as many tasks as a shuffle has, whatever the size of the sequences.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_seq = (d.join(reads.select(F.col("read_id").alias(x), "seq"), x).repartition(tasks, *pair) for x in pair)
    a, b = (kmers(rows, k, pair).withColumnRenamed("pos", at) for rows, at in zip(with_seq, ("apos", "bpos")))
    both = a.join(b, [*pair, "kmer"])
    return both.select(*pair, "apos", "bpos", (F.col("apos") - F.col("bpos")).alias("diagonal"))


def maybe_sharing(ovl: DataFrame, names: list[str], ts: int = 100) -> DataFrame:
    """Rows of ``ovl`` without those that share no trace point with another row of their group; a few of these may stay, as hashes
    collide. Only hashes of points and of the columns ``names``, which tell rows apart, are shuffled for all points."""
    each = ovl.select(F.xxhash64(*names).alias("_row"), *GROUP, F.inline(points(F.col("abpos"), F.col("aepos"), F.col("bbpos"), F.col("trace"), ts)))
    slim = each.select("_row", F.xxhash64(*GROUP, "apos", "bpos").alias("_point"))
    shared = slim.withColumn("_n", F.count("*").over(Window.partitionBy("_point"))).where("_n > 1").select("_row").distinct()
    return ovl.withColumn("_row", F.xxhash64(*names)).join(shared, "_row", "left_semi").drop("_row")


def without_kills(ovl: DataFrame, kills: DataFrame) -> DataFrame:
    key = ["aread", "bread", "is_inverse", "abpos", "aepos", "bbpos", "bepos"]
    return ovl.join(kills.select(*key).distinct(), key, "left_anti")


def in_block(ovl: DataFrame, blocks: DataFrame, block: int, side: str = "aread") -> DataFrame:
    """Overlaps whose A or B read lies in one block (``blocks``: read_id, block)."""
    return ovl.join(blocks.where(F.col("block") == block).select(F.col("read_id").alias(side)), side, "left_semi").select(*ovl.columns)


def on_reference(intervals: DataFrame, records: DataFrame) -> DataFrame:
    """(read_id, ifrom, ito, rfrom, rto): intervals of reads (half open) as places of the reference that the reads are known
    to come from (``records``: rec_no, flag, pos, cigar, where record n is that of read n). Both places are those of bases,
    the first and the last; on a reversed read they are looked up from its other end."""
    from readloom.functions.cigar import lengths, ref_position

    n = lengths(F.col("cigar"))["read_length"]
    back = F.col("flag").bitwiseAND(F.lit(16)) != 0
    first = F.when(back, n - F.col("ito")).otherwise(F.col("ifrom"))
    last = F.when(back, n - F.col("ifrom") - 1).otherwise(F.col("ito") - 1)
    both = intervals.join(records.select(F.col("rec_no").alias("read_id"), "flag", "pos", "cigar"), "read_id")
    places = {"rfrom": ref_position(F.col("cigar"), F.col("pos"), first), "rto": ref_position(F.col("cigar"), F.col("pos"), last)}
    return both.select("read_id", "ifrom", "ito", *(c.alias(k) for k, c in places.items()))


def bridge_roles(ovl: DataFrame, masks: DataFrame, keep: list[str], border: int = 500) -> DataFrame:
    """Overlaps beside the masked intervals of their A read (``masks``: read_id, ifrom, ito) that they matter to, with ``role``:
    ``span`` holds the interval with ``border`` on both sides; ``left`` goes through the interval's begin with ``border`` on
    both sides of it, ``right`` through its end."""
    m = masks.select(F.col("read_id").alias("aread"), "ifrom", "ito").distinct()
    near = ovl.select(*GROUP, *keep, "abpos", "aepos", "bbpos", "bepos").join(m, "aread")
    early, late = F.col("abpos") <= F.col("ifrom") - border, F.col("aepos") >= F.col("ito") + border
    role = F.when(early & late, "span").when(early & (F.col("aepos") >= F.col("ifrom") + border), "left")
    return near.withColumn("role", role.when(late & (F.col("abpos") <= F.col("ito") - border), "right")).where("role is not null")


BRIDGED = [*GROUP, "ifrom", "ito"]


def bridge_pairs(left: DataFrame, right: DataFrame, tie: list[str], max_indel: float = 0.3) -> DataFrame:
    """Pairs of a left and a right anchor of one interval: ``tie`` of both, with 1 and 2 behind, and the span from the left one's
    begin to the right one's end, as adif on A and bdif on B. Kept if bdif is positive and their indel error is at most
    ``max_indel``."""
    l = left.select(*BRIDGED, *(F.col(c).alias(f"{c}1") for c in tie), F.col("abpos").alias("abegin"), F.col("bbpos").alias("bbegin"))
    r = right.select(*BRIDGED, *(F.col(c).alias(f"{c}2") for c in tie), F.col("aepos").alias("aend"), F.col("bepos").alias("bend"))
    both = l.join(r, BRIDGED).withColumns({"adif": F.col("aend") - F.col("abegin"), "bdif": F.col("bend") - F.col("bbegin")})
    return both.where("bdif > 0").withColumn("indel", indel_error(F.col("adif"), F.col("bdif"))).where(F.col("indel") <= max_indel)


def bridge_candidates(ovl: DataFrame, masks: DataFrame, tie: list[str], border: int = 500, max_indel: float = 0.3) -> DataFrame:
    """``bridge_pairs`` of the overlaps of each (aread, bread, is_inverse), for intervals that none of its overlaps spans."""
    roles = bridge_roles(ovl, masks, tie, border)
    pairs = bridge_pairs(roles.where("role = 'left'"), roles.where("role = 'right'"), tie, max_indel)
    return pairs.join(roles.where("role = 'span'").select(*BRIDGED).distinct(), BRIDGED, "left_anti")
