"""Overlap tables to SAM records and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar as cg
from readloom.functions.scalar import revcomp
from readloom.functions.trace import b_length
from readloom.operators import joins, kernels, order

#: SAM flags of a reversed read and of the roles that a record can have.
REVERSED, SECONDARY, SUPPLEMENTARY, UNMAPPED = 16, 256, 2048, 4


def flag(role: str = "role", inverse: str = "is_inverse"):
    f = F.when(F.col(role) == "secondary", SECONDARY).when(F.col(role) == "supplementary", SUPPLEMENTARY).otherwise(0)
    return (f + F.when(F.col(inverse), REVERSED).otherwise(0)).cast("int")


def to_sam(ovl: DataFrame, a_names: DataFrame, b_names: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """SAM records of overlaps: A is the reference, B the read (names: read_id, name).

    Rows are numbered in chains per B read in the order ``by``; or, with ``top``, the best so many of each read are records
    of one link each. Tags: ci and cn, number of the chain and of chains; cj and cl, number of the link and of links. With
    a column ``cigar`` (see ``kernels.align_spans``) the clips of B are put around it; else it is ``*``.
    """
    if top is None:
        rows = order.chain_numbers(ovl, by)
    else:
        rows = order.best(ovl, top, by)
        n = F.count("*").over(order.Window.partitionBy("bread"))
        rows = rows.withColumns({"chain_id": (F.col("place") - 1).cast("long"), "n_chains": n, "chain_link": F.lit(0).cast("long"), "n_links": F.lit(1).cast("long")})
    named = rows.join(a_names.select(F.col("read_id").alias("aread"), F.col("name").alias("rname")), "aread")
    named = named.join(b_names.select(F.col("read_id").alias("bread"), F.col("name").alias("qname")), "bread")
    text = F.lit("*")
    if "cigar" in ovl.columns:
        text = clipped(F.col("cigar"))
    tags = F.array(*(F.concat(F.lit(f"{t}:i:"), F.col(c).cast("string")) for t, c in (("ci", "chain_id"), ("cn", "n_chains"), ("cj", "chain_link"), ("cl", "n_links"))))
    return named.select(
        *ovl.columns, "qname", flag().alias("flag"), "rname", (F.col("abpos") + 1).alias("pos"), F.lit(255).alias("mapq"),
        text.alias("sam_cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), tags.alias("tags"),
    )


def from_sam(sam: DataFrame, refs: DataFrame, reads: DataFrame, strict: bool = False) -> DataFrame:
    """Overlaps of mapped SAM records: reference and read by name (refs, reads: read_id, name, rlen), spans from position
    and CIGAR. Operations other than I, D, =, X, M and clips are an error; M needs the bases when the trace is made.
    With ``strict`` M is an error too."""
    from readloom.operators.filters import cigar_valid, mapped

    good = mapped(sam).withColumn("cigar", F.when(cigar_valid(F.col("cigar"), allow_m=not strict), F.col("cigar")).otherwise(F.raise_error(F.concat(F.lit("unsupported CIGAR "), F.col("cigar"))).cast("string")))
    n = cg.lengths(F.col("cigar"))
    rows = good.join(refs.select(F.col("name").alias("rname"), F.col("read_id").alias("aread"), F.col("rlen").alias("alen")), "rname")
    rows = rows.join(reads.select(F.col("name").alias("qname"), F.col("read_id").alias("bread"), F.col("rlen").alias("blen")), "qname")
    begin = F.col("pos") - 1 - n["front_del"]  # deletions before the first base lie before its place
    return rows.select(
        "aread", "bread", (F.col("flag").bitwiseAND(F.lit(REVERSED)) != 0).alias("is_inverse"), begin.alias("abpos"), (begin + n["ref_length"]).alias("aepos"),
        n["front_clip"].alias("bbpos"), (n["front_clip"] + cg.length(F.col("cigar"), "M=XI")).alias("bepos"), n["errors"].alias("diffs"), "alen", "blen", "cigar",
    )


SPAN = kernels.SPAN


def sam_overlaps(sam: DataFrame, refs: DataFrame, reads: DataFrame, ts: int = 100) -> DataFrame:
    """``from_sam`` with traces: SPAN, alen, blen, diffs and trace (refs, reads: read_id, name, rlen, seq). Tiles are cut from the
    runs of the CIGAR string, M told apart by the bases. An error if a CIGAR string, clips included, isn't of its read's
    length, or leaves the reference."""
    rows = from_sam(sam, refs, reads)
    whole = F.col("bepos") + cg.lengths(F.col("cigar"))["back_clip"] == F.col("blen")
    inside = (F.col("abpos") >= 0) & (F.col("aepos") <= F.col("alen"))
    wrong = F.when(~whole, "a CIGAR string isn't of its read's length").when(~inside, "an alignment leaves its reference")
    rows = rows.withColumn("cigar", F.when(wrong.isNull(), F.col("cigar")).otherwise(F.raise_error(wrong).cast("string")))
    return traced(rows.drop("diffs"), refs, reads, [*SPAN, "alen", "blen"], ts)


def sam_records(ovl: DataFrame, refs: DataFrame, reads: DataFrame, by: list[str], strategy: str = "none", top: int | None = None, ts: int = 100) -> DataFrame:
    """Whole SAM records of overlaps with traces (refs, reads: read_id, name, rlen, seq; A is the reference): the columns of
    ``sam_text``, and ``by``.

    Scripts, NM, MD and AS come from one pass over the tiles. Chains are numbered, or the best ``top`` rows of a read taken,
    as by ``to_sam``; bases are stored by ``strategy``, see ``stored``. Rows are sent to their A read for its bases, and to their
    B read once for numbers, names and bases together.
    """
    known = [*dict.fromkeys([*by, *ovl.columns])]
    with_a = ovl.drop("alen", "blen").join(refs.select(F.col("read_id").alias("aread"), F.col("seq").alias("aseq")), "aread")
    with_b = with_a.join(reads.select(F.col("read_id").alias("bread"), F.col("rlen").alias("blen"), F.col("seq").alias("bseq")), "bread")
    with_b = with_b.withColumn("bseq", F.when(F.col("is_inverse"), revcomp(F.col("bseq"))).otherwise(F.col("bseq")))
    names = [*dict.fromkeys([*(c for c in known if c not in ("trace", "alen", "blen")), "blen"])]
    told = kernels.scripts(with_b, names, ts)
    sam = to_sam(told, refs.select("read_id", "name"), reads.select("read_id", "name"), by, top)
    full = stored(sam, reads, strategy)
    more = F.array(F.concat(F.lit("NM:i:"), F.col("nm").cast("string")), F.concat(F.lit("MD:Z:"), "md"), F.concat(F.lit("AS:i:"), F.col("as").cast("string")))
    fields = ["qname", "flag", "rname", "pos", "mapq", F.col("sam_cigar").alias("cigar"), "rnext", "pnext", "tlen", "seq", F.lit("*").alias("qual"), F.concat("tags", more).alias("tags")]
    return full.select(*by, *fields)


def traced(rows: DataFrame, refs: DataFrame, reads: DataFrame, keep: list[str], ts: int = 100, correct: bool = False) -> DataFrame:
    """``keep`` of rows (SPAN, cigar or null), with diffs and trace (refs, reads: read_id, seq).

    A CIGAR string gives the trace, M told apart by the bases; a row without one is aligned between its ends or, with
    ``correct``, extended from an anchor in its span, which may move both ends. A trace whose length on B isn't that of the
    B span is an error.
    """
    full = joins.with_sequences(rows, refs, reads)
    names = list(dict.fromkeys([*SPAN, *keep]))
    both = kernels.traced_spans(full, names, ts, correct=correct)
    fits = b_length(F.col("trace")) == F.col("bepos") - F.col("bbpos")
    checked = F.when(fits, F.col("trace")).otherwise(F.raise_error(F.lit("the trace leaves its B span")).cast(both.schema["trace"].dataType))
    return both.withColumn("trace", checked).select(*keep, "diffs", "trace")


def from_paf(rows: DataFrame, refs: DataFrame, reads: DataFrame, keep: list[str] = (), ts: int = 100, correct: bool = False) -> DataFrame:
    """Overlaps of PAF rows (see ``text.paf_overlaps``): target and query by name (refs, reads: read_id, name, rlen, seq),
    lengths checked against theirs, traces as by ``traced``, with ``correct`` those without a CIGAR string corrected. Rows whose names are unknown, or belong to several, go."""
    named = joins.by_name(rows, refs, "aname", "aread")[0]
    named = joins.by_name(named, reads, "bname", "bread")[0]
    sizes = joins.with_lengths(named.withColumnsRenamed({"alen": "a_said", "blen": "b_said"}), refs, reads)
    right = (F.col("alen") == F.col("a_said")) & (F.col("blen") == F.col("b_said"))
    checked = sizes.withColumn("alen", F.when(right, F.col("alen")).otherwise(F.raise_error(F.lit("a stated length isn't the read's")).cast("long")))
    names = list(dict.fromkeys([*SPAN, "alen", "blen", *keep]))
    return traced(checked.select(*names, "cigar"), refs, reads, names, ts, correct)


def m4_to_sam(rows: DataFrame, refs: DataFrame, reads: DataFrame, by: list[str]) -> DataFrame:
    """SAM records of m4 rows (see ``text.m4``) with the target as reference: reads by name or, if that is unknown, by its
    stem; the spans are aligned from end to end, reads are clipped softly, and deletions at the front move the position.
    Rows behind one of the same name, in the order ``by``, are secondary."""
    named = joins.by_name_or_stem(rows, reads.select("read_id", "name"), "qname", "bread")
    named = joins.by_name(named, refs.select("read_id", "name"), "tname", "aread")[0]
    spans = named.select(*by, "qname", "tname", "aread", "bread", (F.col("qstrand") == 1).alias("is_inverse"), F.col("tstart").alias("abpos"), F.col("tend").alias("aepos"), F.col("qstart").alias("bbpos"), F.col("qend").alias("bepos"))
    spans = order.secondary_names(spans, "qname", by, ["bread"])
    names = [*spans.columns, "blen", "bseq"]
    full = joins.with_sequences(spans, refs, reads).withColumn("blen", F.length("bseq").cast("long"))
    aligned = kernels.align_spans(full, names).withColumn("clipped", clipped(F.col("cigar")))
    text = cg.shifted(F.col("clipped"), F.col("abpos") + 1)
    flags = F.when(F.col("is_secondary"), SECONDARY).otherwise(0) + F.when(F.col("is_inverse"), REVERSED).otherwise(0)
    return aligned.select(*by, "qname", flags.cast("int").alias("flag"), F.col("tname").alias("rname"), text["pos"].cast("long").alias("pos"), F.lit(0).alias("mapq"), text["cigar"].alias("cigar"), F.col("bseq").alias("seq"))


def clipped(cigar, kind: str = "S"):
    """A CIGAR string between the clips of B (columns bbpos, bepos, blen)."""

    def clip(n):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(kind))).otherwise("")

    return F.concat(clip(F.col("bbpos")), cigar, clip(F.col("blen") - F.col("bepos")))


def stored(sam: DataFrame, reads: DataFrame, strategy: str = "none") -> DataFrame:
    """``sam`` (with bread, bbpos, bepos, blen and cigar, see ``to_sam``) with seq, and sam_cigar clipped to fit. Primary
    records hold their read; of the others ``none`` hold no bases, with ``soft`` the read, with ``hard`` the part aligned."""
    if strategy not in ("none", "soft", "hard"):
        raise ValueError("strategy must be none, soft or hard")
    full = sam.join(reads.select(F.col("read_id").alias("bread"), F.col("seq").alias("_seq")), "bread")
    turned = F.when(F.col("flag").bitwiseAND(F.lit(REVERSED)) != 0, revcomp(F.col("_seq"))).otherwise(F.col("_seq"))
    main = F.col("flag").bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0
    part = F.substring(turned, (F.col("bbpos") + 1).cast("int"), (F.col("bepos") - F.col("bbpos")).cast("int"))
    other = {"none": F.lit("*"), "soft": turned, "hard": part}[strategy]
    hard = ~main if strategy == "hard" else F.lit(False)
    text = F.when(hard, clipped(F.col("cigar"), "H")).otherwise(clipped(F.col("cigar")))
    return full.withColumns({"seq": F.when(main, turned).otherwise(other), "sam_cigar": text}).drop("_seq")
