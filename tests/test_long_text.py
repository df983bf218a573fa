"""Text beyond 1 MiB in one field."""

from readloom import catalog
from readloom.sources import text

MIB = 1 << 20


def test_long_cigar_and_header(spark):
    cigar = "12=1X" * 300_000
    lines = spark.createDataFrame([(0, "q\t10\t1\t5\t+\tt\t20\t2\t6\t4\t4\t60\tNM:i:1\tcg:Z:" + cigar), (1, "q\t10\t1\t5\t+\tt\t20\t2\t6\t4\t4\t60")], "line_no long, value string")
    assert {r.line_no: r.cigar for r in text.paf(lines).collect()} == {0: cigar, 1: None}
    head = "@r " + "c" * (MIB + 5) + "end"
    fq = spark.createDataFrame(list(enumerate([head, "ACGT", "+", "HHHH"])), "line_no long, value string")
    (got,) = text.fastq(fq).collect()
    assert (got.name, got.comment, got.seq) == ("r", head[3:], "ACGT")


def test_long_fasta_record(spark, tmp_path):
    seq = "ACGGT" * 420_000
    spark.createDataFrame([(1, seq), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r for r in catalog.fasta_parse(spark, str(tmp_path)).collect()}
    assert got["r1"].seq == seq and got["r1"].comment == f"len {len(seq)}" and got["r2"].seq == ""
