from pyspark.sql import functions as F

import corpus_pipeline as P
from readloom.plans import components, store


def test_stages(spark, make_docs, tmp_path):
    toxic = [(i, f"some text number {i} with an idiotic moron in it", "a") for i in range(0, 40)]
    clean = [(100 + i, " ".join(f"w{(i * 7 + k) % 211}" for k in range(30)) + ".", "b" if i % 2 else "a") for i in range(120)]
    rows = [*toxic, *clean, (500, None, "a"), (501, "", "b"), (502, clean[3][1], "b")]
    docs = make_docs(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 1) for i, *_ in toxic] + [(i, 1, 0) for i, *_ in clean], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scratch = store.Scratch(spark, "test")
    for k, (name, stage) in enumerate(P.STAGES):
        frame = scratch.cut(stage(spark, frame, str(tmp_path)), name)
        if k < len(P.STAGES) - 1:
            assert frame.columns == P.COLUMNS
        if name == "toxicity":
            left = {r.doc_id for r in frame.collect()}
            assert not left & {i for i, *_ in toxic} and {i for i, *_ in clean} <= left
        if name == "simhash":
            ids = {r.doc_id for r in frame.collect()}
            assert 502 not in ids and 103 in ids
    assert frame.count() and P.run(spark, str(tmp_path)).columns == frame.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components.connected_components(df, store.Scratch(spark, "cc")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {199: 199, 200: 199}
    assert got == want
    none = components.connected_components(df.where(F.lit(False)), store.Scratch(spark, "cc"))
    assert none.collect() == []


def test_empty_and_repeated_rows(spark, make_docs, tmp_path):
    """Empty tables give no rows; texts under one doc_id are documents of their own, repeated rows are one."""
    base = [" ".join(f"{x}{i}" for i in range(60)) + "." for x in "abc"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("some", [(1, base[0]), (5, base[0]), (5, base[1]), (5, base[1]), (None, base[2]), (None, None)])):
        make_docs(rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = P.run(spark, f"{tmp_path}/{name}").collect()
        # Without labels nothing is toxic at a score under 0.5, and 0.5 itself goes.
        assert {r.doc_id for r in got} <= {1, 5, None} and (rows or not got)
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    assert sorted((str(r.doc_id), r.text or "") for r in P.dedup_stage(spark, docs, "").collect()) == [("1", base[0]), ("5", base[1]), ("None", ""), ("None", base[2])]
