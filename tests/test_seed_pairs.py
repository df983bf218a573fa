from readloom import catalog


def test_every_read_with_the_next(spark, tmp_path):
    seqs = {i: f"{'ACGT'[i % 4] * 3}GATTACAGATTACCA{'TGCA'[i % 3] * i}" for i in range(9)} | {20: "ACGTACGTACGTACGT"}
    spark.createDataFrame(list(seqs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.aread, r.bread, r.apos, r.bpos, r.diagonal) for r in catalog.kmer_seeds_all(spark, str(tmp_path)).collect())
    want = [(a, a + 1, i, j, i - j) for a in seqs if a + 1 in seqs for i in range(len(seqs[a]) - 13) for j in range(len(seqs[a + 1]) - 13) if seqs[a][i : i + 14] == seqs[a + 1][j : j + 14]]
    assert got == sorted(want) and {a for a, *_ in got} == set(range(8))


def test_seeds_like_brute_force(spark):
    """Letters in either case and N are told apart, other letters are in no seed, and reads span several stretches."""
    import random

    from readloom.operators import joins

    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(700))
    seqs = {1: base, 2: base[300:] + base[:290].lower() + "N" * 25, 3: base[:100] + "R" + base[100:256] + "nN" * 12, 4: "ACG", 5: "", 6: None, 7: "N" * 40 + base[5:300].lower()}
    reads = spark.createDataFrame(list(seqs.items()), "read_id long, seq string")
    asked = [(1, 2), (1, 2), (2, 7), (1, 3), (3, 3), (4, 1), (5, 6), (8, 1), (3, 2)]
    pairs = spark.createDataFrame(asked, "aread long, bread long")
    for k in (5, 14, 18, 19):
        want = set()
        for a, b in set(asked):
            x, y = seqs.get(a) or "", seqs.get(b) or ""
            at = {}
            for j in range(len(y) - k + 1):
                at.setdefault(y[j : j + k], []).append(j)
            want |= {(a, b, i, j, i - j) for i in range(len(x) - k + 1) for j in at.get(x[i : i + k], []) if "R" not in x[i : i + k]}
        got = [tuple(r) for r in joins.seeds(reads, pairs, k).collect()]
        assert set(got) == want and len(got) == len(want) > 0
