from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline as P
from readloom.llm import registry
from readloom.llm import sentences as S

DIR = "/root/testdata/sf0.001"
LONG = "one " + " ".join(f"w{i}" for i in range(58)) + " end. "


def brute(rows):
    import re

    at, parts = defaultdict(list), {}
    for d, t in rows:
        p = parts[d] = re.findall(S.SENTENCE, t or "")
        plain = [" ".join(x.lower().rstrip(" .!?\t\n\v\f\r").split()) for x in p]
        both = {(i, min(S.RUN, len(p)), S.MIN_WORDS) for i in range(max(len(p) - S.RUN, 0) + 1) if p}
        both |= {(i, 1, S.ALONE) for i in range(len(p)) if len(p) > 1}
        for i, n, least in both:
            if sum(max(1, len(x.split())) for x in plain[i : i + n]) >= least:
                at["\n".join(plain[i : i + n])].append((d, i, n))
    gone = defaultdict(set)
    for v in at.values():
        for d, i, n in sorted(v)[1:]:
            gone[d].update(range(i, i + n))
    return {d: "".join(x for i, x in enumerate(parts[d]) if i not in gone[d]) for d, _ in rows}


def test_long_sentence_between_others(spark, make_docs):
    rows = [(1, "Front a. " + LONG + "Back a."), (2, "Front b. " + LONG.upper() + "Back b."), (3, LONG), (4, "x. " + LONG + "y. " + LONG + "z."), (5, "Front c. short one. Back c."), (6, "Front d. short one. Back d.")]
    got = {r.doc_id: r.text for r in S.remove_repeats(make_docs(rows), alone=S.ALONE).collect()}
    assert got == brute(rows)
    assert [d for d, t in got.items() if "w57" in t.lower()] == [1] and got[5] == rows[4][1]
    staged = {r.doc_id: r.text for r in P.sentence_stage(spark, make_docs(rows), "").collect()}
    assert staged == {d: t for d, t in got.items() if t.strip()}


@pytest.mark.parametrize("name", ["op7_passages", "op7_sentences"])
def test_like_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = registry.queries()[name](spark, DIR).select("doc_id", "n_sentences", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(registry.oracle_sql()[name]).fetchall())
