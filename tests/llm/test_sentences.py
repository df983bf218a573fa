from collections import defaultdict

from readloom.llm import sentences as S

A = "one two three four five six. seven eight nine ten eleven twelve! "


def brute(rows, run=S.RUN, least=S.MIN_WORDS):
    import re

    at = defaultdict(list)
    parts = {}
    for n, (d, t) in enumerate(rows):
        p = parts[n] = re.findall(S.SENTENCE, t or "")
        plain = [" ".join(x.lower().rstrip(" .!?\t\n\v\f\r").split()) for x in p]
        for i in range(max(len(p) - run, 0) + 1 if p else 0):
            span = plain[i : i + run]
            if sum(max(1, len(x.split())) for x in span) >= least:
                at["\n".join(span)].append(((d is None, d or 0, i), n, i))
    gone = defaultdict(set)
    for v in at.values():
        first = min(v)[0]
        for k, n, i in v:
            if k != first:
                gone[n].update(range(i, min(i + run, len(parts[n]))))
    return sorted(((d is None, d or 0), None if t is None else "".join(x for i, x in enumerate(parts[n]) if i not in gone[n]), len(gone[n])) for n, (d, t) in enumerate(rows))


def test_like_brute_force(spark, make_docs):
    rows = [(1, "Intro here. " + A + "Tail."), (2, A.upper() + "other end"), (3, "  " + A.replace(" ", "  ")), (4, None), (5, ""), (6, "?! ... \n\n"), (None, A), (7, A + A)]
    rows += [(8, "short. short. short."), (9, "alone " * 20), (10, "alone " * 20), (11, "zig zag. " * 20_000), (12, "z" * 200_000)]
    got = S.remove_repeats(make_docs(rows))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text, r.n_removed) for r in got.collect()) == brute(rows)
    assert got.columns == [*make_docs(rows).columns, "n_sentences", "n_removed"]


def test_repeated_rows_and_empty(spark, make_docs):
    got = S.remove_repeats(make_docs([(1, A), (1, A)])).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert S.remove_repeats(make_docs([])).collect() == []
