import random

from readloom.llm import langid

WORDS = {"de": ["der", "und", "nicht", "schön", "straße"], "fr": ["été", "les", "avec", "château", "où"], "en": ["the", "and", "with", "house", "where"]}


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(4, 40))), "s", lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy(spark, make_docs):
    profiles = langid.train(make_docs([*rows(300, 1), (1, None, "s", "en"), (2, "x", "s", None)]))
    test = rows(200, 2)
    got = {r.doc_id: r for r in langid.predict(make_docs(test), profiles).collect()}
    assert sum(got[i].lang_pred == lang for i, _, _, lang in test) / len(test) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, make_docs):
    p = langid.train(make_docs(rows(50, 3)))
    odd = make_docs([(1, None), (2, ""), (3, "12 .,! 5"), (4, "a"), (None, "the " * 50_000), (4, "a")])
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict(odd, p).collect()))
    assert got[1:4] == [(1, "und"), (2, "und"), (3, "und")] and got[0] == (0, "en") and got[4] == got[5] != (4, "und")
    assert langid.predict(make_docs([]), p).collect() == []
    none = langid.train(make_docs([]))
    assert [r.lang_pred for r in langid.predict(make_docs([(1, "the")]), none).collect()] == ["und"]


def test_languages_in_groups_and_text_in_parts(spark, make_docs, monkeypatch):
    docs, test = make_docs(rows(200, 4)), make_docs([*rows(60, 5), (900, ""), (901, None)])
    want = sorted(map(tuple, langid.predict(test, langid.train(docs)).collect()))
    for n in (1, 2):
        monkeypatch.setattr(langid, "LANGS", n)
        groups = langid.train(docs)
        assert len(groups) == -(-3 // n)
        assert sorted(map(tuple, langid.predict(test, groups).collect())) == want
    text = " ".join(t for _, t, *_ in rows(40, 6))
    whole = [x.tolist() for x in langid.ngrams(text)]
    for n in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "PART", n)
        assert [x.tolist() for x in langid.ngrams(text)] == whole


def test_ngrams():
    grams, n = langid.ngrams("Ab b")
    text = {"".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)).lstrip("\0"): int(c) for g, c in zip(grams, n)}
    assert text == {"a": 1, "b": 2, " a": 1, "ab": 1, "b ": 2, " b": 1, " ab": 1, "ab ": 1, " b ": 1}
