"""Queries of the numbered operators over the driver's tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import codes, dualtree, forest, langid, mixing, packing, quality, runlength, sentences, simhash, sstable, toxicity, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op2_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), codes.sign_code(F.col("embedding")).alias("code"))
    found = codes.top_k(table, F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP2_SQL = """
WITH bits AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
codes AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_aggregate(list_transform(b, lambda x, i: CASE WHEN x THEN (1::HUGEINT << (i - 1)::INTEGER) ELSE 0::HUGEINT END), 'sum') AS code FROM bits),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code::HUGEINT, c.code::HUGEINT)) AS INTEGER) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code::HUGEINT, c.code::HUGEINT)), c.vec_id) AS rank
  FROM codes q JOIN codes c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def remainder(doc_id: str, n: int):
    """crc32 of the doc_id as text, modulo ``n``: what holds rows out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


TOXIC_FOLDS = 5


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labels.where(remainder("doc_id", TOXIC_FOLDS) != 0))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", TOXIC_FOLDS) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


END_ID = 2


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, path = sstable.write_new(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END_ID)
    rows = sstable.read(manifest, path, with_ids=False).drop("ids")
    return sstable.with_start(rows, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


MAX_EPOCHS = 1.25


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, max_epochs=MAX_EPOCHS)
    return mixed.select("doc_id", "source", "mix_epoch", F.round("mix_weight", 9).alias("mix_weight"), F.round("mix_place", 12).alias("mix_place"))


OP5_SQL = f"""
WITH RECURSIVE slim AS MATERIALIZED (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS doc, coalesce('=' || source, '') AS k,
         CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '')), 0) AS BIGINT) AS n
  FROM documents),
stats AS MATERIALIZED (SELECT k, CAST(sum(n) AS BIGINT) AS tokens FROM slim GROUP BY k HAVING sum(n) > 0),
shares AS MATERIALIZED (SELECT list(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM stats) ORDER BY k) AS p FROM stats),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN even THEN mid ELSE lo END, CASE WHEN even THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) > {MAX_EPOCHS} AS even
        FROM bisect, shares WHERE i < 40) b),
a AS (SELECT hi AS a FROM bisect WHERE i = 40),
z AS MATERIALIZED (SELECT k, tokens, pow(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM stats), (SELECT a FROM a)) AS w FROM stats),
q AS MATERIALIZED (
  SELECT k, tokens, w / (SELECT sum(w) FROM z) AS weight,
         CAST((SELECT sum(tokens) FROM stats) AS DOUBLE) * (w / (SELECT sum(w) FROM z)) AS quota FROM z),
plan AS MATERIALIZED (SELECT k, weight, CAST(floor(quota / tokens) AS BIGINT) AS whole, quota - floor(quota / tokens) * tokens AS rest FROM q),
placed AS (
  SELECT s.doc_id, s.doc, s.source, s.n, coalesce(p.weight, 0.0) AS weight, coalesce(p.whole, 0) AS whole, p.rest, s.k,
         CAST(('0x' || substr(md5('0:' || (coalesce(p.whole, 0) + 1) || ':' || s.doc), 1, 15)) AS BIGINT) AS u
  FROM slim s LEFT JOIN plan p ON p.k = s.k),
taken AS (
  SELECT *, CASE WHEN n = 0 THEN 1
                 ELSE whole + CAST(sum(n) OVER (PARTITION BY k ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS BIGINT) END AS copies
  FROM placed),
copied AS (SELECT doc_id, doc, source, weight, unnest(range(1, copies + 1)) AS mix_epoch FROM taken)
SELECT doc_id, source, CAST(mix_epoch AS BIGINT) AS mix_epoch, round(weight, 9) AS mix_weight,
       round(CAST(CAST(('0x' || substr(md5('0:' || mix_epoch || ':' || doc), 1, 15)) AS BIGINT) AS DOUBLE) / 1152921504606846976.0, 12) AS mix_place
FROM copied
"""


def op7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sentences.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH each AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{sentences.SENTENCE}') AS s FROM documents),
plain AS MATERIALIZED (
  SELECT doc_id, list_transform(s, lambda x: ltrim(regexp_replace(regexp_replace(lower(x), '[.!? \t-\r]+$', ''), '[ \t-\r]+', ' ', 'g'), ' ')) AS p
  FROM each WHERE len(s) > 0),
spans AS MATERIALIZED (
  SELECT doc_id, pos, array_to_string(p[pos + 1 : pos + {sentences.RUN}], chr(10)) AS span
  FROM (SELECT doc_id, p, unnest(range(0, greatest(len(p) - {sentences.RUN}, 0) + 1)) AS pos FROM plain)),
again AS (
  SELECT span, min((doc_id, pos)) AS first FROM spans
  WHERE length(span) - length(replace(replace(span, ' ', ''), chr(10), '')) + 1 >= {sentences.MIN_WORDS}
  GROUP BY span HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT s.doc_id, unnest(range(s.pos, s.pos + {sentences.RUN})) AS pos
  FROM spans s JOIN again a ON a.span = s.span WHERE (s.doc_id, s.pos) <> a.first),
cuts AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT e.doc_id, CAST(len(s) AS BIGINT) AS n_sentences,
       CAST(len(list_filter(coalesce(gone, []), lambda i: i < len(s))) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(s, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), '')) AS kept_sha256
FROM each e LEFT JOIN cuts c ON c.doc_id = e.doc_id
"""


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7_sentences, with each long sentence a span too."""
    kept = sentences.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), alone=sentences.ALONE)
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_PASSAGES_SQL = f"""
WITH each AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{sentences.SENTENCE}') AS s FROM documents),
plain AS MATERIALIZED (
  SELECT doc_id, list_transform(s, lambda x: ltrim(regexp_replace(regexp_replace(lower(x), '[.!? \t-\r]+$', ''), '[ \t-\r]+', ' ', 'g'), ' ')) AS p
  FROM each WHERE len(s) > 0),
spans AS MATERIALIZED (
  SELECT doc_id, pos, {sentences.RUN} AS width, {sentences.MIN_WORDS} AS least, array_to_string(p[pos + 1 : pos + {sentences.RUN}], chr(10)) AS span
  FROM (SELECT doc_id, p, unnest(range(0, greatest(len(p) - {sentences.RUN}, 0) + 1)) AS pos FROM plain)
  UNION ALL
  SELECT doc_id, pos, 1 AS width, {sentences.ALONE} AS least, p[pos + 1] AS span
  FROM (SELECT doc_id, p, unnest(range(0, len(p))) AS pos FROM plain WHERE len(p) > 1)),
counted AS MATERIALIZED (
  SELECT doc_id, pos, width, span FROM spans
  WHERE length(span) - length(replace(replace(span, ' ', ''), chr(10), '')) + 1 >= least),
again AS (SELECT span, min((doc_id, pos)) AS first FROM counted GROUP BY span HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT s.doc_id, unnest(range(s.pos, s.pos + s.width)) AS pos
  FROM counted s JOIN again a ON a.span = s.span WHERE (s.doc_id, s.pos) <> a.first),
cuts AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT e.doc_id, CAST(len(s) AS BIGINT) AS n_sentences,
       CAST(len(list_filter(coalesce(gone, []), lambda i: i < len(s))) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(s, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), '')) AS kept_sha256
FROM each e LEFT JOIN cuts c ON c.doc_id = e.doc_id
"""


LANG_FOLDS, LANG_HELD = 4, 2


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", LANG_FOLDS) == LANG_HELD, F.lit(False))
    found = langid.predict(docs, langid.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_runlength(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = runlength.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUALITY_FOLDS, QUALITY_HELD = 3, 1


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from the positives and the texts of rows that aren't held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.coalesce(remainder("doc_id", QUALITY_FOLDS) == QUALITY_HELD, F.lit(False))
    scored = quality.classify(docs, labels.where("quality = 1").select("doc_id"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the vectors of 64 components after ten rounds."""
    return dualtree.lloyd(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, x.v AS v, min((d, c)) AS best
  FROM (SELECT vec_id, k.v AS v, c.c AS c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k, c{r} c) x
  GROUP BY vec_id, x.v)""")
        if r < rounds:
            steps.append(f"""
s{r} AS MATERIALIZED (SELECT best[2] AS c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT best, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM a{r}) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.c AS c, coalesce(m.v, c.v) AS v FROM c{r} c
  LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s{r} GROUP BY c) m ON m.c = c.c)""")
    last = f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = best[2]"""
    return ",".join(steps) + last


OP12_SQL = _op12_sql()


def op13_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose vec_id is divisible by 50; where it is divisible by 7, the label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    table = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return vafile.hard_negatives(table, F.col("vec_id") % 50 == 0, positives=5, negatives=3, scale=256)


OP13_SQL = """
WITH r AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON len(b.v) = len(a.v) AND b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS MATERIALIZED (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_codes": op2_codes,
        "op3_toxicity": op3_toxicity,
        "op4_sstable": op4_sstable,
        "op5_mixing": op5_mixing,
        "op6_packing": op6_packing,
        "op7_sentences": op7_sentences,
        "op7_passages": op7_passages,
        "op8_langid": op8_langid,
        "op9_forest": op9_forest,
        "op10_runlength": op10_runlength,
        "op11_quality": op11_quality,
        "op12_dualtree": op12_dualtree,
        "op13_vafile": op13_vafile,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_codes": OP2_SQL, "op5_mixing": OP5_SQL, "op7_sentences": OP7_SQL, "op7_passages": OP7_PASSAGES_SQL, "op12_dualtree": OP12_SQL, "op13_vafile": OP13_SQL}
