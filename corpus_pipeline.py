"""A corpus cleaned, deduplicated, mixed and packed: one Parquet table between each stage and the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import mixing, packing, sentences, similar, toxicity
from readloom.llm.registry import END_ID, MAX_EPOCHS, tokenizer, toxicity_model
from readloom.plans.store import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model learns from the labelled rows of ``docs`` that aren't held out."""
    docs = docs.select(COLUMNS)
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.where(F.col("score") < 0.5).select(COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked by a 5-word Jaccard similarity of 0.8 or more, stays."""
    return similar.keep_one(docs.select(COLUMNS))


def sentence_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by spans that occur before are removed; a document of which nothing is left goes. n_chars is that
    of the new text."""
    cut = sentences.remove_repeats(docs.select(COLUMNS), alone=sentences.ALONE).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered weights; a document taken in two epochs is two rows."""
    return mixing.mix(docs.select(COLUMNS), max_epochs=MAX_EPOCHS).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    placed = packing.pack(docs.select(COLUMNS), tokenizer("word_bpe_49k.json"), END_ID)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", dedup_stage),
    ("sentences", sentence_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Factorization machines, fingerprints and tokenizers can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
