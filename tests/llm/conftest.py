import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]), with a column more whose name operators use themselves."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "key", "n", "u", "v", "gone", "pos", "ids", "text_id", "score", "rank", "block"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
