import pytest


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with extra columns of awkward names."""
    def make(rows, parts=2, extra=True):
        full = [(*r, None)[:3] for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string")
        if extra:
            for name in ("source", "kept", "n_words", "spans", "score", "keep_id", "items", "n_lines", "secrets", "edits.x"):
                from pyspark.sql import functions as F
                df = df.withColumn(name, F.lit("x"))
        return df.repartition(parts)
    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
