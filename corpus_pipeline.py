"""A corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Every stage takes a table with doc_id, text, lang and any further columns, whatever their names, and works on every row.
A null text is empty. An empty table gives an empty one.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrank.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from sentrank.llm.common import settle, table


def _filtered(docs: DataFrame, stay: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What stays of ``docs``; its further columns have names of their own meanwhile, which no operator replaces."""
    names = [c if c in ("doc_id", "text", "lang") else f"__column{i}" for i, c in enumerate(docs.columns)]
    return stay(docs.toDF(*names)).toDF(*docs.columns)


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Texts that are null, empty or without letters go; repeated rows and rows without doc_id are judged like any other.
    Where nothing can be learned from, every document goes.
    """
    return _filtered(docs, language_id.accept)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Null, empty and blank texts are equal. Rows that share a doc_id or have none are rows of their own; one stays.
    """
    return _filtered(docs, exact_dedup.deduplicate)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8).

    Texts without words are linked with nothing and stay. Rows with equal doc_id and text count as one document, and
    a document without doc_id comes last in its component.
    """
    return _filtered(docs, ngram_join.keep_first)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    A text without words stays; repeated rows share their fate. Without items all documents stay.
    """
    return _filtered(docs, lambda d: decontaminate.clean(d, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A document without tokens is one closing token; repeated rows and rows without doc_id are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", recognise),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_passages),
    ("packing", packed),
]
#: No stage but exact deduplication and decontamination can be written in SQL as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
