"""Exact deduplication with skew-safe combining (DataFrame functions only)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
SALTS = 8
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def mark(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) with the row that stands for its group of equal texts.

    Texts are equal when identical without blanks. The row with the most code points in its original text stays, then
    the one with the smallest doc_id. ``columns`` of ``docs`` (all by default) are kept beside ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256``; columns of ``docs`` with these names are replaced.

    Combining: every task first merges its own equal texts, salted groups are merged next, and the winners of the
    salts last. The grouping keys hold the whole text, so a shared digest never joins different texts. A group of any
    size arrives as one row per task and salt. Rows meet their group over (hash of the text, salt).

    A null text counts as empty. A null doc_id loses against every other; rows that share doc_id and length are told
    apart by a hash of the text, and of fully equal rows one stays. No rows in, no rows out.
    """
    keep = [c for c in (columns or docs.columns) if c not in RESULT]
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, BLANKS, "")
    rows = docs.select(
        F.col("doc_id").alias("__id"), bare.alias("__bare"), F.char_length(text).alias("__points"),
        F.xxhash64(bare).alias("__digest"), (F.spark_partition_id() % SALTS).alias("__salt"))
    salted = rows.groupBy("__digest", "__salt", "__bare", "__points").agg(
        F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__n"))
    groups = salted.groupBy("__digest", "__bare").agg(
        F.max(F.struct("__points", F.bitwise_not("__id").alias("__not_id"))).alias("__best"), F.sum("__n").alias("group_size"))
    groups = groups.select(
        F.sha2("__bare", 256).alias("__sha"), F.bitwise_not("__best.__not_id").alias("keep_id"),
        F.col("__best.__points").alias("__most"), "group_size",
        F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("__part"))
    members = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col("doc_id").alias("__id"), F.sha2(bare, 256).alias("__sha"),
        F.char_length(text).alias("__points"), F.xxhash64(text).alias("__text_hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("__part"))
    same_id = Window.partitionBy("__sha", "__part", "__id").orderBy(F.desc("__points"), "__text_hash")
    return members.join(groups, ["__sha", "__part"]).withColumn("__nth", F.row_number().over(same_id)).select(
        *[F.col(f"`{c}`") for c in keep], "keep_id", "group_size",
        ((F.col("__points") == F.col("__most")) & F.col("__id").eqNullSafe(F.col("keep_id"))
         & (F.col("__nth") == 1)).alias("kept"),
        F.col("__sha").alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return mark(docs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULT])
