"""Removal of repeated lines by overlapping three-line windows (DataFrame functions only)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8
RESULT = ("kept_text", "n_lines", "n_removed", "n_spans")


def remove_repeats(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the text that is left when later copies of ``width`` lines in a row are removed.

    Lines are split at newlines. Each window of ``width`` consecutive lines is hashed to 128 bits. A window is later if
    an equal one comes earlier in order of (doc_id, hash of the text, line); every line inside a later window is
    removed, judged on the input. Adds ``kept_text``, ``n_lines``, ``n_removed`` and ``n_spans`` (runs of removed
    lines); columns with these names are replaced.

    A null text counts as empty (one empty line); shorter documents have no window and stay whole. A null doc_id comes
    after all others. Rows with equal doc_id and text are one document: they lose the same lines and none to each
    other. No rows in, no rows out.

    First occurrences are found by a two-step aggregate, so a window shared by any number of documents is one row per
    task; members meet their first occurrence over a salted key.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in RESULT]
    base = docs.select(
        *keep, F.col("doc_id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"),
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("__lines"))
    windows = base.where(F.size("__lines") >= width).select(
        "__id", "__hash", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.size("__lines") - width),
            lambda i: F.slice("__lines", i + 1, width))).alias("__at", "__window"))
    windows = windows.select(
        F.xxhash64("__window").alias("__k1"), F.xxhash64(F.lit(width), "__window").alias("__k2"),
        F.struct(F.isnull("__id").alias("none"), F.col("__id").alias("id"), F.col("__hash").alias("hash"),
                 F.col("__at").alias("at")).alias("__place"),
        F.pmod(F.xxhash64("__id", "__at"), F.lit(SALTS)).cast("int").alias("__salt"))
    firsts = windows.groupBy("__k1", "__k2", "__salt").agg(
        F.min("__place").alias("__first"), F.max("__place").alias("__last")).groupBy("__k1", "__k2").agg(
        F.min("__first").alias("__first"), F.max("__last").alias("__last")).where("__first < __last")
    firsts = firsts.select("__k1", "__k2", "__first",
                           F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("__salt"))
    later = windows.join(firsts, ["__k1", "__k2", "__salt"]).where("__place > __first").groupBy(
        F.col("__place.id").alias("__later_id"), F.col("__place.hash").alias("__later_hash")).agg(
        F.collect_set("__place.at").alias("__starts"))
    covered = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (width - 1)))))
    marked = base.join(later, F.col("__id").eqNullSafe(F.col("__later_id"))
                       & (F.col("__hash") == F.col("__later_hash")), "left").withColumn(
        "__covered", F.when(F.col("__starts").isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(covered)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__covered")
    runs = F.size("__covered") - F.size(F.array_intersect("__covered", F.transform("__covered", lambda i: i + 1)))
    return marked.select(
        *keep,
        F.when(F.size("__covered") == 0, F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")).alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"), F.size("__covered").cast("long").alias("n_removed"),
        runs.cast("long").alias("n_spans"))
