"""Scans of raw CSV exports whose columns differ from file to file.

One job reads every file's first line and looks for quoted line breaks; files are
grouped by header as a table, each group is one Spark read with its own schema, and
the groups are united by name. Long lines are dropped and short lines null-padded:
every read has one spare column, and a line with more separators than columns has its
fields counted outside quotes.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NA_TOKENS

_SPARE, _MALFORMED = "_extra", "_malformed"


def find_files(spark: SparkSession, folder: str, pattern: str = "*.csv*") -> list[str]:
    """Sorted files of one folder that match ``pattern`` (also ``.csv.gz``)."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "false").load(folder).select("path")
    )
    files = sorted(r["path"] for r in listing.collect())
    if not files:
        raise FileNotFoundError(f"no file in {folder!r} matches {pattern!r}")
    return files


def _reader(spark: SparkSession, multi_line: bool = False):
    return (
        spark.read.option("header", "true").option("inferSchema", "false")
        .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
        .option("multiLine", str(multi_line).lower()).option("encoding", "UTF-8")
        .option("columnNameOfCorruptRecord", _MALFORMED).option("columnPruning", "false")
    )


def file_facts(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, header, broken): first line of every file, and whether a quoted field runs over a line end.

    One distributed pass over the text; a line end inside quotes leaves an odd number of quotes on a line. The first
    line is the first row of the file's first split, whose rows are numbered in order.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("file"), (quotes % 2 == 1).alias("odd"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("nth"))
    return lines.groupBy("file").agg(F.min_by("value", "nth").alias("header"), F.max("odd").alias("broken"))


def _names(spark: SparkSession, header: str) -> tuple[str, ...]:
    """Column names of a header line, as the reader makes them."""
    return tuple(_reader(spark).csv(spark.sparkContext.parallelize([header], 1)).columns)


def scan_group(spark: SparkSession, files: list[str], names: tuple[str, ...], multi_line: bool) -> DataFrame:
    """All-text scan of files that share one header."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _SPARE, _MALFORMED)])
    line = F.col(_MALFORMED)

    def commas(text):
        return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))

    # Only a line with more separators than the schema has is looked at without its quoted parts.
    fits = (commas(line) < len(names)) | (commas(F.regexp_replace(line, '"[^"]*"', "")) < len(names))
    rows = _reader(spark, multi_line).schema(schema).csv(files).filter(F.col(_SPARE).isNull() & line.isNotNull() & fits)
    cells = [
        F.when(~F.col(f"`{n}`").isin(NA_TOKENS), F.col(f"`{n}`")).alias(n) for n in names
    ]
    return rows.select(*cells)


def scan_groups(
    spark: SparkSession, files: list[str], multi_line: bool | str = "auto"
) -> list[DataFrame]:
    """One frame per distinct header (and per line-break need).

    ``multi_line="auto"`` reads only files with quoted line ends unsplit. The driver
    gets one row per group, with the files to read.
    """
    facts = file_facts(spark, files)
    broken = F.col("broken") if multi_line == "auto" else F.lit(bool(multi_line))
    groups = facts.groupBy("header", broken.alias("broken")).agg(
        F.sort_array(F.collect_list("file")).alias("files")).orderBy(F.col("files")[0]).collect()
    empty = set(files) - {f for g in groups for f in g["files"]}        # files without a line have no columns
    if not groups:
        raise ValueError(f"no header in {sorted(empty)[:3]}")
    merged: dict[tuple, list[str]] = {}
    for g in groups:
        merged.setdefault((_names(spark, g["header"]), g["broken"]), []).extend(g["files"])
    return [scan_group(spark, fs, names, ml) for (names, ml), fs in merged.items()]


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union over differing columns: missing cells NULL, columns in name order."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*[F.col(f"`{c}`") for c in sorted(merged.columns)])


def scan_union(spark: SparkSession, files: list[str], multi_line: bool | str = "auto") -> DataFrame:
    return union_by_name(scan_groups(spark, files, multi_line))
