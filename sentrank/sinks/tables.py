"""Writers. Parquet is the format between stages; CSV is for people."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import json_record


def write_table(df: DataFrame, path: str, csv: bool = False, partition_by: list[str] | None = None) -> str:
    """Parquet at ``path``; with ``csv`` also a header CSV twin at ``path + "_csv"``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if csv:
        flat = df.sparkSession.read.parquet(path) if not partition_by else df
        flat.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}_csv")
    return path


def write_stats(stats: dict[str, DataFrame], path: str) -> str:
    for name, df in stats.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    return path


def write_splits(labelled_by_split: DataFrame, path: str) -> str:
    """One folder per split, so a reader of one window prunes the others."""
    labelled_by_split.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def write_json_records(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    df.select(json_record(df, columns).alias("value")).write.mode("overwrite").text(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """A small report frame as one JSON-lines file plus one Markdown file."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}_json")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    line = F.concat(F.lit("- "), F.array_join(F.filter(F.array(*cells), lambda c: c != ""), ": "))
    report.coalesce(1).select(line.alias("value")).write.mode("overwrite").text(f"{path}_md")
    return path


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    return df.limit(rows)
