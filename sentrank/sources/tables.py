"""Typed scans of the tables that stages hand to each other."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.numbers import to_level
from ..functions.times import parse_any_time


def _project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The named columns, or everything if one of them is missing."""
    if columns is None or any(c not in df.columns for c in columns):
        return df
    return df.select(*[F.col(f"`{c}`") for c in columns])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return _project(spark.read.parquet(path), columns)


def read_csv_typed(
    spark: SparkSession, path: str, columns: list[str] | None = None, doubles: tuple[str, ...] = ()
) -> DataFrame:
    """CSV of clean or scored alerts: time and level coerced, ``doubles`` as DOUBLE, rest text."""
    df = _project(
        spark.read.option("header", "true").option("inferSchema", "false")
        .option("escape", '"').csv(path),
        columns,
    )
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name == "timestamp":
            c = parse_any_time(c)
        elif name == "rule_level":
            c = to_level(c)
        elif name in doubles:
            c = c.try_cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of engineered alerts with every numeric feature typed."""
    numeric = tuple(
        f.name for f in schema.FEATURE_TABLE.fields
        if isinstance(f.dataType, (T.DoubleType, T.IntegerType)) and f.name != "rule_level"
    )
    return read_csv_typed(spark, path, doubles=(*numeric, "anomaly_score", "score"))


def read_stats(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Frozen statistics: host_stats, combo_freq, globals."""
    base = path.rstrip("/")
    return {
        "host_stats": spark.read.schema(schema.HOST_STATS).parquet(f"{base}/host_stats"),
        "combo_freq": spark.read.schema(schema.COMBO_FREQ).parquet(f"{base}/combo_freq"),
        "globals": spark.read.schema(schema.GLOBALS).parquet(f"{base}/globals"),
    }
