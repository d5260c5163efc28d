"""Alert views derived from the ``events`` table.

``alerts`` is the canonical projection; ``raw_alerts`` has the shape of a raw
export: all text, dotted column names, sparse columns, export-format times.
The SQL twins live in ``plans/oracles.py``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import EXPORT_FORMAT

T1_END, T2_START, T2_END = "2024-01-20", "2024-01-21", "2024-01-25"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def alerts_from_events(events: DataFrame, light_hosts: bool = False) -> DataFrame:
    """Project events onto the six canonical alert columns.

    Five heavy hosts by default, one host per user with ``light_hosts``.
    """
    host = F.col("user_id") if light_hosts else F.col("user_id") % 5
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("agent-"), host.cast("string")).alias("agent"),
        F.concat_ws("-", "event_type", (k % 12).cast("string")).alias("rule_id"),
        F.least(F.lit(15), (1 + F.floor(F.col("value") / 20))).cast("int").alias("rule_level"),
        F.concat(F.lit("dec-"), (k % 11).cast("string")).alias("decoder"),
    )


def alerts(spark: SparkSession, sf_dir: str, light_hosts: bool = False) -> DataFrame:
    return alerts_from_events(table(spark, sf_dir, "events"), light_hosts)


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_alerts_from(table(spark, sf_dir, "events"))


def raw_alerts_from(ev: DataFrame) -> DataFrame:
    """The same alerts as a sparse all-text export."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    text_time = F.date_format("ts", EXPORT_FORMAT)
    return ev.select(
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("_id"),
        text_time.alias("_source.timestamp"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string")).alias("_source.agent.name"),
        F.concat_ws("-", "event_type", (k % 12).cast("string")).alias("_source.rule.id"),
        F.least(F.lit(15), (1 + F.floor(F.col("value") / 20))).cast("int").cast("string")
        .alias("_source.rule.level"),
        F.when(k % 8 != 0, F.concat(F.lit("dec-"), (k % 11).cast("string"))).alias("_source.decoder.name"),
        F.when(k % 6 == 0, F.concat(F.lit("10.0.0."), k.cast("string"))).alias("_source.data.srcip"),
        F.when(F.col("event_type") == "click", (k % 3).cast("string")).alias("_source.data.status"),
    )


def label_expr():
    """A label that is a function of the row, for SQL-checked metrics."""
    return ((F.col("rule_level") >= 8) & (F.hour("timestamp") <= 6)).cast("int")
