"""Declared schemas of the tables that move between stages."""

from pyspark.sql import types as T

from .constants import FEATURES

ALERTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("agent", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_level", T.IntegerType()),
    T.StructField("decoder", T.StringType()),
])

INT_FEATURES = [
    "hour_local", "is_off_hours", "day_of_week", "is_weekend", "second_in_hour",
    "seconds_in_hour_bucketed", "hour_bucket", "rule_level",
]

FEATURE_TABLE = T.StructType(
    ALERTS.fields
    + [
        T.StructField(f, T.IntegerType() if f in INT_FEATURES else T.DoubleType())
        for f in FEATURES
        if f != "rule_level"
    ]
    + [T.StructField("rule_time_since_last_host", T.DoubleType())]
)

LABELLED = T.StructType(
    ALERTS.fields
    + [
        T.StructField("split", T.StringType()),
        T.StructField("is_synth_anom", T.IntegerType()),
        T.StructField("y_true_synth", T.IntegerType()),
        T.StructField("y_mask_eval", T.IntegerType()),
        T.StructField("synth_usecase", T.StringType()),
    ]
)

HOST_STATS = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("mu", T.DoubleType()),
    T.StructField("sd", T.DoubleType()),
])
COMBO_FREQ = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("hour_bucket", T.IntegerType()),
    T.StructField("cnt", T.LongType()),
])
GLOBALS = T.StructType([T.StructField("recency_median", T.DoubleType())])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
