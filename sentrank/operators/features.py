"""Sixteen features with statistics fitted on one window and frozen for the others."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..constants import CANONICAL, FEATURES
from ..functions import hashing, times
from ..functions.numbers import log1p_clipped, ratio_or_zero
from ..session import settle, small_side
from .quantiles import exact_quantiles

HOST, HOST_RULE = ("agent",), ("agent", "rule_id")


def _keyed(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of each key with its prefixed twin on the other side."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _twin(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def recency(
    df: DataFrame, keys: tuple[str, ...] = HOST, bucket_s: int = 60,
    last_seen: DataFrame | None = None, out: str = "recency_s",
) -> DataFrame:
    """Adds the seconds since the previous alert of the same key.

    NULL for the first alert of a key and for rows without time; rows that share
    a time with an earlier-sorted row get 0. ``event_id`` must be unique. Same
    result as ``lag`` over (key, time, id), but no task holds a whole key:

    * equal times of a key are folded to their first row with map-side combine,
    * ``lag`` runs inside (key, time bucket),
    * the first row of a bucket takes the end of the key's previous bucket,
    * the gap goes back to exactly that row by id, which spreads evenly.

    ``last_seen`` (keys, ``last_ts``) continues from an earlier window; a row older
    than that gets 0.
    """
    ks = list(keys)
    t = F.col("timestamp")
    firsts = (
        df.filter(t.isNotNull()).groupBy(*ks, "timestamp").agg(F.min("event_id").alias("event_id"))
        .withColumn("_b", F.floor(times.micros(t) / F.lit(bucket_s * 1_000_000)))
    )
    ends = firsts.groupBy(*ks, "_b").agg(F.max("timestamp").alias("_end"))
    carry = ends.select(*ks, "_b", F.lag("_end").over(Window.partitionBy(*ks).orderBy("_b")).alias("_carry"))
    inside = firsts.withColumn("_prev", F.lag("timestamp").over(Window.partitionBy(*ks, "_b").orderBy("timestamp")))
    gaps = inside.join(_twin(carry, [*ks, "_b"], "_k_"), _keyed([*ks, "_b"], "_k_"), "left").select(
        *ks, "timestamp", "event_id", F.coalesce("_prev", "_carry").alias("_prev"))
    if last_seen is not None:
        gaps = gaps.join(_twin(last_seen, ks, "_k_"), _keyed(ks, "_k_"), "left").select(
            *ks, "timestamp", "event_id", F.greatest("_prev", "last_ts").alias("_prev"))
    gaps = gaps.select(
        F.col("event_id").alias("_id"), F.col("timestamp").alias("_t"),
        F.struct(F.when(F.col("_prev").isNotNull(), F.greatest(
            times.seconds_between(F.col("timestamp"), F.col("_prev")), F.lit(0.0))).alias("s")).alias("_gap"))
    joined = df.join(gaps, F.col("event_id").eqNullSafe(F.col("_id")) & (t == F.col("_t")), "left")
    value = F.when(F.col("_gap").isNotNull(), F.col("_gap.s")).when(t.isNotNull(), F.lit(0.0))
    return joined.withColumn(out, value).drop("_id", "_t", "_gap")


def last_seen(df: DataFrame, keys: tuple[str, ...] = HOST) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("timestamp").alias("last_ts"))


def host_stats(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of the level per host; a single row has deviation 0."""
    return df.groupBy("agent").agg(
        F.avg("rule_level").alias("mu"),
        F.coalesce(F.stddev_samp("rule_level"), F.lit(0.0)).alias("sd"),
    )


def combo_freq(df: DataFrame, hour_bucket_h: int = 2) -> DataFrame:
    bucket = times.hour_bucket(times.hour_or_zero(F.col("timestamp")), hour_bucket_h)
    return df.groupBy("agent", "rule_id", bucket.alias("hour_bucket")).agg(F.count("*").alias("cnt"))


def recency_median(df: DataFrame, keys: tuple[str, ...] = HOST) -> float:
    """Exact median of all gaps, 0 if there is none."""
    gaps = settle(recency(df, keys).select("recency_s"))
    return exact_quantiles(gaps, ["recency_s"], [0.5])["recency_s"][0] or 0.0


def fit(df: DataFrame, keys: tuple[str, ...] = HOST, hour_bucket_h: int = 2) -> dict[str, DataFrame]:
    """Frozen statistics of a training window as three settled tables: the window is read here only."""
    median = recency_median(df, keys)
    return {
        "host_stats": settle(host_stats(df)),
        "combo_freq": settle(combo_freq(df, hour_bucket_h)),
        "globals": df.sparkSession.createDataFrame([(float(median),)], schema.GLOBALS),
    }


def add_host_z(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Level z-score against frozen host statistics; unknown or missing hosts get 0."""
    s = stats.select(F.col("agent").alias("_a"), "mu", "sd")
    return (
        df.join(small_side(s), df["agent"] == s["_a"], "left")
        .withColumn("rule_level_z_host", ratio_or_zero(F.col("rule_level"), F.col("mu"), F.col("sd")))
        .drop("_a", "mu", "sd")
    )


def add_combo_features(df: DataFrame, freq: DataFrame, hash_kind: str = "blake2b",
                       source: DataFrame | None = None) -> DataFrame:
    """Hash and frozen frequency of (agent, rule, hour bucket); needs ``hour_bucket``.

    The Python hash runs once per distinct combination; both values come back in
    one join. ``source`` may name a cheaper frame with the same combinations.
    """
    keys = ["agent", "rule_id", "hour_bucket"]
    key = hashing.combo_key(*[F.col(k) for k in keys])
    freq = freq.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "cnt")
    if hash_kind == "md5":
        lookup = freq
    else:
        known = (df if source is None else source).select(*keys).distinct()
        found = known.join(freq, _keyed(keys, "_c_"), "left").withColumn("_h", hashing.hash01(key))
        lookup = found.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "cnt", "_h")
    joined = df.join(lookup, _keyed(keys, "_c_"), "left").drop(*[f"_c_{k}" for k in keys])
    h = hashing.hash01_md5(key) if hash_kind == "md5" else F.col("_h")
    return (
        joined.withColumn("agent_rule_hour_hash01", h)
        .withColumn("agent_rule_hour_freq_log1p", F.log1p(F.coalesce("cnt", F.lit(0)).cast("double")))
        .drop("cnt", "_h")
    )


def add_crosses(df: DataFrame) -> DataFrame:
    level, z = F.col("rule_level").cast("double"), F.col("rule_level_z_host")
    return df.withColumns({
        "offhours_x_rule_level": F.col("is_off_hours") * level,
        "offhours_x_rule_level_z": F.col("is_off_hours") * z,
        "weekend_x_rule_level_z": F.col("is_weekend") * z,
        "recency_x_rule_level": F.col("rule_time_since_last_host_log1p") * level,
    })


def apply(
    df: DataFrame, stats: dict[str, DataFrame], hash_kind: str = "blake2b",
    keys: tuple[str, ...] = HOST, minute_bucket_s: int = 60, hour_bucket_h: int = 2,
    history: DataFrame | None = None,
) -> DataFrame:
    """All features from frozen statistics; nothing is fitted on ``df``.

    ``history`` continues recency from the last alerts of an earlier window;
    without it the first alert of a key takes the frozen median.
    """
    median = stats["globals"].first()["recency_median"]
    rows = df.withColumns(times.calendar_features(F.col("timestamp"), minute_bucket_s, hour_bucket_h))
    base = add_host_z(rows, stats["host_stats"])
    seen = last_seen(history, keys) if history is not None else None
    base = recency(base, keys, last_seen=seen)
    return finish(base, median, stats["combo_freq"], hash_kind, rows)


def finish(base: DataFrame, median: float, freq: DataFrame, hash_kind: str,
           source: DataFrame | None = None) -> DataFrame:
    """Recency scaling, combo features and crosses on rows that have ``recency_s``."""
    gap = F.greatest(F.coalesce("recency_s", F.lit(float(median))), F.lit(0.0))
    base = base.withColumn("rule_time_since_last_host", gap).withColumn(
        "rule_time_since_last_host_log1p", log1p_clipped(gap)).drop("recency_s")
    full = add_crosses(add_combo_features(base, freq, hash_kind, source))
    front = [c for c in df_front(full) if c in full.columns]
    return full.select(*front, *[f for f in FEATURES if f not in front], "rule_time_since_last_host")


def df_front(df: DataFrame) -> list[str]:
    """Canonical columns first, then whatever else the caller carried along."""
    made = {*FEATURES, "rule_time_since_last_host"}
    return CANONICAL + [c for c in df.columns if c not in made and c not in CANONICAL]


def fit_apply(df: DataFrame, **options) -> DataFrame:
    """Features of a batch from its own statistics (the review-screen path)."""
    fit_options = {k: v for k, v in options.items() if k in ("keys", "hour_bucket_h")}
    return apply(df, fit(df, **fit_options), **options)


def numeric_features(df: DataFrame, wanted: list[str] | None = None, override: list[str] | None = None) -> list[str]:
    """Feature list: all numeric columns, narrowed by ``wanted``, then by ``override``.

    Names that are absent or not numeric are ignored; an empty choice keeps the
    previous one.
    """
    numeric = [c for c, t in df.dtypes if t.split("(")[0] in
               ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    chosen = numeric
    for names in (wanted, override):
        kept = [c for c in names or [] if c in numeric]
        chosen = kept or chosen
    return chosen


def matrix(df: DataFrame, features: list[str], fill: float | None = 0.0) -> list[Column]:
    """Model columns ``f0…`` as DOUBLE; missing and NaN become ``fill`` (or stay)."""
    out = []
    for i, f in enumerate(features):
        c = F.col(f"`{f}`").try_cast("double")
        if fill is not None:
            c = F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(fill))
        out.append(c.alias(f"f{i}"))
    return out
