"""Why a few top alerts rank high: occlusion, neighbour comparison, flags, payloads."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DELTA_KEY
from ..session import settle
from .inject import seen_pairs
from .neighbors import Index, add_by_vector, knn_join, mean_distance, vector_join
from .quantiles import exact_quantiles

Scorer = Callable[[DataFrame], DataFrame]


def feature_medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact training medians, the occlusion baseline."""
    return {f: q[0] for f, q in exact_quantiles(train, features, [0.5]).items()}


def feature_iqr(train: DataFrame, features: list[str]) -> dict[str, float]:
    return {f: (q[1] - q[0]) if q[0] is not None else None
            for f, q in exact_quantiles(train, features, [0.25, 0.75]).items()}


def knn_scorer(index: Index, features: list[str], k: int) -> Scorer:
    """Mean distance to k training rows as a frame → frame function."""
    def score(df: DataFrame) -> DataFrame:
        scores = mean_distance(vector_join(df, index, features, k, label=None), k)
        return add_by_vector(df.drop("anomaly_score"), features, scores)

    return score


def _value_of(feature: Column, values: dict[str, Column]) -> Column:
    """The entry of ``values`` named by ``feature``."""
    names = F.array(*[F.lit(f) for f in values])
    cells = F.array(*[c.cast("double") for c in values.values()])
    return F.element_at(cells, F.array_position(names, feature).cast("int"))


def occlusion(top: DataFrame, features: list[str], baseline: dict[str, float], scorer: Scorer) -> DataFrame:
    """Long table: for each top alert and feature the score lost when the feature takes its baseline.

    ``top`` has rank, event_id, agent and the features. All changed copies
    (alerts x features) are scored in one call, together with the originals.
    """
    base = "-"
    copies = top.withColumn("_f", F.explode(F.array(F.lit(base), *[F.lit(f) for f in features])))
    changed = {
        f: F.when(F.col("_f") == f, F.lit(baseline[f])).otherwise(F.col(f"`{f}`").cast("double")) for f in features
    }
    keyed = copies.withColumns(changed).withColumns({
        "_event": F.col("event_id"), "event_id": F.concat_ws("|", "event_id", "_f")})
    scored = settle(scorer(keyed).select("_event", "_f", "anomaly_score"))
    original = scored.filter(F.col("_f") == base).select(F.col("_event").alias("_e"), F.col("anomaly_score").alias("score"))
    effect = scored.filter(F.col("_f") != base).join(original, F.col("_event") == F.col("_e")).select(
        "_event", F.col("_f").alias("feature"), "score", (F.col("score") - F.col("anomaly_score")).alias("contribution"))
    values = {f: F.col(f"`{f}`") for f in features}
    facts = top.select("rank", F.col("event_id").alias("_id"), "agent", *[F.col(f"`{f}`") for f in features])
    f = F.col("feature")
    return effect.join(facts, F.col("_event") == F.col("_id")).select(
        "rank", F.col("_event").alias("event_id"), "agent", "score", "feature",
        _value_of(f, values).alias("value"),
        _value_of(f, {n: F.lit(v).cast("double") for n, v in baseline.items()}).alias("baseline"),
        "contribution", F.abs("contribution").alias("abs_contribution"))


def sorted_explanations(long: DataFrame) -> DataFrame:
    return long.orderBy("rank", F.desc("abs_contribution"), "feature")


def top_features(long: DataFrame, n: int, by: str = "abs_contribution") -> DataFrame:
    """The ``n`` strongest features of each alert (an alert has one row per feature)."""
    spec = Window.partitionBy("event_id").orderBy(F.col(by).desc_nulls_last(), "feature")
    return long.withColumn("place", F.row_number().over(spec)).filter(F.col("place") <= n)


def neighbor_medians(top: DataFrame, index: Index, features: list[str], k: int) -> DataFrame:
    """Per top alert and feature the median over its k nearest training rows."""
    near = knn_join(top, index, features, k).select("event_id", F.explode("neighbors").alias("id"))
    vectors = index.rows.select("id", *index.columns)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("x"))
                      for f, c in zip(features, index.columns)])
    long = near.join(vectors, "id").select("event_id", F.inline(cells))
    return long.groupBy("event_id", "feature").agg(F.median("x").alias("neighbor_median"))


def reason_codes(top: DataFrame, index: Index, features: list[str], k: int,
                 iqr: dict[str, float]) -> DataFrame:
    """Scaled distance from the neighbours' median per alert and feature; a zero IQR gives NULL."""
    medians = neighbor_medians(top, index, features, k)
    facts = top.select("rank", F.col("event_id").alias("_id"), *[F.col(f"`{f}`") for f in features])
    f = F.col("feature")
    spread = _value_of(f, {n: F.lit(v).cast("double") for n, v in iqr.items()})
    value = _value_of(f, {n: F.col(f"`{n}`") for n in features})
    scaled = F.abs(value - F.col("neighbor_median")) / F.nullif(spread, F.lit(0.0))
    return medians.join(facts, F.col("event_id") == F.col("_id")).select(
        "rank", "event_id", "feature", value.alias("value"), "neighbor_median", scaled.alias("scaled_contribution"))


def context_flags(df: DataFrame, history: DataFrame, high_level: int = 10) -> DataFrame:
    """Adds ``flags``: off-hours with high severity, rule or decoder new on this host."""
    rules = seen_pairs(history, "rule_id").select(
        F.col("agent").alias("_ra"), F.col("rule_id").alias("_r"))
    decoders = seen_pairs(history, "decoder").select(
        F.col("agent").alias("_da"), F.col("decoder").alias("_d"))
    rows = df.join(rules, (F.col("agent") == F.col("_ra")) & (F.col("rule_id") == F.col("_r")), "left").join(
        decoders, (F.col("agent") == F.col("_da")) & (F.col("decoder") == F.col("_d")), "left")
    off = F.coalesce(F.hour("timestamp"), F.lit(0)) <= 6
    flags = F.array_compact(F.array(
        F.when(off & (F.col("rule_level") >= high_level), F.lit("off-hours × high severity")),
        F.when(F.col("_r").isNull() & F.col("rule_id").isNotNull(), F.lit("new rule on this host")),
        F.when(F.col("_d").isNull() & F.col("decoder").isNotNull(), F.lit("new decoder on this host")),
    ))
    return rows.withColumn("flags", flags).drop("_ra", "_r", "_da", "_d")


def reason_payload(long: DataFrame, flags: DataFrame, medians: DataFrame | None = None, n: int = 3) -> DataFrame:
    """JSON ``reason`` per alert: top features with their score delta, neighbour medians, flags."""
    best = top_features(long, n)
    entry = F.struct("place", "feature", F.col("contribution").alias(DELTA_KEY))
    tops = best.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("t")).select(
        "event_id", F.transform("t", lambda e: F.struct(e["feature"].alias("feature"),
                                                        e[DELTA_KEY].alias(DELTA_KEY))).alias("top_features"))
    out = tops.join(flags.select(F.col("event_id").alias("_f_id"), "flags"), F.col("event_id") == F.col("_f_id"), "left")
    parts = [F.col("top_features"), F.coalesce("flags", F.array().cast("array<string>")).alias("context_flags")]
    if medians is not None:
        comp = medians.groupBy(F.col("event_id").alias("_m_id")).agg(F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("feature", "neighbor_median")))).alias("neighbor_medians"))
        out = out.join(comp, F.col("event_id") == F.col("_m_id"), "left")
        parts.append(F.col("neighbor_medians"))
    return out.select("event_id", F.to_json(F.struct(*parts)).alias("reason"))
