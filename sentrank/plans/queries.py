"""Registered queries: every operator on the derived alert tables."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DELTA_KEY, FEATURES, REPLY_COLUMNS
from ..fixtures import (
    T1_END, T2_END, T2_START, alerts, alerts_from_events, label_expr, raw_alerts, raw_alerts_from, table,
)
from ..functions import hashing, numbers, payloads, times
from ..operators import (
    canonical, explain, features, forest, formula, inject, metrics, neighbors, quality, rank, split,
)
from ..operators.quantiles import rank_rows
from ..schema import ALERTS, EVENTS
from ..session import prepare, scratch_path, settle
from ..streaming import alerts as feed

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}

_AT = FEATURES.index("rule_level")
INT_COLS = FEATURES[:_AT]
REAL_COLS = [*FEATURES[_AT + 1:], "rule_time_since_last_host"]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__ = fn.__name__
    _ALL[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Query]:
    from . import storage_queries  # noqa: F401  registers its queries

    return dict(_ALL)


def window(spark: SparkSession, d: str, which: str) -> DataFrame:
    return split.window_rows(alerts(spark, d), which, T1_END, T2_START, T2_END)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Formula scores cut to nine digits, so equal scores tie in every engine."""
    return formula.score(alerts(spark, d)).withColumn("anomaly_score", F.round("anomaly_score", 9))


# --- formula score and slices -------------------------------------------------

@query
def formula_score(spark, d):
    return formula.score(alerts(spark, d)).select("event_id", "agent", "rule_id", "rule_level", *r6("anomaly_score"))


@query
def topk_formula_score(spark, d):
    top = formula.top_k_by_formula(alerts(spark, d), 50)
    return canonical.pick_columns(top.withColumn("anomaly_score", F.round("anomaly_score", 6)), REPLY_COLUMNS)


@query
def topk_ascending_level(spark, d):
    return rank.top_k(alerts(spark, d), 25, by="rule_level", descending=False).select("rank", "event_id", "rule_level")


@query
def topp_slice(spark, d):
    return rank.top_p(scored(spark, d), 0.01).select("rank", "event_id", *r6("anomaly_score"))


@query
def topp_per_day(spark, d):
    return rank.top_p_per_day(scored(spark, d), 0.01).select("day", "rank", "event_id", *r6("anomaly_score"))


@query
def threshold_select(spark, d):
    return rank.above_threshold(formula.score(alerts(spark, d)), 0.5).select("event_id", *r6("anomaly_score"))


@query
def score_summary(spark, d):
    return metrics.score_summary(formula.score(alerts(spark, d))).select(
        *r6("score_min", "score_max", "score_mean"), "rows")


# --- features -----------------------------------------------------------------

def frozen(spark, d, **options) -> DataFrame:
    stats = features.fit(window(spark, d, "T1"))
    return features.apply(window(spark, d, "T2"), stats, hash_kind="md5", **options)


@query
def temporal_features(spark, d):
    t2 = window(spark, d, "T2")
    return t2.withColumns(times.calendar_features(F.col("timestamp"))).select("event_id", *INT_COLS)


@query
def recency_per_agent(spark, d):
    return features.recency(alerts(spark, d)).select("event_id", *r6("recency_s"))


@query
def recency_per_agent_rule(spark, d):
    return features.recency(alerts(spark, d), features.HOST_RULE).select("event_id", *r6("recency_s"))


@query
def host_zscore_frozen(spark, d):
    z = features.add_host_z(window(spark, d, "T2"), features.host_stats(window(spark, d, "T1")))
    return z.select("event_id", *r6("rule_level_z_host"))


@query
def combo_freq_frozen(spark, d):
    t2 = window(spark, d, "T2").withColumns(times.calendar_features(F.col("timestamp")))
    f = features.add_combo_features(t2, features.combo_freq(window(spark, d, "T1")), "md5")
    return f.select("event_id", *r6("agent_rule_hour_freq_log1p"))


@query
def cross_features(spark, d):
    return frozen(spark, d).select("event_id", *r6(*REAL_COLS[2:6]))


@query
def hash01_md5(spark, d):
    bucket = times.hour_bucket(times.hour_or_zero(F.col("timestamp")))
    combos = window(spark, d, "T2").select("agent", "rule_id", bucket.alias("hour_bucket")).distinct()
    key = hashing.combo_key(F.col("agent"), F.col("rule_id"), F.col("hour_bucket"))
    return combos.withColumn("hash01", F.round(hashing.hash01_md5(key), 9))


@query
def features_full(spark, d):
    return frozen(spark, d).select("event_id", "agent", "rule_id", "rule_level", *INT_COLS, *r6(*REAL_COLS))


@query
def features_blake2b(spark, d):
    stats = features.fit(window(spark, d, "T1"))
    return features.apply(window(spark, d, "T2"), stats).select("event_id", *INT_COLS, *r6(*REAL_COLS))


@query
def features_on_batch(spark, d):
    return features.fit_apply(alerts(spark, d), hash_kind="md5").select("event_id", *INT_COLS, *r6(*REAL_COLS))


@query
def fit_host_stats(spark, d):
    return features.host_stats(window(spark, d, "T1")).select("agent", *r6("mu", "sd"))


@query
def fit_combo_freq(spark, d):
    return features.combo_freq(window(spark, d, "T1"))


@query
def fit_recency_median(spark, d):
    return features.fit(window(spark, d, "T1"))["globals"].select(*r6("recency_median"))


# --- ingest, cleaning, split ----------------------------------------------------

@query
def canonicalise(spark, d):
    return canonical.canonicalise(raw_alerts(spark, d))


@query
def export_time_roundtrip(spark, d):
    ev = table(spark, d, "events")
    text = times.format_export_time(F.col("ts"))
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"), text.alias("export_text"),
        times.parse_export_time(text).alias("parsed"), times.format_iso_seconds(F.col("ts")).alias("iso_text"))


@query
def dedup_keep_first(spark, d):
    a = alerts(spark, d)
    again = a.filter("rule_level <= 2").withColumns({
        "timestamp": F.col("timestamp") + F.expr("INTERVAL 1 HOUR"), "rule_level": F.lit(0)})
    return canonical.dedup_keep_first(a.unionByName(again))


@query
def dedup_rows(spark, d):
    return canonical.dedup_rows(alerts(spark, d).select("agent", "rule_id", "decoder", "rule_level"))


@query
def temporal_split(spark, d):
    return split.temporal_split(alerts(spark, d), T1_END, T2_START, T2_END).select("event_id", "split")


@query
def split_summary(spark, d):
    return split.split_summary(split.temporal_split(alerts(spark, d), T1_END, T2_START, T2_END))


@query
def union_by_name(spark, d):
    from ..sources.csv_scan import union_by_name as union

    a = alerts(spark, d)
    return union([a.filter("rule_level >= 5").select("event_id", "agent", "decoder"),
                  a.filter("rule_level < 5").select("rule_id", "agent", "event_id")])


@query
def time_sorted_positions(spark, d):
    a = alerts(spark, d).select("event_id", "timestamp")
    return rank_rows(a, [F.col("timestamp").asc_nulls_last(), F.col("event_id")], rank_col="pos").select("pos", "event_id")


# --- quality and description ------------------------------------------------------

@query
def coverage_report(spark, d):
    return quality.coverage_report(raw_alerts(spark, d)).drop("distinct_estimate")


@query
def select_high_coverage(spark, d):
    raw = raw_alerts(spark, d)
    keep = quality.select_columns(quality.coverage_report(raw), 0.85, time="_source.timestamp")
    return canonical.align_columns(raw, keep)


@query
def null_counts(spark, d):
    return quality.null_counts(raw_alerts(spark, d))


@query
def distinct_counts(spark, d):
    raw = raw_alerts(spark, d)
    return quality.distinct_counts(raw, raw.columns)


@query
def uniform_sample(spark, d):
    return quality.uniform_sample(alerts(spark, d), 500).select("event_id", "agent")


@query
def cleaning_report(spark, d):
    raw = raw_alerts(spark, d)
    mapping = canonical.clean_mapping(raw.columns)
    clean = canonical.dedup_keep_first(canonical.canonicalise(raw, mapping))
    return quality.cleaning_report(raw, clean, mapping, canonical.dropped_columns(raw.columns, mapping))


@query
def corpus_summary(spark, d):
    return quality.corpus_summary(alerts(spark, d))


@query
def events_per_day(spark, d):
    return quality.per_day(alerts(spark, d))


@query
def hour_hist(spark, d):
    return quality.per_hour(alerts(spark, d))


@query
def weekday_hist(spark, d):
    return quality.per_weekday(alerts(spark, d))


@query
def offhours_share(spark, d):
    return quality.off_hours_share(alerts(spark, d))


@query
def hour_weekday_matrix(spark, d):
    return quality.hour_weekday_matrix(alerts(spark, d))


@query
def level_dist(spark, d):
    return quality.distribution(alerts(spark, d), "rule_level")


@query
def agent_dist(spark, d):
    return quality.distribution(alerts(spark, d), "agent")


@query
def top_rules(spark, d):
    return quality.top_values(alerts(spark, d), "rule_id")


@query
def top_decoders(spark, d):
    return quality.top_values(alerts(spark, d), "decoder")


@query
def top_rule_groups(spark, d):
    ev = table(spark, d, "events")
    grade = F.when(F.col("value") >= 100, "high").otherwise("low")
    names = F.to_json(F.array("event_type", F.lit("all"), grade)).alias("groups")
    return quality.top_groups(ev.select(names), "groups", 5)


# --- injection ------------------------------------------------------------------

BOUNDS = (T1_END, T2_START, T2_END)


def light_window(spark, d, which):
    return split.window_rows(alerts(spark, d, light_hosts=True), which, *BOUNDS)


@query
def seen_rules_per_host(spark, d):
    return inject.seen_pairs(light_window(spark, d, "T1"), "rule_id")


@query
def host_level_mean(spark, d):
    return inject.host_level_mean(light_window(spark, d, "T1")).select("agent", *r6("mu"))


@query
def unseen_candidates(spark, d):
    t1, t2 = light_window(spark, d, "T1"), light_window(spark, d, "T2")
    vocab = inject.vocabulary(t1.unionByName(t2), "rule_id")
    seen = inject.seen_pairs(t1, "rule_id")
    hosts = t2.select("agent").distinct()
    return inject.unseen_values(hosts, seen.join(hosts, "agent", "left_semi"), vocab, "rule_id")


@query
def inject_replace(spark, d):
    return inject.inject(alerts(spark, d, light_hosts=True), *BOUNDS, with_history=True)


@query
def inject_append(spark, d):
    return inject.inject(alerts(spark, d, light_hosts=True), *BOUNDS, mode="append")


@query
def inject_counts(spark, d):
    return inject.family_summary(inject.inject(alerts(spark, d), *BOUNDS))


# --- metrics --------------------------------------------------------------------

FIGURES = ["precision", "recall", "lift", "fpr"]
COUNTS = ["tp", "fp", "fn", "tn"]
PS = [0.005, 0.01, 0.02, 0.03]


def labelled_scores(spark, d):
    return scored(spark, d).withColumn("y", label_expr())


@query
def metrics_at_p(spark, d):
    m = metrics.budget_metrics(labelled_scores(spark, d), "y", ps=PS)
    return m.select("p", "k", *COUNTS, *r6(*FIGURES))


@query
def metrics_at_k(spark, d):
    m = metrics.budget_metrics(labelled_scores(spark, d), "y", ks=[25, 50, 100])
    return m.select("k", *COUNTS, *r6(*FIGURES))


@query
def metrics_per_day(spark, d):
    m = metrics.metrics_per_day(labelled_scores(spark, d), "y", 0.02)
    return m.select("day", "k", "tp", "n", "positives", *r6(*FIGURES))


@query
def day_stability(spark, d):
    m = metrics.metrics_per_day(labelled_scores(spark, d), "y", 0.02)
    return metrics.day_stability(m).select("figure", *r6("q25", "q50", "q75"))


@query
def metrics_by_family(spark, d):
    df = labelled_scores(spark, d).withColumn("kind", F.element_at(F.split("rule_id", "-"), 1))
    return metrics.metrics_by_family(df, "y", "kind", 100).select("family", "positives", "hits", *r6("recall"))


@query
def score_histogram(spark, d):
    return metrics.score_histogram(scored(spark, d))


@query
def selection_rate(spark, d):
    m = metrics.selection_rate(formula.score(alerts(spark, d)), 0.5)
    return m.select("day", "alerts", "selected", *r6("rate"))


@query
def drift_by_day(spark, d):
    s = scored(spark, d)
    train = split.window_rows(s, "T1", *BOUNDS)
    later = s.filter(F.col("timestamp") >= F.lit(T2_START).cast("timestamp_ntz"))
    m = metrics.drift_by_day(later, metrics.bin_edges(train))
    return m.select("day", "bin", "alerts", *r6("share"))


@query
def run_metadata(spark, d):
    began = time.monotonic()
    s = formula.score(alerts(spark, d))
    n = alerts(spark, d).count()
    m = metrics.run_metadata(s, rank.slice_size(n, 0.01), "formula", time.monotonic() - began)
    return m.withColumns({"latency_s": F.col("latency_s") > 0, "selection_rate": F.round("selection_rate", 6)}).withColumnRenamed(
        "latency_s", "timed")


# --- neighbours -------------------------------------------------------------------

def model_windows(spark, d):
    """Training and validation features from frozen statistics, written once."""
    t1, t2 = window(spark, d, "T1"), window(spark, d, "T2")
    stats = features.fit(t1)
    return [settle(features.apply(t, stats, hash_kind="md5")) for t in (t1, t2)]


def knn_scored(spark, d, k=35):
    """Training rows, their index, and the validation rows scored with it."""
    train, test = model_windows(spark, d)
    index = neighbors.build_index(train, FEATURES)
    s = explain.knn_scorer(index, FEATURES, k)(test).withColumn("anomaly_score", F.round("anomaly_score", 9))
    return train, index, settle(s)


@query
def knn_score(spark, d):
    train, test = model_windows(spark, d)
    return neighbors.knn_score(test, train, FEATURES, 35).select("event_id", *r6("anomaly_score"))


@query
def knn_score_scaled(spark, d):
    train, test = model_windows(spark, d)
    s = neighbors.knn_score(test, train, FEATURES, 10, scale=True)
    return s.select("event_id", *r6("anomaly_score"))


@query
def knn_topp(spark, d):
    _, _, s = knn_scored(spark, d)
    return rank.top_p(s, 0.01).select("rank", "event_id", *r6("anomaly_score"))


@query
def lof_score(spark, d):
    train, test = model_windows(spark, d)
    return neighbors.lof_score(test, train, FEATURES, 20).select("event_id", *r6("anomaly_score"))


@query
def sweep_best_k(spark, d):
    train, test = model_windows(spark, d)
    near = neighbors.knn_join(test, neighbors.build_index(train, FEATURES), FEATURES, 50, label=None)
    labels = test.select("event_id", label_expr().alias("y"))
    near = settle(near.select("event_id", "dists").join(labels, "event_id"))
    best = metrics.best_k(metrics.sweep(near, "y", [5, 10, 20, 35, 50], PS))
    return best.select("p", "k", *r6(*FIGURES))


# --- explanations -------------------------------------------------------------------

@query
def occlusion_topn(spark, d):
    train, index, s = knn_scored(spark, d)
    top = rank.top_k(s, 10)
    scorer = explain.knn_scorer(index, FEATURES, 35)
    long = explain.occlusion(top, FEATURES, explain.feature_medians(train, FEATURES), scorer)
    return long.select("rank", "event_id", "feature",
                       *r6("score", "value", "baseline", "contribution", "abs_contribution"))


@query
def reason_codes_neighbor(spark, d):
    train, index, s = knn_scored(spark, d)
    codes = explain.reason_codes(rank.top_k(s, 10), index, FEATURES, 35, explain.feature_iqr(train, FEATURES))
    return codes.select("rank", "event_id", "feature", *r6("value", "neighbor_median", "scaled_contribution"))


@query
def reason_payload(spark, d):
    train, index, s = knn_scored(spark, d)
    top = settle(rank.top_k(s, 10))
    scorer = explain.knn_scorer(index, FEATURES, 35)
    long = explain.occlusion(top, FEATURES, explain.feature_medians(train, FEATURES), scorer)
    flags = explain.context_flags(top, window(spark, d, "T1"))
    return explain.reason_payload(long, flags, explain.neighbor_medians(top, index, FEATURES, 35))


@query
def context_flags(spark, d):
    f = explain.context_flags(light_window(spark, d, "T2"), light_window(spark, d, "T1"))
    return f.select("event_id", F.array_join("flags", "; ").alias("flags"))


def explanation_cells(spark, d):
    """Valid JSON, JSON with escaped quotes, plain text, blank and missing cells."""
    ev = table(spark, d, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    key = DELTA_KEY
    good = F.concat(
        F.lit('{"top_features":[{"feature":"rule_level","' + key + '":'), (k / 8.0).cast("string"),
        F.lit('},{"feature":"hour_local","' + key + '":"n/a"},{"feature":"second_in_hour"},{"feature":"z"}]}'))
    cell = (
        F.when(k % 5 == 0, good).when(k % 5 == 1, F.replace(good, F.lit('"'), F.lit("\\'")))
        .when(k % 5 == 2, F.concat(F.lit("not json "), k.cast("string"))).when(k % 5 == 3, F.lit("  "))
    )
    return ev.select(F.col("event_id").cast("string").alias("event_id"), cell.alias("explanations"))


@query
def parse_explanations(spark, d):
    v = payloads.parse_explanation(F.col("explanations"))
    cells = explanation_cells(spark, d).withColumn("v", v)
    n = F.size(F.try_variant_get("v", "$.top_features", "array<variant>"))
    return cells.select("event_id", F.when(n >= 0, n).alias("n_features"),
                        F.try_variant_get("v", "$.raw", "string").alias("raw_text"))


@query
def reason_summary(spark, d):
    v = payloads.parse_explanation(F.col("explanations"))
    return explanation_cells(spark, d).select("event_id", payloads.summarise_explanation(v).alias("summary"))


@query
def label_to_score(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    text = F.when(k % 4 == 0, "Anomalous").when(k % 4 == 1, "normal").when(k % 4 == 2, "BAD host").otherwise(
        k.cast("string"))
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"), numbers.label_to_score(text).alias("score"))


@query
def records_json(spark, d):
    a = alerts(spark, d).withColumn("decoder", F.when(F.col("rule_level") != 1, F.col("decoder")))
    rec = payloads.json_record(a.select("event_id", "timestamp", "agent", "rule_level", "decoder"))
    return a.select("event_id", rec.alias("record"))


# --- forest ---------------------------------------------------------------------

@query
def iforest_score(spark, d):
    train, test = model_windows(spark, d)
    model = forest.fit(train, FEATURES)
    return forest.score(test, model).select("event_id", *r6("anomaly_score"))


# --- streams ----------------------------------------------------------------------

RUNS = [T1_END, "2024-01-22", "2024-01-24"]


def in_runs(spark, d, base, run):
    """Feed ``events`` in four runs, day after day; the query restarts from its checkpoint each time."""
    events = table(spark, d, "events")
    day, before = F.to_date("ts"), None
    for end in [*RUNS, None]:
        part = events if before is None else events.filter(day > F.lit(before).cast("date"))
        part = part if end is None else part.filter(day <= F.lit(end).cast("date"))
        part.write.mode("append").parquet(f"{base}/feed")
        run(feed.read_feed(spark, f"{base}/feed", EVENTS))
        before = end


@query
def stream_canonical(spark, d):
    """Raw-shaped feed to canonical rows, straight from the table's own path (a file or a folder of files)."""
    base = scratch_path(spark, "stream-canonical")
    raw = raw_alerts_from(feed.read_feed(spark, f"{d}/events.parquet", EVENTS))
    out = feed.canonical_stream(raw).drop("event_time")
    return feed.run_to_parquet(out, f"{base}/checkpoint", f"{base}/rows")


@query
def stream_dedup(spark, d):
    """Every tenth alert arrives three times, once more in a later run, and is kept once."""
    base = scratch_path(spark, "stream-dedup")
    again = F.col("event_id").cast("long") % 10 == 0
    late = alerts(spark, d).filter(again & (F.to_date("timestamp") <= F.lit(T1_END).cast("date")))

    def run(events):
        rows = alerts_from_events(events)
        many = rows.withColumn("_c", F.explode(F.sequence(F.lit(1), F.when(again, 3).otherwise(1)))).drop("_c")
        feed.run_to_parquet(feed.dedup_stream(feed.with_event_time(many)).drop("event_time"),
                            f"{base}/checkpoint", f"{base}/rows")

    in_runs(spark, d, base, run)
    back = table(spark, d, "events").join(late.select(F.col("event_id").cast("long").alias("event_id")), "event_id", "left_semi")
    back.select(*EVENTS.fieldNames()).write.mode("append").parquet(f"{base}/feed")        # long past the watermark
    run(feed.read_feed(spark, f"{base}/feed", EVENTS))
    return spark.read.parquet(f"{base}/rows")


@query
def stream_recency(spark, d):
    """The feed arrives in three runs; recency continues over the restarts."""
    base = scratch_path(spark, "stream-recency")
    whole = alerts(spark, d)
    day = F.to_date("timestamp")
    first, second = F.lit(T1_END).cast("date"), F.lit(T2_END).cast("date")
    parts = [whole.filter(day <= first), whole.filter((day > first) & (day <= second)), whole.filter(day > second)]
    step = feed.recency_step(feed.VersionedState(f"{base}/state"), feed.batch_folder_sink(f"{base}/rows"))
    for part in parts:
        part.write.mode("append").parquet(f"{base}/feed")
        stream = feed.read_feed(spark, f"{base}/feed", ALERTS)
        feed.run_available(stream, f"{base}/checkpoint", step)
    return spark.read.parquet(f"{base}/rows").select("event_id", *r6("recency_s"))


@query
def stream_monitor(spark, d):
    base = scratch_path(spark, "stream-monitor")

    def run(events):
        rows = feed.with_event_time(alerts_from_events(events))
        level = rows.withColumn("anomaly_score", F.col("rule_level") / 15)
        agg = feed.monitor_stream(level, selected=F.col("rule_level") >= 8).select(
            F.col("window.start").cast("timestamp_ntz").alias("hour"), "agent", "alerts", "selected", "mean_score")
        feed.run_available(agg, f"{base}/checkpoint", feed.batch_folder_sink(f"{base}/rows"), mode="update")

    in_runs(spark, d, base, run)
    done = feed.latest_per_key(spark, f"{base}/rows", ["hour", "agent"])
    return done.select("hour", "agent", "alerts", "selected", *r6("mean_score"))


@query
def stream_enrich_topk(spark, d):
    """Validation window as a feed, scored by the formula frozen on T1, ten best per day."""
    base = scratch_path(spark, "stream-queue")
    model = formula.fit(window(spark, d, "T1"))

    def score(batch):
        return formula.score(batch, model).withColumn("anomaly_score", F.round("anomaly_score", 9))

    body = feed.daily_queue_step(f"{base}/queue", score, 10)
    in_runs(spark, d, base, lambda events: feed.run_available(
        split.window_rows(alerts_from_events(events), "T2", *BOUNDS), f"{base}/checkpoint", body))
    return feed.daily_queue(spark, f"{base}/queue").select(
        "day", F.col("rank").cast("long").alias("rank"), "event_id", *r6("anomaly_score"))


@query
def stream_features(spark, d):
    """Frozen features over a feed equal the batch features of the same window."""
    base = scratch_path(spark, "stream-features")
    stats = features.fit(window(spark, d, "T1"))
    step = feed.feature_step(stats, lambda df: df, feed.VersionedState(f"{base}/state"),
                             feed.enrichment_sink(f"{base}/rows"), hash_kind="md5")
    in_runs(spark, d, base, lambda events: feed.run_available(
        split.window_rows(alerts_from_events(events), "T2", *BOUNDS), f"{base}/checkpoint", step))
    out = spark.read.parquet(f"{base}/rows")
    return out.select("event_id", "agent", "rule_id", "rule_level", *INT_COLS, *r6(*REAL_COLS))
