"""Whole steps as single calls: read, transform with the operators, write tables."""

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEATURES, REPLY_COLUMNS
from ..functions import payloads
from ..functions.numbers import oriented, to_double
from ..operators import (
    canonical, explain, features, forest, formula, inject, metrics, neighbors, quality, rank, split,
)
from ..session import settle
from ..sinks import tables as sink
from ..sources import csv_scan
from ..sources import tables as source


def merge(spark: SparkSession, folder: str, out: str, pattern: str = "*.csv*", dedupe: bool = False,
          csv: bool = False) -> DataFrame:
    """All exports of a folder as one time-sorted table over the union of their columns."""
    df = canonical.normalise_time(csv_scan.scan_union(spark, csv_scan.find_files(spark, folder, pattern)))
    if dedupe:
        df = canonical.dedup_rows(df)
    df = canonical.time_first(canonical.sort_by_time(df))
    sink.write_table(df, out, csv=csv)
    written = spark.read.parquet(out)
    if not written.limit(1).count():
        raise ValueError("the merged table is empty")
    return written


def profile(spark: SparkSession, folder: str, out: str, pattern: str = "*.csv*", min_pct: float = 0.85,
            top_n: int = 0, sample: int = 0, dedupe: bool = False, seed: int = 42,
            denominator: str = "all") -> dict[str, DataFrame]:
    """Coverage report, table of well-covered columns, and an optional uniform sample of it."""
    groups = []
    for i, g in enumerate(csv_scan.scan_groups(spark, csv_scan.find_files(spark, folder, pattern))):
        # text is parsed once; both passes then read only the columns they need
        sink.write_table(canonical.normalise_time(g), f"{out}_columns/{i}")
        groups.append(spark.read.parquet(f"{out}_columns/{i}"))
    report = settle(quality.coverage_report(groups, denominator))
    sink.write_table(report.orderBy(F.desc("coverage"), "column"), f"{out}_report", csv=True)
    keep = quality.select_columns(report, min_pct, top_n)
    if not keep:
        raise ValueError("no column reaches the coverage threshold")
    reduced = canonical.align_columns(csv_scan.union_by_name(groups), keep)
    if dedupe:
        reduced = canonical.dedup_rows(reduced)
    sink.write_table(canonical.sort_by_time(reduced), f"{out}_reduced")
    result = {"report": report, "reduced": spark.read.parquet(f"{out}_reduced")}
    if sample > 0:
        numbered = result["reduced"].select(
            "*", F.concat_ws("#", "_metadata.file_name", F.col("_metadata.row_index").cast("string")).alias("_row"))
        picked = quality.uniform_sample(numbered, sample, seed, key="_row").drop("_row")
        sink.write_table(picked, f"{out}_sample")
        result["sample"] = spark.read.parquet(f"{out}_sample")
    return result


def clean(raw: DataFrame, out: str, strict_time: bool = False) -> dict[str, DataFrame]:
    """Canonical table without repeated ids, plus the cleaning report."""
    mapping = canonical.clean_mapping(raw.columns)
    rows = canonical.dedup_keep_first(canonical.canonicalise(raw, mapping, strict_time))
    sink.write_table(rows, out)
    written = raw.sparkSession.read.parquet(out)
    report = quality.cleaning_report(raw, written, mapping, canonical.dropped_columns(raw.columns, mapping))
    sink.write_report(report, f"{out}_report")
    return {"alerts": written, "report": report}


def split_windows(alerts: DataFrame, out: str, cutoff: str, start: str, end: str,
                  time_column: str = "timestamp") -> dict[str, DataFrame]:
    """T1, T2 and T3 as partitions of one table, and their summary."""
    if time_column not in alerts.columns:
        raise ValueError(f"no time column {time_column!r}")
    watched, seen = quality.counted(alerts, "split_input", time_column)
    sink.write_splits(split.temporal_split(watched, cutoff, start, end, time_column), out)
    spark = alerts.sparkSession
    table = spark.read.parquet(out)
    parts = {s: table.filter(F.col("split") == s).drop("split") for s in ("T1", "T2", "T3")}
    summary = split.split_summary(table, time_column)
    sink.write_report(summary, f"{out}_summary")
    counts = spark.createDataFrame([(seen.get["rows"], seen.get["no_time"])], "rows long, dropped_no_time long")
    return {**parts, "summary": summary, "input_counts": counts}


def inject_window(alerts: DataFrame, out: str, cutoff: str, start: str, end: str, **options) -> dict[str, DataFrame]:
    """Labelled window, and the same behind its history for feature runs."""
    spark = alerts.sparkSession
    whole = inject.inject(alerts, cutoff, start, end, with_history=True, **options)
    sink.write_table(whole, f"{out}_for_features")
    table = spark.read.parquet(f"{out}_for_features")
    sink.write_table(table.filter("y_mask_eval = 1"), f"{out}_window")
    window = spark.read.parquet(f"{out}_window")
    return {"window": window, "for_features": table, "summary": inject.family_summary(window)}


def fit_features(train: DataFrame, stats_path: str, out: str, **options) -> DataFrame:
    """Freeze the statistics of the training window and write its features."""
    fit_options = {k: v for k, v in options.items() if k in ("keys", "hour_bucket_h")}
    sink.write_stats(features.fit(train, **fit_options), stats_path)
    return apply_features(train, stats_path, out, **options)


def apply_features(df: DataFrame, stats_path: str, out: str, **options) -> DataFrame:
    spark = df.sparkSession
    sink.write_table(features.apply(df, source.read_stats(spark, stats_path), **options), out)
    return spark.read.parquet(out)


@dataclass
class Scorer:
    """An explicit choice of scorer: ``knn``, ``lof``, ``iforest``, ``formula`` or ``column``.

    Forest, formula and the neighbour index are made on the first call and kept for the
    next ones. ``column`` takes scores that a model left in ``features[0]``; where they
    fall with anomaly, ``higher_is_anomalous=False`` turns them round.
    """

    kind: str
    train: DataFrame
    features: list[str]
    k: int = 35
    scale: bool = False
    trees: int = 600
    max_samples: float | int = 0.5
    higher_is_anomalous: bool = True
    _model: object = None

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.kind == "column":
            return df.withColumn("anomaly_score", oriented(to_double(F.col(f"`{self.features[0]}`")), self.higher_is_anomalous))
        df = df.drop("anomaly_score")
        if self.kind == "knn" and not self.scale:
            self._model = self._model or neighbors.build_index(self.train, self.features)
            return explain.knn_scorer(self._model, self.features, self.k)(df)
        if self.kind == "knn":
            return neighbors.knn_score(df, self.train, self.features, self.k, self.scale)
        if self.kind == "lof":
            return neighbors.lof_score(df, self.train, self.features, self.k, self.scale)
        if self.kind == "iforest":
            self._model = self._model or forest.fit(self.train, self.features, self.trees, self.max_samples)
            return forest.score(df, self._model)
        if self.kind == "formula":
            self._model = self._model or formula.fit(self.train)
            return formula.score(df, self._model)
        raise ValueError(f"unknown scorer {self.kind!r}")


def score_top_p(df: DataFrame, scorer: Scorer, out: str, p: float = 0.01, version: str = "") -> dict[str, DataFrame]:
    """Scored table, its Top-p slice and one row of run facts."""
    began, spark = time.time(), df.sparkSession
    sink.write_table(scorer(df), f"{out}_scored")
    scored = spark.read.parquet(f"{out}_scored")
    sink.write_table(rank.top_p(scored, p), f"{out}_top")
    top = spark.read.parquet(f"{out}_top")
    meta = metrics.run_metadata(scored, top.count(), version or scorer.kind, time.time() - began)
    sink.write_table(meta, f"{out}_run")
    return {"scored": scored, "top": top, "run": spark.read.parquet(f"{out}_run")}


def anomalies_top(df: DataFrame, k: int = 50, by: str = "anomaly_score", descending: bool = True,
                  out: str | None = None, max_k: int = 1000) -> DataFrame:
    """The service query: existing or formula score, Top-K, reason summary, reply columns."""
    if not 1 <= k <= max_k:
        raise ValueError(f"k must be within 1..{max_k}")
    if by == "anomaly_score" and descending:
        top = formula.top_k_by_formula(df, k)
    else:
        top = rank.top_k(formula.ensure_score(df), k, by, descending)
    if "explanations" in top.columns:
        top = top.withColumn("reason_summary", payloads.summarise_explanation(
            payloads.parse_explanation(F.col("explanations"))))
    reply = canonical.pick_columns(top, [*REPLY_COLUMNS, "reason_summary"])
    if out:
        reply.coalesce(1).orderBy("rank").write.mode("overwrite").option("header", "true").csv(out)
    return reply


def json_reply(reply: DataFrame) -> list[str]:
    """At most ``max_k`` rows of a reply as JSON texts in rank order."""
    ordered = reply.select("rank", payloads.json_record(reply).alias("r")).orderBy("rank")
    return [row["r"] for row in ordered.collect()]


def explain_top(
    raw: DataFrame, scorer: Scorer, percent: float = 1.0, explain_n: int = 10,
    wanted: list[str] | None = None, out: str | None = None,
) -> dict[str, DataFrame]:
    """The review screen: canonicalise, features on the batch, score, slice, histogram, explanations.

    Occlusion baselines are training medians; scorer features win over ``wanted``.
    """
    mapping = canonical.service_mapping(raw.columns)
    alerts = canonical.dedup_keep_first(canonical.drop_null_time(canonical.canonicalise(raw, mapping)))
    alerts = settle(alerts)
    feats = features.fit_apply(alerts)
    chosen = features.numeric_features(feats, wanted or FEATURES, scorer.features)
    chosen_scorer = replace(scorer, features=chosen, _model=None)
    scored = settle(chosen_scorer(feats))
    top = settle(rank.top_p(scored, percent, percent=True))
    result = {
        "alerts_preview": sink.preview(alerts), "features_preview": sink.preview(feats),
        "scored": scored, "top": top, "histogram": metrics.score_histogram(scored),
    }
    if explain_n > 0:
        head = top.filter(F.col("rank") <= explain_n)
        baseline = explain.feature_medians(scorer.train, chosen)
        long = explain.occlusion(head, chosen, baseline, chosen_scorer)
        result["explanations"] = explain.sorted_explanations(long)
        result["chart_features"] = explain.top_features(long, 10)
    if out:
        for name, df in result.items():
            sink.write_table(df, f"{out.rstrip('/')}/{name}", csv=True)
    return result
