"""Registered queries that go through files: scans, stage tables, reports, labelled evaluation.

Each writes what it reads below the shared folder, derived from ``events``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DELTA_KEY, FEATURES
from ..fixtures import T2_END, T2_START, alerts, raw_alerts, raw_alerts_from, table
from ..functions import times
from ..operators import canonical, explain, features, formula, metrics, quality, rank
from ..operators.quantiles import rank_rows
from ..session import scratch_path, settle
from ..sinks import tables as sink
from ..sources import csv_scan
from ..sources import tables as source
from . import workflows
from .queries import BOUNDS, INT_COLS, REAL_COLS, query, r6, window

HEADER = ["_id", "_source.timestamp", "_source.agent.name", "_source.rule.id", "_source.rule.level"]


def write_exports(spark: SparkSession, d: str) -> str:
    """A folder of CSV exports: two headers, and lines that are too long or too short for theirs."""
    folder = scratch_path(spark, "exports")
    raw = raw_alerts(spark, d)
    number = F.substring("_id", 5, 10).cast("long")
    head = raw.select(*[F.col(f"`{c}`") for c in HEADER])
    head.where(number % 2 == 0).write.mode("append").option("header", "true").csv(folder)
    raw.where(number % 2 == 1).drop("_source.rule.level").write.mode("append").option("header", "true").csv(folder)
    cells = [F.col(f"`{c}`") for c in HEADER]
    quoted = F.concat(F.lit('"'), cells[1], F.lit('"'))
    long_ = F.concat_ws(",", cells[0], quoted, *cells[2:], F.lit("one"), F.lit("more"))
    short = F.concat_ws(",", F.concat(cells[0], F.lit("-short")), quoted)
    line = F.when(number % 3 == 0, long_).otherwise(short)
    raw.where(number % 50 == 0).select(line.alias(",".join(HEADER))).write.mode("append").option(
        "header", "true").option("sep", "\x01").option("quote", "\x02").csv(folder)
    return folder


@query
def csv_union_scan(spark, d):
    """Exports with differing headers: over-long lines dropped, short ones padded, columns united by name."""
    files = csv_scan.find_files(spark, write_exports(spark, d))
    return csv_scan.scan_union(spark, files)


@query
def merged_exports(spark, d):
    """The merge step as a table: time first, parsed; short lines without a host are kept."""
    out = workflows.merge(spark, write_exports(spark, d), scratch_path(spark, "merged"), dedupe=True)
    return out.select("_id", F.col("`_source.timestamp`").cast("string").alias("time_text"), F.col("`_source.agent.name`").alias("agent"))


@query
def profiled_exports(spark, d):
    """Coverage over files with differing headers, each column over the rows of files that have it."""
    done = workflows.profile(spark, write_exports(spark, d), scratch_path(spark, "profile"), min_pct=0.9,
                             denominator="present")
    kept = done["reduced"].columns
    return done["report"].select("column", "non_null", "total", "coverage", "zeros", F.col("column").isin(kept).alias("kept"))


@query
def clean_table(spark, d):
    """Raw to canonical through the cleaning step's table."""
    return workflows.clean(raw_alerts(spark, d), scratch_path(spark, "clean"))["alerts"]


@query
def typed_csv(spark, d):
    """Clean alerts as CSV, read back with types; times in the export format and in ISO."""
    path = scratch_path(spark, "typed")
    text = F.when(F.col("event_id").cast("long") % 2 == 0, times.format_export_time(F.col("timestamp"))).otherwise(
        times.format_iso_seconds(F.col("timestamp")))
    alerts(spark, d).withColumn("timestamp", text).write.option("header", "true").csv(path)
    return source.read_csv_typed(spark, path)


@query
def projected_scan(spark, d):
    """Only the named columns of a table, or all of them when one is missing."""
    path = sink.write_table(alerts(spark, d), scratch_path(spark, "projected"))
    some = source.read_parquet(spark, path, ["event_id", "agent"])
    every = source.read_parquet(spark, path, ["event_id", "absent"])
    return some.withColumns({"n_some": F.lit(len(some.columns)), "n_every": F.lit(len(every.columns))})


@query
def split_table(spark, d):
    """The validation window as one partition of the split table, and the rows counted on the way."""
    done = workflows.split_windows(alerts(spark, d), scratch_path(spark, "split"), *BOUNDS)
    counts = done["input_counts"].select(F.col("rows").alias("n_input"), "dropped_no_time")
    return done["T2"].select("event_id", "agent").join(F.broadcast(counts))


@query
def stored_statistics(spark, d):
    """Features from statistics that were frozen to tables and read back; the feature table as CSV and back."""
    stats = scratch_path(spark, "stats")
    workflows.fit_features(window(spark, d, "T1"), stats, scratch_path(spark, "t1"), hash_kind="md5")
    out = scratch_path(spark, "t2")
    sink.write_table(features.apply(window(spark, d, "T2"), source.read_stats(spark, stats), hash_kind="md5"), out, csv=True)
    back = source.read_features_csv(spark, f"{out}_csv")
    return back.select("event_id", "agent", "rule_id", "rule_level",
                       *[F.col(c).cast("int").alias(c) for c in INT_COLS], *r6(*REAL_COLS))


@query
def scored_table(spark, d):
    """Scored table, its Top-p table and the run's facts, latency included."""
    scorer = workflows.Scorer("formula", alerts(spark, d), FEATURES)
    done = workflows.score_top_p(alerts(spark, d), scorer, scratch_path(spark, "scored"), 0.01)
    run = done["run"].select((F.col("latency_s") > 0).alias("timed"), F.col("rows").alias("n_scored"),
                             F.col("selected").alias("n_selected"))
    return done["top"].agg(F.count("*").alias("n_top"), F.round(F.min("anomaly_score"), 6).alias("least_score")).join(
        F.broadcast(run))


@query
def service_reply(spark, d):
    """The service's answer as a CSV artifact."""
    path = scratch_path(spark, "reply")
    workflows.anomalies_top(alerts(spark, d), 50, out=path)
    back = source.read_csv_typed(spark, path, doubles=("anomaly_score",))
    return back.select(F.col("rank").cast("long").alias("rank"), "event_id", "rule_level", *r6("anomaly_score"))


def evaluated(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Injected window, scored by the formula over it, with its labels joined by event id."""
    done = workflows.inject_window(alerts(spark, d, light_hosts=True), scratch_path(spark, f"inject-{mode}"), *BOUNDS, mode=mode)
    rows = done["window"]
    scored = formula.score(rows.select(*alerts(spark, d).columns))
    scored = settle(scored.withColumn("anomaly_score", F.round("anomaly_score", 9)))
    return metrics.join_labels(scored, done["for_features"])


@query
def injected_metrics(spark, d):
    """Precision, recall and lift of injected anomalies (changed in place) at review budgets."""
    m = metrics.budget_metrics(evaluated(spark, d, "replace"), "y_true_synth", ps=[0.01, 0.02, 0.05])
    return m.select("p", "k", "tp", "fp", "fn", "tn", *r6("precision", "recall", "lift", "fpr"))


@query
def injected_families(spark, d):
    """Recall of each injected family (added as copies) in the hundred best."""
    m = metrics.metrics_by_family(evaluated(spark, d, "append"), "y_true_synth", "synth_usecase", 100)
    return m.select("family", "positives", "hits", *r6("recall"))


# --- the review screen and the choice of scores ------------------------------------

def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """A written table with the 1-based ``place`` of each row in the order of its files and rows."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_n"))
    return rank_rows(rows, [F.col("_f"), F.col("_n")], rank_col="place").drop("_f", "_n")


@query
def service_columns(spark, d):
    """The service's column choice: canonical names win, and the other time column is known."""
    raw = raw_alerts(spark, d).withColumnRenamed("_source.timestamp", "_source.@timestamp").withColumn(
        "agent", F.concat(F.lit("canon-"), F.col("`_source.agent.name`")))
    return canonical.canonicalise(raw, canonical.service_mapping(raw.columns))


@query
def strict_times(spark, d):
    """Export times with and without fraction and ISO times, by the lenient and by the strict parser."""
    number = F.col("event_id") % 3
    text = F.when(number == 0, times.format_export_time(F.col("ts"))).when(
        number == 1, F.date_format("ts", "MMM dd, yyyy '@' HH:mm:ss")).otherwise(times.format_iso_seconds(F.col("ts")))
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"), times.parse_export_time(text).alias("lenient"),
        times.parse_export_time(text, strict=True).alias("strict"))


@query
def long_examples(spark, d):
    """Coverage of text columns whose values are far longer than an example may be."""
    return quality.coverage_report(table(spark, d, "documents").select("text", "lang", "source")).drop("distinct_estimate")


@query
def sorted_table(spark, d):
    """The merged table's time order as it lies in its files, unreadable times last."""
    raw = raw_alerts(spark, d).withColumnRenamed("_source.timestamp", "_source.@timestamp")
    broken = F.substring("_id", 5, 10).cast("long") % 9 == 0
    raw = raw.withColumn("_source.@timestamp", F.when(broken, "no time").otherwise(F.col("`_source.@timestamp`")))
    path = sink.write_table(canonical.sort_by_time(canonical.normalise_time(raw)), scratch_path(spark, "sorted"))
    return in_file_order(spark, path).select("place", "_id")


def review(spark: SparkSession, d: str) -> str:
    """The review screen over the validation window, written below a new folder."""
    day = F.to_date("ts")
    events = table(spark, d, "events").where(day.between(F.lit(T2_START).cast("date"), F.lit(T2_END).cast("date")))
    train = window(spark, d, "T1").withColumns(times.calendar_features(F.col("timestamp")))
    scorer = workflows.Scorer("formula", train, ["rule_level", "hour_local", "no_such_column"])
    out = scratch_path(spark, "review")
    workflows.explain_top(raw_alerts_from(events), scorer, percent=0.5, explain_n=5, wanted=["second_in_hour"], out=out)
    return out


@query
def review_explanations(spark, d):
    """The explanation table of the review screen in the order it is written in."""
    return in_file_order(spark, f"{review(spark, d)}/explanations").select(
        "place", "rank", "event_id", "feature", *r6("score", "value", "baseline", "contribution"))


@query
def review_tables(spark, d):
    """Rows of the previews, the slice and the chart of the review screen."""
    out = review(spark, d)
    counts = [spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
              for name in ("alerts_preview", "features_preview", "top", "chart_features")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query
def top_reasons(spark, d):
    """The three strongest features of each of the ten highest alerts."""
    from .queries import knn_scored

    train, index, s = knn_scored(spark, d)
    long = explain.occlusion(rank.top_k(s, 10), FEATURES, explain.feature_medians(train, FEATURES),
                             explain.knn_scorer(index, FEATURES, 35))
    long = long.withColumn("abs_contribution", F.round("abs_contribution", 9))
    return explain.top_features(long, 3).select("rank", "event_id", F.col("place").cast("long").alias("place"), "feature",
                                                *r6("contribution"))


@query
def reason_entries(spark, d):
    """The reason payloads read back: features with their deltas and neighbour medians, and the flags."""
    from .queries import all_queries

    kind = f"top_features array<struct<feature:string,{DELTA_KEY}:double>>, context_flags array<string>, neighbor_medians map<string,double>"
    read = all_queries()["reason_payload"](spark, d).select("event_id", F.from_json("reason", kind).alias("r"))
    entries = read.select("event_id", "r", F.inline("r.top_features"))
    return entries.select(
        "event_id", "feature", F.round(DELTA_KEY, 6).alias("delta"), F.array_join("r.context_flags", "; ").alias("flags"),
        F.round(F.element_at("r.neighbor_medians", F.col("feature")), 6).alias("neighbor_median"))


@query
def model_runs(spark, d):
    """Each model scorer through the scoring step: rows scored and selected, and the least score that is selected."""
    from .queries import model_windows

    train, test = model_windows(spark, d)
    runs = None
    for kind, k in (("knn", 35), ("lof", 20), ("iforest", 0)):
        done = workflows.score_top_p(test, workflows.Scorer(kind, train, FEATURES, k=k, trees=40), scratch_path(spark, kind), 0.01)
        row = done["top"].agg(F.lit(kind).alias("kind"), F.round(F.min("anomaly_score"), 6).alias("least_score")).join(
            F.broadcast(done["run"].select(F.col("rows").alias("n_scored"), F.col("selected").alias("n_selected"))))
        runs = row if runs is None else runs.union(row)
    return runs


@query
def existing_scores(spark, d):
    """Scores that fall with anomaly, turned round, win over the formula in the service's answer."""
    rows = alerts(spark, d).withColumn("decision", -(F.col("rule_level") + F.hour("timestamp") / 100.0))
    scored = workflows.Scorer("column", rows, ["decision"], higher_is_anomalous=False)(rows)
    return workflows.anomalies_top(scored, 20).select("rank", "event_id", "rule_level", *r6("anomaly_score"))
