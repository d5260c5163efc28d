import datetime as dt

from pyspark.sql import functions as F

from sentrank.operators import features
from sentrank.schema import ALERTS
from sentrank.streaming import alerts as feed


def drop(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_recency_over_batches_and_late_rows(spark, alert_rows, tmp_path):
    p = str(tmp_path)
    step = feed.recency_step(feed.VersionedState(f"{p}/state"), feed.batch_folder_sink(f"{p}/rows"))
    batches = [
        [("1", "2024-01-01 10:00:00", "a", "r", 1, "d"), ("2", "2024-01-01 10:00:10", "a", "r", 1, "d")],
        [("3", "2024-01-01 10:01:00", "a", "r", 1, "d"), ("4", "2024-01-01 09:00:00", "a", "r", 1, "d"),
         ("5", "2024-01-01 10:00:00", "b", "r", 1, "d")],
        [("6", "2024-01-01 10:00:30", "b", "r", 1, "d"), ("7", None, "b", "r", 1, "d")],
    ]
    for rows in batches:
        drop(alert_rows(rows), f"{p}/feed")
        feed.run_available(feed.read_feed(spark, f"{p}/feed", ALERTS), f"{p}/cp", step)
    got = {r["event_id"]: r["recency_s"] for r in spark.read.parquet(f"{p}/rows").collect()}
    assert got == {"1": None, "2": 10.0, "3": 50.0, "4": 0.0, "5": None, "6": 30.0, "7": None}
    # a batch that is run again writes the same rows and state
    again = spark.read.parquet(f"{p}/rows/batch=1").count()
    step(alert_rows(batches[1]), 1)
    assert spark.read.parquet(f"{p}/rows/batch=1").count() == again
    assert spark.read.parquet(f"{p}/state/v=1").filter("agent = 'a'").first()["last_ts"] == dt.datetime(2024, 1, 1, 10, 1)


def test_stream_equals_batch_on_ordered_input(spark, alert_rows, tmp_path):
    p = str(tmp_path)
    rows = [(f"{i:03d}", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", f"a{i % 3}", "r", 1, "d") for i in range(200)]
    step = feed.recency_step(feed.VersionedState(f"{p}/state"), feed.batch_folder_sink(f"{p}/rows"))
    for s in range(0, 200, 70):
        drop(alert_rows(rows[s:s + 70]), f"{p}/feed")
        feed.run_available(feed.read_feed(spark, f"{p}/feed", ALERTS), f"{p}/cp", step)
    got = {r["event_id"]: r["recency_s"] for r in spark.read.parquet(f"{p}/rows").collect()}
    assert got == {r["event_id"]: r["recency_s"] for r in features.recency(alert_rows(rows)).collect()}


def test_dedup_across_batches_and_late_drop(spark, alert_rows, tmp_path):
    p = str(tmp_path)

    def run():
        stream = feed.with_event_time(feed.read_feed(spark, f"{p}/feed", ALERTS))
        return feed.run_to_parquet(feed.dedup_stream(stream).drop("event_time"), f"{p}/cp", f"{p}/rows")

    drop(alert_rows([("1", "2024-01-01 10:00:00", "a", "r", 1, "d")] * 5 + [("2", "2024-01-01 13:00:00", "a", "r", 1, "d")]), f"{p}/feed")
    run()
    drop(alert_rows([("2", "2024-01-01 13:00:00", "a", "r", 1, "d"), ("3", "2024-01-01 09:00:00", "a", "r", 1, "d"),
                     ("4", "2024-01-01 13:10:00", "a", "r", 1, "d")]), f"{p}/feed")
    got = sorted(r["event_id"] for r in run().collect())
    assert got == ["1", "2", "4"]              # 3 is behind the watermark


def test_copies_are_folded_before_the_state(spark, alert_rows):
    rows = alert_rows([("1", "2024-01-01 10:00:00", "a", "r", 1, "d")] * 500 + [("1", "2024-01-01 11:00:00", "a", "r", 1, "d")] * 3
                      + [(None, None, "a", "r", 1, "d")] * 4 + [("2", None, "b", "r", 2, "d")])
    some = feed.with_event_time(rows).coalesce(1)
    left = some.mapInArrow(feed._first_of_copies, some.schema).collect()
    assert sorted((r["event_id"] or "", str(r["timestamp"])) for r in left) == [
        ("", "None"), ("1", "2024-01-01 10:00:00"), ("1", "2024-01-01 11:00:00"), ("2", "None")]


def test_daily_queue_merges_batches(spark, alert_rows, tmp_path):
    p = str(tmp_path)
    queue = f"{p}/queue"
    body = feed.daily_queue_step(queue, lambda df: df.withColumn("anomaly_score", F.col("rule_level") / 1.0), 2)
    for rows in ([("1", "2024-01-01", "a", "r", 5, "d"), ("2", "2024-01-01", "a", "r", 3, "d")],
                 [("3", "2024-01-01", "a", "r", 4, "d"), ("4", "2024-01-02", "a", "r", 1, "d")]):
        drop(alert_rows(rows), f"{p}/feed")
        feed.run_available(feed.read_feed(spark, f"{p}/feed", ALERTS), f"{p}/cp", body)
    got = {(str(r["day"]), r["rank"]): r["event_id"] for r in feed.daily_queue(spark, queue).collect()}
    assert got == {("2024-01-01", 1): "1", ("2024-01-01", 2): "3", ("2024-01-02", 1): "4"}


def test_alerts_without_time_have_a_queue(spark, alert_rows, tmp_path):
    p = str(tmp_path)
    body = feed.daily_queue_step(f"{p}/queue", lambda df: df.withColumn("anomaly_score", F.col("rule_level") / 1.0), 2)
    for rows in ([("1", None, "a", "r", 5, "d"), ("2", "2024-01-01", "a", "r", 3, "d")],
                 [("3", None, "a", "r", 4, "d")], [("4", None, "a", "r", 7, "d")]):
        drop(alert_rows(rows), f"{p}/feed")
        feed.run_available(feed.read_feed(spark, f"{p}/feed", ALERTS), f"{p}/cp", body)
    got = {(str(r["day"]), r["rank"]): r["event_id"] for r in feed.daily_queue(spark, f"{p}/queue").collect()}
    assert got == {("None", 1): "4", ("None", 2): "1", ("2024-01-01", 1): "2"}


def test_silent_hosts_are_forgotten(spark, alert_rows, tmp_path):
    p = str(tmp_path)
    step = feed.recency_step(feed.VersionedState(f"{p}/state"), feed.batch_folder_sink(f"{p}/rows"), expire="2 days")
    for rows in ([("1", "2024-01-01", "a", "r", 1, "d"), ("2", "2024-01-03", "b", "r", 1, "d")],
                 [("3", "2024-01-04", "b", "r", 1, "d")], [("4", "2024-01-05", "a", "r", 1, "d"), ("5", "2024-01-05", "b", "r", 1, "d")]):
        drop(alert_rows(rows), f"{p}/feed")
        feed.run_available(feed.read_feed(spark, f"{p}/feed", ALERTS), f"{p}/cp", step)
    got = {r["event_id"]: r["recency_s"] for r in spark.read.parquet(f"{p}/rows").collect()}
    assert got == {"1": None, "2": None, "3": 86400.0, "4": None, "5": 86400.0}
    sizes = [spark.read.parquet(f"{p}/state/v={v}").count() for v in (0, 1, 2)]
    assert sizes == [2, 1, 2]


def test_enrichment_with_frozen_model(spark, alert_rows, tmp_path):
    from sentrank.operators import formula

    p = str(tmp_path)
    rows = [(f"{i:03d}", f"2024-01-0{1 + i % 4} {i % 24:02d}:00:00", f"a{i % 3}", f"r{i % 4}", i % 9, "d") for i in range(80)]
    train = alert_rows(rows)
    stats, model = features.fit(train), formula.fit(train)
    drop(train, f"{p}/feed")
    step = feed.feature_step(stats, lambda df: formula.score(df, model), feed.VersionedState(f"{p}/state"),
                             feed.enrichment_sink(f"{p}/rows", ["event_id", "anomaly_score", "agent_rule_hour_hash01"]))
    feed.run_available(feed.read_feed(spark, f"{p}/feed", ALERTS), f"{p}/cp", step)
    got = {r["event_id"]: r for r in spark.read.parquet(f"{p}/rows").collect()}
    want = {r["event_id"]: r["anomaly_score"] for r in formula.score(train, model).collect()}
    assert {k: v["anomaly_score"] for k, v in got.items()} == want
    hashes = {r["event_id"]: r["agent_rule_hour_hash01"] for r in features.apply(train, stats).collect()}
    assert {k: v["agent_rule_hour_hash01"] for k, v in got.items()} == hashes
