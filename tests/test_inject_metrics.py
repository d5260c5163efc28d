import pytest
from pyspark.sql import functions as F

from sentrank.functions import payloads
from sentrank.operators import quality, explain, inject, metrics

BOUNDS = ("2024-01-10", "2024-01-11", "2024-01-14")


@pytest.fixture
def feed(alert_rows):
    rows = []
    for i in range(900):
        day = 1 + i % 16
        host = None if i % 97 == 0 else f"h{i % 4}"
        # h0 has seen every rule and decoder in the history; h3 is absent from it
        if host == "h3" and day <= 10:
            host = "h0"
        rows.append((f"{i:04d}", f"2024-01-{day:02d} {i % 24:02d}:30:00", host, f"r{(i // 16) % 9}", i % 6, f"d{(i // 16) % 4}"))
    return alert_rows(rows)


def test_weights_and_counts():
    shares = inject.family_weights("offhours:2, level_out:0, nonsense:9")
    assert shares == {"offhours": 0.5, "rule_new": 0.25, "decoder_new": 0.25, "level_out": 0.0}
    equal = inject.family_weights()
    assert sum(inject.family_counts(1000, 0.03, equal).values()) == 30
    assert inject.family_counts(1, 0.0, equal) == {"offhours": 1, "rule_new": 0, "decoder_new": 0, "level_out": 0}
    assert sum(inject.family_counts(50, 0.03, equal).values()) == 2      # 1.5 rounds half to even


def test_injected_properties(spark, feed):
    out = inject.inject(feed, *BOUNDS, rate=0.2, with_history=True).cache()
    window = out.filter("split = 'T2_synth'")
    n = window.count()
    assert n == feed.filter("to_date(timestamp) BETWEEN '2024-01-11' AND '2024-01-14'").count()
    assert window.filter("is_synth_anom = 1").count() == round(n * 0.2)
    assert window.filter("y_true_synth <> is_synth_anom OR y_mask_eval <> 1").count() == 0
    history = out.filter("split = 'T1'")
    assert history.filter("y_true_synth IS NOT NULL OR y_mask_eval <> 0 OR synth_usecase <> ''").count() == 0
    before = {r["event_id"]: r for r in feed.collect()}
    seen = {(r["agent"], r["rule_id"]) for r in history.collect()}
    seen_d = {(r["agent"], r["decoder"]) for r in history.collect()}
    vocab = {r["rule_id"] for r in feed.collect()}
    kinds = set()
    for r in window.collect():
        o = before[r["event_id"]]
        kind = r["synth_usecase"]
        kinds.add(kind)
        changed = {c for c in ("timestamp", "rule_id", "rule_level", "decoder") if r[c] != o[c]}
        if kind == "":
            assert not changed
        if kind == "offhours":
            assert changed <= {"timestamp"} and r["timestamp"].hour <= 6 and r["timestamp"].date() == o["timestamp"].date()
        if kind == "rule_new":
            assert changed <= {"rule_id"}
            if r["agent"] == "h0":
                assert r["rule_id"] not in vocab and r["rule_id"][0] == "9" and len(r["rule_id"]) == 8
            elif r["agent"] is not None:
                assert (r["agent"], r["rule_id"]) not in seen
        if kind == "decoder_new":
            assert changed <= {"decoder"} and (r["agent"] is None or (r["agent"], r["decoder"]) not in seen_d)
        if kind == "level_out":
            assert changed <= {"rule_level"} and 0 <= r["rule_level"] <= 15
            if r["agent"] == "h3":
                assert r["rule_level"] in (7, 8)          # unknown host: mean 3
    assert kinds == {"", *inject.FAMILIES}


def test_append_keeps_originals(spark, feed):
    out = inject.inject(feed, *BOUNDS, rate=0.1, mode="append")
    n = feed.filter("to_date(timestamp) BETWEEN '2024-01-11' AND '2024-01-14'").count()
    assert out.count() == n + round(n * 0.1)
    assert out.filter("is_synth_anom = 1 AND NOT endswith(event_id, '-synth')").count() == 0
    again = inject.inject(feed.repartition(11), *BOUNDS, rate=0.1, mode="append")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_empty_window(feed):
    with pytest.raises(ValueError):
        inject.inject(feed, "2025-01-01", "2025-01-02", "2025-01-03")


def test_salted_hosts_draw_the_same(spark, feed, monkeypatch):
    one = inject.inject(feed, *BOUNDS, rate=0.3).select("event_id", "rule_id").collect()
    monkeypatch.setattr(inject, "REQUESTS_PER_SALT", 1)
    assert sorted(one) == sorted(inject.inject(feed, *BOUNDS, rate=0.3).select("event_id", "rule_id").collect())


def test_unseen_gaps(spark, feed):
    hist = feed.filter("to_date(timestamp) <= '2024-01-10'")
    vocab = inject.vocabulary(feed, "rule_id")
    seen = inject.seen_pairs(hist, "rule_id")
    hosts = spark.createDataFrame([("h0",), ("h1",), ("new",)], "agent string")
    rows = inject.unseen_gaps(hosts, seen.join(hosts, "agent", "left_semi"), vocab, "rule_id").collect()
    have = {tuple(r) for r in seen.collect()}
    names = sorted(f"r{i}" for i in range(9))
    got = sorted((r["agent"], v) for r in rows for v in names if r["first"] <= v <= r["last"])
    assert got == sorted((h, v) for h in ("h0", "h1", "new") for v in names if (h, v) not in have)
    assert sum(r["n_values"] for r in rows) == len(got)
    assert [(r["first"], r["last"]) for r in rows if r["agent"] == "new"] == [(names[0], names[-1])]


@pytest.mark.parametrize("at_once", [2, 10_000])
def test_unseen_values_are_listed_one_by_one(spark, feed, monkeypatch, at_once):
    monkeypatch.setattr(inject, "GAP_PLACES", at_once)
    hist = feed.filter("to_date(timestamp) <= '2024-01-10'")
    vocab, seen = inject.vocabulary(feed, "rule_id"), inject.seen_pairs(hist, "rule_id")
    hosts = spark.createDataFrame([("h0",), ("h1",), ("new",)], "agent string")
    rows = inject.unseen_values(hosts, seen.join(hosts, "agent", "left_semi"), vocab, "rule_id").collect()
    have = {tuple(r) for r in seen.collect()}
    assert sorted(map(tuple, rows)) == sorted((h, f"r{i}") for h in ("h0", "h1", "new") for i in range(9) if (h, f"r{i}") not in have)


def test_unseen_candidates_is_the_whole_list(spark):
    from sentrank.plans.queries import all_queries, light_window

    got = sorted(map(tuple, all_queries()["unseen_candidates"](spark, "/root/testdata/sf0.001").select("agent", "rule_id").collect()))
    t1, t2 = (light_window(spark, "/root/testdata/sf0.001", w).select("agent", "rule_id").distinct().collect() for w in ("T1", "T2"))
    rules, seen = {r for _, r in t1 + t2}, set(map(tuple, t1))
    assert got == sorted((a, r) for a in {a for a, _ in t2} for r in rules if (a, r) not in seen) and got


def test_exactly_n_rows_with_shared_and_missing_ids(spark):
    """Families and samples count rows, whatever their ids."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "same").otherwise(F.col("id").cast("string")).alias("event_id"),
        F.to_timestamp_ntz(F.lit("2024-01-05")).alias("timestamp"), F.lit("h").alias("agent"),
        (F.col("id") % 7).cast("string").alias("rule_id"), (F.col("id") % 4).cast("int").alias("rule_level"), F.lit("d").alias("decoder"))
    whole = rows.unionByName(rows)          # every row twice
    for n in (1, 10, 777, 1799, 1800, 5000):
        picked = quality.uniform_sample(whole, n)
        assert picked.count() == min(n, 1800)
        assert picked.exceptAll(whole).count() == 0
    some = quality.uniform_sample(whole, 600)
    assert 100 < some.where("event_id IS NULL").count() < 500       # rows without id are drawn one by one
    counts = {"offhours": 101, "rule_new": 99, "decoder_new": 100, "level_out": 7}
    marked = inject.assign_families(whole, counts, 42)
    got = {r["synth_usecase"]: r["count"] for r in marked.groupBy("synth_usecase").count().collect()}
    assert got == {**counts, "": 1800 - 307}
    assert marked.drop("synth_usecase").exceptAll(whole).count() == 0


def test_published_metric_rows(spark):
    rows = metrics.figures_table(spark, [(37103, 1081, 372, 253), (37103, 1081, 25, 21), (37103, 1081, 50, 42)]).collect()
    r = rows[0]
    assert (round(r["precision"], 4), round(r["recall"], 4), round(r["lift"], 2), round(r["fpr"], 4)) == (0.6801, 0.2340, 23.34, 0.0033)
    assert [round(x["precision"], 2) for x in rows[1:]] == [0.84, 0.84] and round(rows[1]["lift"], 2) == 28.83


def test_budget_edges(spark):
    df = spark.createDataFrame([("a", 3.0, 1), ("b", 2.0, 0), ("c", None, 1)], "event_id string, anomaly_score double, y int")
    rows = metrics.budget_metrics(df, "y", ps=[0.01], ks=[2, 99]).orderBy("k").collect()
    assert [(r["k"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in rows] == [(1, 1, 0, 1, 1), (2, 1, 1, 1, 0), (3, 2, 1, 0, 0)]
    none = metrics.budget_metrics(df.withColumn("y", F.lit(0)), "y", ks=[1]).first()
    assert none["recall"] is None and none["lift"] is None and none["precision"] == 0.0


def test_labels_join_and_family_recall(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("h", 9.0)], "event_id string, anomaly_score double")
    labels = spark.createDataFrame([("a", 1, 1, "x"), ("b", 0, 1, ""), ("c", 1, 1, "y"), ("h", None, 0, "")],
                                   "event_id string, y_true_synth int, y_mask_eval int, synth_usecase string")
    joined = metrics.join_labels(scores, labels)
    assert joined.count() == 3
    got = {r["family"]: (r["positives"], r["hits"], r["recall"]) for r in metrics.metrics_by_family(
        joined, "y_true_synth", "synth_usecase", 2).collect()}
    assert got == {"x": (1, 1, 1.0), "y": (1, 0, 0.0)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (0.5,), (None,)], "anomaly_score double")
    assert {r["bin"]: r["alerts"] for r in metrics.score_histogram(df, 4).collect()} == {1: 1, 3: 1, 4: 2}
    flat = spark.createDataFrame([(2.0,), (2.0,)], "anomaly_score double")
    assert {r["bin"]: r["alerts"] for r in metrics.score_histogram(flat).collect()} == {1: 2}


def test_explanation_cells(spark):
    key = "delta_score_if_replaced_by_train_median"
    cells = [
        '{"top_features":[{"feature":"x","%s":0.12345},{"feature":"y","%s":"2"},{"feature":"z"},{"feature":"q","%s":1}]}' % (key, key, key),
        "{\\'top_features\\':[{\\'feature\\':\\'x\\',\\'%s\\':-1.5}]}" % key,
        "plain text", "  ", None, '{"top_features":[{"feature":"x","%s":"abc"}]}' % key, "[1,2]", '{"other":1}',
    ]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    v = payloads.parse_explanation(F.col("c"))
    got = [r[0] for r in df.select(payloads.summarise_explanation(v)).collect()]
    assert got == ["x:0.123, y:2.0, z:0", "x:-1.5", None, None, None, None, None, None]
    raw = [r[0] for r in df.select(F.try_variant_get(v, "$.raw", "string")).collect()]
    assert raw[2] == "plain text" and raw[0] is None and raw[3] is None


def test_context_flags(spark, alert_rows):
    hist = alert_rows([("1", "2024-01-01", "a", "r1", 1, "d1")])
    new = alert_rows([("2", "2024-01-02 03:00:00", "a", "r1", 12, "d1"), ("3", "2024-01-02 12:00:00", "b", "r1", 12, "d9")])
    got = {r["event_id"]: r["flags"] for r in explain.context_flags(new, hist).collect()}
    assert got == {"2": ["off-hours × high severity"], "3": ["new rule on this host", "new decoder on this host"]}
