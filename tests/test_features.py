import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrank.constants import CANONICAL, FEATURES
from sentrank.functions import hashing
from sentrank.operators import features
from sentrank.operators.quantiles import exact_quantiles, hex_cutoffs, rank_rows


def test_hash_vectors(spark):
    df = spark.createDataFrame([("a||b||2",), ("nan||nan||0",)], "k string")
    got = df.select(hashing.hash01("k").alias("h"), hashing.hash01_md5(F.col("k")).alias("m")).collect()
    assert got[0]["h"] == 0.8487055382804726 and got[1]["h"] == 0.6325838401989508
    assert got[0]["m"] == pytest.approx(0.459969943263561, abs=1e-15)


def test_recency_equals_plain_lag(spark, alert_rows):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        t = None if i % 37 == 0 else f"2024-01-{1 + rnd.randrange(3):02d} {rnd.randrange(24):02d}:{rnd.randrange(3):02d}:{rnd.randrange(2):02d}"
        rows.append((f"{i:04d}", t, None if i % 5 == 0 else f"a{rnd.randrange(3)}", "r", 1, "d"))
    df = alert_rows(rows)
    w = Window.partitionBy("agent").orderBy(F.col("timestamp").asc_nulls_last(), "event_id")
    plain = {r["event_id"]: r["s"] for r in df.withColumn(
        "s", F.col("timestamp").cast("timestamp").cast("double") - F.lag(
            F.col("timestamp").cast("timestamp").cast("double")).over(w)).collect()}
    got = {r["event_id"]: r["recency_s"] for r in features.recency(df).collect()}
    assert got == plain


def test_recency_continues_and_clips(spark, alert_rows):
    old = alert_rows([("1", "2024-01-01 10:00:00", "a", "r", 1, "d")])
    new = alert_rows([("2", "2024-01-01 09:00:00", "a", "r", 1, "d"), ("3", "2024-01-01 10:00:30", "a", "r", 1, "d"),
                      ("4", "2024-01-01 09:00:00", "b", "r", 1, "d")])
    got = {r["event_id"]: r["recency_s"] for r in features.recency(new, last_seen=features.last_seen(old)).collect()}
    assert got == {"2": 0.0, "3": 30.0, "4": None}


def sample(alert_rows):
    return alert_rows([
        ("1", "2024-01-06 03:04:05", "a", "r1", 4, "d"), ("2", "2024-01-06 03:05:05", "a", "r1", 8, "d"),
        ("3", "2024-01-08 15:00:00", "a", "r2", 6, "d"), ("4", "2024-01-08 16:00:00", "solo", "r1", 5, "d"),
        ("5", "2024-01-08 10:00:00", "flat", "r1", 5, "d"), ("6", "2024-01-08 11:00:00", "flat", "r1", 5, "d"),
        ("7", "2024-01-08 11:00:00", None, None, None, None),
    ])


def test_fit_statistics(spark, alert_rows):
    stats = features.fit(sample(alert_rows))
    hs = {r["agent"]: (r["mu"], r["sd"]) for r in stats["host_stats"].collect()}
    assert hs["a"] == (6.0, 2.0) and hs["solo"] == (5.0, 0.0) and hs["flat"] == (5.0, 0.0) and hs[None] == (None, 0.0)
    assert stats["globals"].first()[0] == 3600.0      # gaps 60, 215695, 3600
    freq = {(r["agent"], r["rule_id"], r["hour_bucket"]): r["cnt"] for r in stats["combo_freq"].collect()}
    assert freq[("a", "r1", 2)] == 2 and freq[(None, None, 10)] == 1


def test_apply_is_frozen_and_complete(spark, alert_rows):
    train = sample(alert_rows)
    stats = features.fit(train)
    new = alert_rows([("9", "2024-01-13 02:00:00", "a", "r1", 9, "d"), ("10", "2024-01-15 12:00:00", "ghost", "rx", 3, "d"),
                      ("11", None, None, None, None, None)])
    rows = {r["event_id"]: r for r in features.apply(new, stats).collect()}
    assert features.apply(new, stats).columns == [*CANONICAL, *[f for f in FEATURES if f != "rule_level"], "rule_time_since_last_host"]
    r = rows["9"]
    assert (r["hour_local"], r["is_off_hours"], r["day_of_week"], r["is_weekend"], r["hour_bucket"]) == (2, 1, 5, 1, 2)
    assert r["rule_level_z_host"] == 1.5 and r["offhours_x_rule_level_z"] == 1.5 and r["weekend_x_rule_level_z"] == 1.5
    assert r["rule_time_since_last_host"] == 3600.0 and r["recency_x_rule_level"] == pytest.approx(math.log1p(3600) * 9)
    assert r["agent_rule_hour_freq_log1p"] == pytest.approx(math.log1p(2))
    g = rows["10"]
    assert g["rule_level_z_host"] == 0.0 and g["agent_rule_hour_freq_log1p"] == 0.0
    n = rows["11"]
    assert (n["hour_local"], n["is_off_hours"], n["second_in_hour"]) == (0, 1, 0)
    assert n["offhours_x_rule_level"] is None and n["rule_level_z_host"] == 0.0
    assert n["agent_rule_hour_hash01"] == 0.6325838401989508
    # other validation rows do not change a row, and statistics do not see them
    alone = features.apply(new.filter("event_id = '10'"), stats).first()
    assert alone == g


def test_history_option(spark, alert_rows):
    train = sample(alert_rows)
    stats = features.fit(train)
    new = alert_rows([("9", "2024-01-08 15:00:10", "a", "r1", 9, "d")])
    assert features.apply(new, stats, history=train).first()["rule_time_since_last_host"] == 10.0


def test_numeric_feature_precedence(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3)], "s string, x int, y double, z int")
    assert features.numeric_features(df) == ["x", "y", "z"]
    assert features.numeric_features(df, ["y", "s", "q"]) == ["y"]
    assert features.numeric_features(df, ["y"], ["z", "none"]) == ["z"]
    assert features.numeric_features(df, ["q"], ["none"]) == ["x", "y", "z"]


def test_quantiles_narrowing_equals_builtin(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0.0, 0.0, rnd.random() * 1e6, rnd.gauss(0, 1)]), float(rnd.randrange(3)), None) for _ in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    slow, fast = exact_quantiles(df, ["a", "b"], probs, small_rows=0), exact_quantiles(df, ["a", "b"], probs)
    for c in ("a", "b"):
        assert slow[c] == pytest.approx(fast[c], rel=1e-12)
    assert exact_quantiles(df, ["c"], probs, small_rows=0)["c"] == [None] * 7


def test_hex_cutoffs(spark):
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"))
    keys = sorted(r[0] for r in df.collect())
    want = [keys[0], keys[9], keys[2999], None]
    assert hex_cutoffs(df, F.col("h"), [1, 10, 3000, 3001]) == want
    assert hex_cutoffs(df, F.col("h"), [1, 10, 3000, 3001], bound=1) == want


@pytest.mark.parametrize("group", [None, ["g"]])
def test_rank_rows_large_path(spark, group):
    rnd = random.Random(1)
    rows = [(f"{i:05d}", None if i % 50 == 0 else rnd.randrange(4), rnd.choice([1.0, 1.0, rnd.random(), None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, g int, s double").repartition(5)
    order = [F.col("s").desc_nulls_last(), F.col("id")]
    small = {r["id"]: r["rank"] for r in rank_rows(df, order, group).collect()}
    large = {r["id"]: r["rank"] for r in rank_rows(df, order, group, small_rows=0).collect()}
    assert small == large
