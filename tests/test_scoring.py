import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrank.functions import numbers
from sentrank.operators import explain, forest, formula, neighbors, rank
from sentrank.plans import workflows

NAMES = ["a", "b", "c"]


def cloud(spark, n, seed, prefix, copies=0):
    """Numeric rows with ties; ``copies`` repeats one vector many times."""
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(size=(n, 3)) * [100, 1, 0.01], 3)
    if copies:
        x[:copies] = x[0]
    rows = [(f"{prefix}{i:04d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "event_id string, a double, b double, c double"), x


@pytest.mark.parametrize("block_rows,copies,k", [(16, 0, 5), (64, 150, 7), (2048, 0, 35), (8, 300, 40)])
def test_knn_equals_brute_force(spark, block_rows, copies, k):
    train, t = cloud(spark, 400, 1, "t", copies)
    query, q = cloud(spark, 60, 2, "q", 20)
    index = neighbors.build_index(train, NAMES, block_rows)
    near = {r["event_id"]: r for r in neighbors.knn_join(query, index, NAMES, k, query_block_rows=16).collect()}
    assert len(near) == 60
    for i, row in enumerate(q):
        want = np.sort(np.sqrt(((t - row) ** 2).sum(axis=1)))[:k]
        got = near[f"q{i:04d}"]
        assert got["dists"] == pytest.approx(want, abs=1e-9)
        assert len(got["neighbors"]) == k


@pytest.mark.parametrize("cells,block_rows,k", [(1, 16, 5), (3, 8, 40), (7, 4, 1)])
def test_knn_with_cells_of_many_blocks(spark, monkeypatch, cells, block_rows, k):
    """A bound on the number of cells leads to more blocks per cell, not to other results or to visits of all blocks."""
    monkeypatch.setattr(neighbors, "MAX_CELLS", cells)
    train, t = cloud(spark, 400, 1, "t", 30)
    query, q = cloud(spark, 60, 2, "q", 20)
    index = neighbors.build_index(train, NAMES, block_rows)
    assert index.boxes.count() > cells and index.rows.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= block_rows
    near = {r["event_id"]: r["dists"] for r in neighbors.knn_join(query, index, NAMES, k, query_block_rows=16).collect()}
    for i, row in enumerate(q):
        want = np.sort(np.sqrt(((t - row) ** 2).sum(axis=1)))[:k]
        assert near[f"q{i:04d}"] == pytest.approx(want, abs=1e-9)


def test_knn_far_query_and_too_many_neighbors(spark):
    train, t = cloud(spark, 200, 1, "t")
    query = spark.createDataFrame([("q", 1e7, -1e5, 3.0), ("n", None, float("nan"), 0.0)],
                                  "event_id string, a double, b double, c double")
    index = neighbors.build_index(train, NAMES, 16)
    near = {r["event_id"]: r["dists"] for r in neighbors.knn_join(query, index, NAMES, 3).collect()}
    want = np.sort(np.sqrt(((t - np.array([1e7, -1e5, 3.0])) ** 2).sum(axis=1)))[:3]
    assert near["q"] == pytest.approx(want, rel=1e-12)
    assert near["n"] == pytest.approx(np.sort(np.sqrt((t ** 2).sum(axis=1)))[:3])
    with pytest.raises(ValueError):
        neighbors.knn_join(query, index, NAMES, 201)


@pytest.mark.parametrize("copies", [0, 30])
def test_lof_equals_brute_force(spark, copies):
    train, t = cloud(spark, 150, 1, "t", copies)
    query, q = cloud(spark, 25, 2, "q")
    k = 6
    d = np.sqrt(((t[:, None] - t[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    kdist = np.take_along_axis(d, order, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, order, 1), kdist[order]).mean(axis=1) + 1e-10)
    dq = np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2))
    oq = np.argsort(dq, axis=1, kind="stable")[:, :k]
    lq = 1 / (np.maximum(np.take_along_axis(dq, oq, 1), kdist[oq]).mean(axis=1) + 1e-10)
    want = lrd[oq].mean(axis=1) / lq
    got = {r["event_id"]: r["anomaly_score"] for r in neighbors.lof_score(query, train, NAMES, k, block_rows=16).collect()}
    assert [got[f"q{i:04d}"] for i in range(25)] == pytest.approx(list(want), rel=1e-6)


def test_forest_split_paths_agree_and_rank_outliers(spark):
    train, _ = cloud(spark, 600, 1, "t", 100)
    query = spark.createDataFrame([("in", 0.0, 0.0, 0.0), ("out", 900.0, 9.0, 0.09)],
                                  "event_id string, a double, b double, c double")
    kw = dict(trees=30, max_samples=128, seed=7)
    one = forest.fit(train, NAMES, **kw)
    many = forest.fit(train.repartition(7), NAMES, **kw, task_vectors=30)
    nodes = lambda m: sorted(map(tuple, m.nodes.select("tree", "node", "feature", F.round("path", 9)).collect()))
    assert nodes(one) == nodes(many)
    a = {r["event_id"]: r["anomaly_score"] for r in forest.score(query, one).collect()}
    b = {r["event_id"]: r["anomaly_score"] for r in forest.score(query, one, broadcast_nodes=200).collect()}
    assert a == pytest.approx(b) and a["out"] > 0.6 > 0.55 > a["in"]


def test_forest_bootstrap_size(spark):
    train, _ = cloud(spark, 500, 1, "t", 300)
    names = [f"f{i}" for i in range(3)]
    vectors = neighbors.distinct_vectors(train, NAMES)
    for share, trees in ((0.5, 40), (0.02, 200)):
        n = forest._members(vectors, names, trees, share, 3).groupBy("tree").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
        assert n == pytest.approx(500 * share, rel=0.1)


def test_topk_order_ties_and_nulls(spark):
    df = spark.createDataFrame([("d", 1.0), ("c", 2.0), ("b", 2.0), ("a", None)], "event_id string, anomaly_score double")
    ids = lambda x: [r["event_id"] for r in x.orderBy("rank").collect()]
    assert ids(rank.top_k(df, 2)) == ["b", "c"]
    assert ids(rank.top_k(df, 9)) == ["b", "c", "d", "a"]
    assert ids(rank.top_k(df, 9, descending=False)) == ["d", "b", "c", "a"]
    assert ids(rank.top_k(df, 2, by="event_id", descending=False)) == ["a", "b"]
    with pytest.raises(ValueError):
        rank.top_k(df, 5, by="nope")
    with pytest.raises(ValueError):
        rank.top_k(df, 0)


def test_slice_sizes():
    assert rank.slice_size(37103, 0.01) == 372 and rank.slice_size(10, 0.01) == 1
    assert rank.slice_size(100, 0.07) == 8                      # binary floats, on purpose
    assert rank.slice_size(50, 7) == 50 and rank.slice_size(10**6, 0) == 100
    assert rank.slice_size_percent(37103, 1.0) == 372 and rank.slice_size_percent(100, 500) == 100


def test_large_slices_equal_small_ones(spark, monkeypatch):
    rnd = random.Random(4)
    df = spark.createDataFrame([(f"{i:05d}", rnd.choice([0.5, 0.5, rnd.random()])) for i in range(4000)],
                               "event_id string, anomaly_score double")
    want = {(r["rank"], r["event_id"]) for r in rank.top_p(df, 0.3).collect()}
    monkeypatch.setattr(rank, "LIMIT_ROWS", 10)
    assert {(r["rank"], r["event_id"]) for r in rank.top_p(df, 0.3).collect()} == want


def test_per_day_slices(spark, alert_rows):
    rows = [(f"{i:04d}", f"2024-01-{1 + i % 3:02d} 10:00:00", "a", "r", i % 15, "d") for i in range(330)]
    df = alert_rows(rows).withColumn("anomaly_score", F.col("rule_level").cast("double"))
    small = {(r["day"], r["rank"], r["event_id"]) for r in rank.top_p_per_day(df, 0.1).collect()}
    large = {(r["day"], r["rank"], r["event_id"]) for r in rank.top_p_per_day(df, 0.1, small_rows=0).collect()}
    assert small == large and len(small) == 3 * 11
    k = rank.top_k_per_day(df, 11)
    assert {(r["day"], r["rank"], r["event_id"]) for r in k.collect()} == small


def test_formula_nulls_and_missing_columns(spark, alert_rows):
    df = alert_rows([("1", "2024-01-01 10:00:00", "a", None, None, "d"), ("2", None, "a", None, 4, "d"),
                     ("3", "2024-01-01 03:00:00", None, "r", 8, "d")])
    level = np.array([0.0, 4.0, 8.0])
    z = (level - level.mean()) / level.std()
    s = 0.5 * z + np.array([0, 1, 1]) + 2.0 / (1 + np.array([0, 0, 1]))
    want = (s - s.min()) / (s.max() - s.min() + 1e-9)
    got = [r["anomaly_score"] for r in formula.score(df).orderBy("event_id").collect()]
    assert got == pytest.approx(list(want))
    only = formula.score(df.select("event_id", "rule_level")).orderBy("event_id").collect()
    assert [r["anomaly_score"] for r in only] == pytest.approx(list((z - z.min()) / (z.max() - z.min() + 1e-9 * 2)), abs=1e-6)
    same = formula.score(df.select("event_id")).collect()
    assert {r["anomaly_score"] for r in same} == {0.0}


def test_formula_topk_shortcut_equals_full_scoring(spark, alert_rows):
    rnd = random.Random(9)
    df = alert_rows([(f"{i:04d}", f"2024-01-01 {rnd.randrange(24):02d}:00:00", f"a{rnd.randrange(3)}",
                      rnd.choice(["r1", "r1", f"x{rnd.randrange(300)}"]), rnd.randrange(15), "d") for i in range(800)])
    for k in (1, 7, 100, 800, 1000):
        want = [(r["rank"], r["event_id"]) for r in rank.top_k(formula.score(df), k).orderBy("rank").collect()]
        got = [(r["rank"], r["event_id"]) for r in formula.top_k_by_formula(df, k).orderBy("rank").collect()]
        assert got == want


def test_label_words(spark):
    words = ["3.5", "Anomaly", "network ATTACK", "normal", "novelty", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(numbers.label_to_score(F.col("w"))).collect()] == [3.5, 1.0, 1.0, 0.0, 1.0, None]
    assert df.limit(1).select(numbers.oriented(F.lit(2.0), False)).first()[0] == -2.0


def test_service_reply(spark, alert_rows, tmp_path):
    cell = '{"top_features":[{"feature":"x","delta_score_if_replaced_by_train_median":0.5}]}'
    df = alert_rows([(f"{i}", f"2024-01-01 0{i}:00:00", "a", "r", i, "d") for i in range(8)])
    reply = workflows.anomalies_top(df, 3, out=str(tmp_path / "top"))
    assert reply.columns == ["rank", "event_id", "timestamp", "agent", "rule_id", "decoder", "rule_level", "anomaly_score"]
    scored = df.withColumn("anomaly_score", F.col("rule_level") / -1.0).withColumn(
        "explanations", F.when(F.col("event_id") == "0", F.lit(cell)))
    rows = workflows.anomalies_top(scored, 2).orderBy("rank").collect()
    assert [r["event_id"] for r in rows] == ["0", "1"] and [r["reason_summary"] for r in rows] == ["x:0.5", None]
    texts = workflows.json_reply(reply)
    assert len(texts) == 3 and '"timestamp":"2024-01-01T' in texts[0]
    asc = workflows.anomalies_top(df, 2, by="rule_level", descending=False).orderBy("rank").collect()
    assert [r["event_id"] for r in asc] == ["0", "1"]
    with pytest.raises(ValueError):
        workflows.anomalies_top(df, 1001)


def test_occlusion_against_brute_force(spark):
    train, t = cloud(spark, 120, 1, "t")
    query, q = cloud(spark, 4, 2, "q")
    top = query.withColumns({"rank": F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("event_id")),
                             "agent": F.lit("a")})
    base = explain.feature_medians(train, NAMES)
    assert base == pytest.approx(dict(zip(NAMES, np.median(t, axis=0))))
    scorer = explain.knn_scorer(neighbors.build_index(train, NAMES, 32), NAMES, 5)
    rows = explain.occlusion(top, NAMES, base, scorer).collect()
    assert len(rows) == 12
    mean = lambda x: np.sort(np.sqrt(((t - x) ** 2).sum(axis=1)))[:5].mean()
    for r in rows:
        x = q[int(r["event_id"][1:])].copy()
        j = NAMES.index(r["feature"])
        full = mean(x)
        assert r["value"] == x[j] and r["baseline"] == pytest.approx(base[r["feature"]])
        x[j] = base[r["feature"]]
        assert r["contribution"] == pytest.approx(full - mean(x), abs=1e-9) and r["score"] == pytest.approx(full)
    best = explain.top_features(explain.occlusion(top, NAMES, base, scorer), 1).collect()
    assert len(best) == 4 and all(r["place"] == 1 for r in best)


@pytest.mark.parametrize("kind", ["knn", "lof", "iforest", "formula"])
def test_scorer_choice(spark, alert_rows, tmp_path, kind):
    from sentrank.operators import features

    rows = [(f"{i:03d}", f"2024-01-{1 + i % 9:02d} {i % 24:02d}:{i % 60:02d}:00", f"a{i % 3}", f"r{i % 5}", 1 + i % 7, "d")
            for i in range(120)]
    df = alert_rows(rows)
    feats = features.fit_apply(df)
    scorer = workflows.Scorer(kind, feats, ["rule_level", "hour_local"], k=3, trees=10)
    done = workflows.score_top_p(feats, scorer, str(tmp_path / kind), 0.05)
    assert done["scored"].count() == 120 and done["top"].count() == 6
    assert done["scored"].filter("anomaly_score IS NULL").count() == 0
    facts = done["run"].first()
    assert facts["rows"] == 120 and facts["selected"] == 6 and facts["selection_rate"] == 0.05


def test_review_screen(spark, alert_rows, tmp_path):
    from sentrank.operators import features

    rows = [(f"{i:03d}", f"2024-01-{1 + i % 9:02d} {i % 24:02d}:{i % 60:02d}:00", f"a{i % 3}", f"r{i % 5}", 1 + i % 7, "d")
            for i in range(90)]
    train = features.fit_apply(alert_rows(rows))
    chosen = ["rule_level", "hour_local", "rule_level_z_host"]
    raw = alert_rows([*rows, ("900", None, "a", "r", 3, "d"), ("001", "2024-02-01", "a", "r", 3, "d")])
    got = workflows.explain_top(raw, workflows.Scorer("knn", train, chosen, k=4), 5.0, 2, out=str(tmp_path / "out"))
    assert got["scored"].count() == 90 and got["top"].count() == 5
    assert got["explanations"].count() == 2 * 3 and got["alerts_preview"].count() == 50
    assert got["histogram"].agg(F.sum("alerts")).first()[0] == 90
