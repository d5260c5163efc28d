import math

import duckdb
import pytest
from pyspark.sql import functions as F

from sentrank.constants import FEATURES
from sentrank.operators import forest
from sentrank.plans import queries

SF = "/root/testdata/sf0.001"
WALK = """
WITH RECURSIVE walk AS (
    SELECT q.event_id, n.tree, n.node, n.feature, n.threshold, n.path, q.x
    FROM rows q, nodes n WHERE n.node = 1
    UNION ALL
    SELECT w.event_id, n.tree, n.node, n.feature, n.threshold, n.path, w.x
    FROM walk w JOIN nodes n ON n.tree = w.tree
        AND n.node = 2 * w.node + CASE WHEN w.x[w.feature + 1] > w.threshold THEN 1 ELSE 0 END
    WHERE w.feature >= 0)
SELECT event_id, sum(path) FILTER (feature < 0) AS paths, count(*) FILTER (feature < 0) AS leaves FROM walk GROUP BY event_id
"""


def test_query_walks_the_published_forest(spark, monkeypatch):
    """iforest_score fits the defaults, and every row has the score that DuckDB reads off the settled nodes."""
    fits, fit = [], forest.fit

    def kept(*args, **kwargs):
        fits.append((args[0], fit(*args, **kwargs)))
        return fits[-1][1]

    monkeypatch.setattr(forest, "fit", kept)
    windows, made = queries.model_windows, []
    monkeypatch.setattr(queries, "model_windows", lambda s, d: made.append(windows(s, d)) or made[-1])
    got = {r["event_id"]: r["anomaly_score"] for r in queries.iforest_score(spark, SF).collect()}
    (train, model), = fits
    assert model.trees == 600 and model.sample == train.count() // 2
    assert model.nodes.filter("node = 1").count() == 600
    rows = made[0][1].select("event_id", F.array(*forest.matrix(made[0][1], FEATURES)).alias("x")).toArrow()  # noqa: F841
    nodes = model.nodes.toArrow()  # noqa: F841
    scale = float(forest.average_path(model.sample))
    want = duckdb.sql(WALK).fetchall()
    assert len(want) == len(got) > 0
    for name, paths, leaves in want:
        assert leaves == 600
        assert got[name] == pytest.approx(2 ** (-paths / 600 / scale), abs=1e-6)


def test_whole_trees_equal_shuffled_ones(spark):
    """Trees grown from sent vectors and from shuffled samples have the same nodes, for rare and for heavy vectors."""
    rows = [(f"e{i}", float(i % 37), float(i * i % 101), 1.0 if i % 3 else float(i)) for i in range(900)]
    rows += [(f"h{i}", 5.0, 5.0, 5.0) for i in range(300)]
    train = spark.createDataFrame(rows, "event_id string, a double, b double, c double")
    for share in (0.5, 40):
        one, other = (forest.fit(train, ["a", "b", "c"], 30, share, 0.8, 7, most).nodes for most in (10_000, 60))
        assert one.count() == other.count() > 0
        assert one.exceptAll(other).count() == 0


def test_large_forests_keep_samples_and_models_off_the_driver(spark, monkeypatch):
    """Large nodes are split where the vectors lie, and a large model meets the rows in tasks: same trees, same scores."""
    rows = [(f"e{i % 800}", float(i % 37), float(i * i % 101), 1.0 if i % 3 else float(i)) for i in range(900)]
    train = spark.createDataFrame([*rows, (None, 1.0, 2.0, 3.0)], "event_id string, a double, b double, c double")
    names = ["a", "b", "c"]
    sent = []
    context = type(spark.sparkContext)
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    large = forest.fit(train, names, 20, 0.7, 0.8, 7, 50)
    shares = forest.score(train, large, 60).select(*names, "event_id", F.round("anomaly_score", 12).alias("s"))
    got = sorted(map(str, shares.collect()))
    assert not sent
    whole = forest.fit(train, names, 20, 0.7, 0.8, 7, 10_000)
    assert large.nodes.exceptAll(whole.nodes).count() == whole.nodes.exceptAll(large.nodes).count() == 0
    once = forest.score(train, whole).select(*names, "event_id", F.round("anomaly_score", 12).alias("s"))
    assert got == sorted(map(str, once.collect()))
    assert forest.score(train.limit(0), large, 60).count() == 0


def test_routes_of_large_forests_agree(spark, monkeypatch):
    """Trees of groups, of drawn vectors and of split nodes have the same nodes and scores; scoring settles no nodes."""
    for name, value in (("NODE_VECTORS", 40), ("NEAR_ROWS", 90), ("TABLE_VALUES", 60), ("BLOCK_VECTORS", 200)):
        monkeypatch.setattr(forest, name, value)
    rows = [(f"e{i % 800}", float(i % 37), math.sqrt(i), 1.0 if i % 3 else float(i % 9)) for i in range(900)]
    train = spark.createDataFrame([*rows, (None, -1e9, -0.0, 3.0), *[(f"h{i}", 5.0, 5.0, 5.0) for i in range(200)]],
                                  "event_id string, a double, b double, c double")
    asked = [(f"q{i % 20}", float(i), math.sqrt(i * 23) - 0.01, 9.0 - i) for i in range(38)]
    query = spark.createDataFrame([*asked, (None, None, float("nan"), 1e12)], train.schema)
    names, fields = ["a", "b", "c"], ["event_id", "a", "c", F.round("anomaly_score", 12).alias("s")]
    whole = forest.fit(train, names, 12, 0.7, 0.8, 7, 10_000)
    want = sorted(map(str, forest.score(query, whole).select(fields).collect()))
    for group, tree in ((10_000, 10_000), (100, 10_000), (100, 50)):
        monkeypatch.setattr(forest, "GROUP_VECTORS", group)
        monkeypatch.setattr(forest, "TREE_VECTORS", tree)
        large = forest.fit(train, names, 12, 0.7, 0.8, 7, 50)
        assert sorted(map(str, forest.score(query, large).select(fields).collect())) == want
        assert (large.kept is None) == (tree > 50)
        assert large.nodes.exceptAll(whole.nodes).count() == whole.nodes.exceptAll(large.nodes).count() == 0


def test_draws_are_those_of_inversion():
    """Poisson draws are the plain inversion's, for rates of both kinds."""
    h = forest.chained(3, range(4000))
    for rate in (0.0, 0.5, 7.0, 29.0):
        u, want = forest.uniform(h), []
        for x in u:
            j, term = 0, math.exp(-rate)
            total = term
            while x > total and j < 119:
                j += 1
                term = term * rate / j
                total += term
            want.append(j)
        assert forest._poisson(forest.np.array([rate]), h).tolist() == want
