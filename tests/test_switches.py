"""Size switches choose a plan, never a result; rows are scored one by one whatever their ids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrank.operators import forest, neighbors, quantiles, rank
from sentrank.operators.quantiles import exact_quantiles, rank_rows
from sentrank.streaming import alerts as feed

NAMES = ["a", "b"]


def odd_rows(spark):
    rows = [(None, 1.0, 2.0), ("a", 1.0, 2.0), ("b", 5.0, -1.0), ("b", 0.0, 0.5), (None, 9.0, 9.0), ("c", None, float("nan"))]
    return spark.createDataFrame(rows, "event_id string, a double, b double")


def training(spark, n=200):
    return spark.range(n).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string")).alias("event_id"),
        (F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 5 / 2).alias("b"))


def pairs(df):
    return sorted(((r["event_id"], r["a"] if r["a"] is not None else -1, round(r["anomaly_score"], 9)) for r in df.collect()), key=repr)


def test_forest_in_one_or_many_groups(spark):
    model = forest.fit(training(spark), NAMES, trees=24, max_samples=64)
    one, many = forest.score(odd_rows(spark), model), forest.score(odd_rows(spark), model, broadcast_nodes=100)
    assert model.nodes.count() > 300
    assert len(pairs(one)) == 6 and pairs(one) == pairs(many)


@pytest.mark.parametrize("scorer", [neighbors.knn_score, neighbors.lof_score])
@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_score_every_row(spark, scorer, scale):
    got = scorer(odd_rows(spark), training(spark), NAMES, 3, scale, block_rows=8)
    assert got.columns == ["event_id", "a", "b", "anomaly_score"]
    rows = {(r["event_id"], r["a"]): r["anomaly_score"] for r in got.collect()}
    assert got.count() == 6 and rows[(None, 1.0)] == rows[("a", 1.0)] != rows[("b", 5.0)]


def test_neighbour_join_gives_a_row_for_each_row(spark):
    index = neighbors.build_index(training(spark), NAMES, 16)
    near = neighbors.knn_join(odd_rows(spark), index, NAMES, 2)
    assert sorted((r["event_id"] for r in near.collect()), key=str) == [None, None, "a", "b", "b", "c"]
    names = near.select(F.explode("neighbors").alias("n")).select(neighbors.plain_id(F.col("n")).alias("n")).distinct()
    assert {r["n"] for r in names.collect()} <= {"", *map(str, range(50))}


@pytest.mark.parametrize("trees_at_once", [2, 10 ** 6])
def test_neighbours_by_cells_parts_and_blocks(spark, monkeypatch, trees_at_once):
    """Three levels of boxes give the neighbours of one level; no task cuts more than about its share of a cell."""
    points = spark.range(3000).select(F.col("id").cast("string").alias("event_id"), (F.col("id") * 37 % 1009).cast("double").alias("a"),
                                      F.sin(F.col("id") * 0.7).alias("b"))
    asked = spark.range(60).select(F.col("id").cast("string").alias("event_id"), (F.col("id") * 17.3).alias("a"), F.cos("id").alias("b"))
    plain = neighbors.build_index(points, NAMES, 4000)
    assert plain.boxes is None and plain.parts is None
    monkeypatch.setattr(neighbors, "MAX_CELLS", 4)
    monkeypatch.setattr(neighbors, "TREES_AT_ONCE", trees_at_once)
    deep = neighbors.build_index(points, NAMES, 16, task_vectors=128)
    assert deep.tree.cells == 4 and deep.parts.count() > 20 and deep.boxes.count() > 150
    assert deep.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 512
    assert deep.rows.count() == plain.rows.count()
    got, want = ({r["event_id"]: [round(d, 9) for d in r["dists"]] for r in neighbors.knn_join(asked, i, NAMES, 9).collect()}
                 for i in (deep, plain))
    assert got == want and len(got) == 60


VALUES = [
    [1.0, 2.0, 3.0, math.inf], [-math.inf, -1.0, 0.0, 2.0, math.inf, math.inf], [math.inf, math.inf], [-math.inf, 5.0],
    [-1.7e308, -1e308, 0.0, 1e308, 1.7e308] * 20, [5e-324 * i for i in range(300)], [1.0 + 2.0 ** -52 * i for i in range(40)] * 3,
    [0.1 * (i % 37) for i in range(500)], [None, 3.0, float("nan"), 4.0],
]


@pytest.mark.parametrize("values", VALUES)
def test_quantiles_by_either_way(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    small, large = (exact_quantiles(df, ["x"], probs, small_rows=n)["x"] for n in (10_000, 0))
    for a, b in zip(small, large, strict=True):
        assert a == b or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b))


def test_ranks_by_either_way(spark):
    df = odd_rows(spark).unionByName(training(spark)).withColumn("k", F.col("a") % 2)
    order = [F.col("b").desc_nulls_last(), F.col("event_id"), F.col("a")]
    for group in (None, ["k"]):
        small, large = (rank_rows(df, order, group, small_rows=n) for n in (10_000, 10))
        assert large.columns == [*df.columns, "rank"]
        pick = lambda d: sorted((repr(r["k"] if group else None), r["rank"], repr(r["b"])) for r in d.collect())
        assert pick(small) == pick(large)


@pytest.mark.parametrize("group", [None, ["_part"]])
def test_ranks_keep_columns_of_any_name(spark, group):
    """Raw columns (dots, ``_id``) and names of the numbering itself come through both ways unchanged."""
    df = spark.range(50).select(
        F.format_string("evt-%03d", "id").alias("_id"), (F.col("id") % 7).alias("_source.@timestamp"), (F.col("id") % 3).alias("_part"),
        F.lit("x").alias("_place"), F.lit("y").alias("_before"), F.lit("z").alias("_nth_id"))
    order = [F.col("`_source.@timestamp`"), F.col("_id")]
    small, large = (rank_rows(df.repartition(5), order, group, small_rows=n) for n in (1000, 5))
    assert large.columns == small.columns == [*df.columns, "rank"]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_quantiles_read_the_rows_twice(spark):
    """Whatever the spread of the values, beyond the small size there are two passes over the rows."""
    reads = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    rows = spark.range(30_000).select(F.exp((F.col("id") % 7919) / 100.0 - 40).alias("x"), F.lit(1.5).alias("y"))
    got = exact_quantiles(rows.mapInPandas(seen, "x double, y double"), ["x", "y"], [0.01, 0.5, 0.999], small_rows=100)
    assert reads.value == 60_000
    want = rows.agg(F.percentile("x", [0.01, 0.5, 0.999]), F.percentile("y", [0.01, 0.5, 0.999])).first()
    assert got["x"] == pytest.approx(want[0], rel=1e-12) and got["y"] == want[1]


def test_a_rank_that_the_sketch_misses_is_found(spark, monkeypatch):
    real = quantiles._merged
    monkeypatch.setattr(quantiles, "_merged", lambda facts, ends: [(hi, hi) for _, hi in real(facts, ends)])
    rows = spark.range(3000).select(F.sqrt("id").alias("x"))
    got = exact_quantiles(rows, ["x"], [0.1, 0.5], small_rows=10)["x"]
    assert got == pytest.approx(list(rows.agg(F.percentile("x", [0.1, 0.5])).first()[0]))


def scored_days(spark, n=6000):
    score = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 97 == 0, float("nan")).when(
        F.col("id") % 89 == 0, math.inf).when(F.col("id") % 83 == 0, -math.inf).otherwise((F.col("id") * 7919 % 1000) / 8.0)
    day = F.when(F.col("id") % 50 == 0, None).when(F.col("id") < n // 2, "2024-01-01").when(
        F.col("id") < n - 20, "2024-01-02").otherwise("2024-01-03")
    return spark.range(n).select(F.format_string("%06d", "id").alias("event_id"), score.cast("double").alias("anomaly_score"),
                                 F.to_timestamp_ntz(day).alias("timestamp"))


@pytest.mark.parametrize("p", [0.01, 0.3, 1.0])
def test_day_slices_by_either_way(spark, p):
    """Days that are cut by counts have the slices of days that are ranked whole; missing days are a day of their own."""
    df = scored_days(spark)
    got, want = ([(str(r["day"]), r["rank"], r["event_id"]) for r in rank.top_p_per_day(df, p, small_rows=n).collect()]
                 for n in (50, 10 ** 6))
    assert sorted(got) == sorted(want) and len({d for d, *_ in got}) == 4


def test_ties_at_the_cut_of_a_day(spark):
    df = scored_days(spark).withColumn("anomaly_score", F.lit(1.0))
    got = rank.top_p_per_day(df, 0.01, small_rows=50)
    assert got.groupBy("day").agg(F.max("event_id") < "006000", F.max("rank"), F.count("*")).count() == 4
    assert got.where("day = DATE '2024-01-01'").agg(F.max("event_id")).first()[0] < "000040"


@pytest.mark.parametrize("descending", [True, False])
def test_long_slices_are_cut_first(spark, monkeypatch, descending):
    df = scored_days(spark)
    want = [(r["rank"], r["event_id"]) for r in rank.top_k(df, 700, descending=descending).orderBy("rank").collect()]
    monkeypatch.setattr(rank, "LIMIT_ROWS", 100)
    monkeypatch.setattr(rank, "GROUP_ROWS", 100)
    monkeypatch.setattr(rank.best_rows, "__defaults__", (True, 100))
    got = [(r["rank"], r["event_id"]) for r in rank.top_k(df, 700, descending=descending).orderBy("rank").collect()]
    assert got == want and len(got) == 700
    names = [r["event_id"] for r in rank.top_k(df, 700, by="event_id", descending=descending).orderBy("rank").collect()]
    assert names == sorted(names, reverse=descending) and len(names) == 700


def test_slices_evaluate_their_input_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    df = scored_days(spark)
    counted = df.mapInPandas(seen, df.schema)
    rank.top_p_per_day(counted, 0.01, small_rows=50).collect()
    assert reads.value == 6000
    rank.top_p(counted, 0.01).collect()
    assert reads.value == 12_000


def test_feed_from_a_file_and_from_a_folder(spark, tmp_path):
    rows = spark.range(10)
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    single = next((tmp_path / "one").glob("part-*.parquet"))
    for path in (tmp_path / "one", single):
        out = feed.run_to_parquet(feed.read_feed(spark, str(path), rows.schema), str(tmp_path / f"cp-{path.name}"), str(tmp_path / f"out-{path.name}"))
        assert out.count() == 10


def test_a_block_is_searched_by_leaves(monkeypatch):
    """Near queries look at few of a block's vectors, and find what looking at all of them finds, copies and ties included."""
    rng = np.random.default_rng(3)
    t = np.unique(np.round(rng.normal(size=(9000, 3)) * [50, 5, 1], 1), axis=0)
    q, w, k = np.round(rng.normal(size=(300, 3)) * [50, 5, 1], 1), rng.integers(1, 3, len(t)), 12
    ids = np.array([f"e{i:05d}" for i in rng.permutation(len(t))], dtype=object)
    place = {v: i for i, v in enumerate(ids)}
    looked, squares = [], neighbors.Leaves._squares

    def counted(self, qc, qn, leaves):
        rows, d2 = squares(self, qc, qn, leaves)
        looked.append(d2.size)
        return rows, d2

    monkeypatch.setattr(neighbors.Leaves, "_squares", counted)
    groups = neighbors._grouped(q)
    assert sorted(np.concatenate(groups)) == list(range(300)) and max(map(len, groups)) <= neighbors.GROUP_QUERIES
    seen = 0
    for g, found in neighbors.Leaves(t, w, ids).nearest(q, np.full(300, np.inf), k, groups):
        for i, (d, n) in zip(g, found, strict=True):
            exact = np.sqrt(((t - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids, np.round(exact, 9)))
            assert d == pytest.approx(np.repeat(exact[order], w[order])[:k], abs=1e-9)
            assert [exact[place[v]] for v in n] == pytest.approx(d, abs=1e-9)
            assert all((n == v).sum() <= w[place[v]] for v in n)
            seen += 1
    assert seen == 300 and sum(looked) < 0.35 * 300 * len(t)


def test_distances_without_names(spark):
    index = neighbors.build_index(training(spark), NAMES, 16)
    plain, named = (neighbors.vector_join(odd_rows(spark), index, NAMES, 5, label=c) for c in (None, "id"))
    assert plain.columns == ["qid", "dists"]
    assert {r["qid"]: r["dists"] for r in plain.collect()} == {r["qid"]: r["dists"] for r in named.collect()}
