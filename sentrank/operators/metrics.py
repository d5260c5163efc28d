"""Ranking quality under a review budget, stability over days, drift and run facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .quantiles import exact_quantiles, rank_rows
from .rank import best_rows, review_order, slice_size, top_k, top_p_per_day


def join_labels(scores: DataFrame, labels: DataFrame, label: str = "y_true_synth") -> DataFrame:
    """Scores with the labels of evaluated rows, by event id."""
    ys = labels.filter("y_mask_eval = 1") if "y_mask_eval" in labels.columns else labels
    extra = [c for c in ("synth_usecase",) if c in ys.columns and c not in scores.columns]
    return scores.join(ys.select("event_id", label, *extra), "event_id")


def _figures(tp: Column, k: Column, n: Column, positives: Column) -> dict[str, Column]:
    """Precision, recall, lift and the false share of all negatives for a slice of ``k``."""
    precision = tp / F.nullif(k, F.lit(0))
    return {
        "precision": precision,
        "recall": tp / F.nullif(positives, F.lit(0)),
        "lift": precision / F.nullif(positives / F.nullif(n, F.lit(0)), F.lit(0.0)),
        "fpr": (k - tp) / F.nullif(n - positives, F.lit(0)),
    }


def figures_table(spark, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    """Metrics from plain counts (n, positives, k, tp)."""
    df = spark.createDataFrame(rows, "n long, positives long, k long, tp long")
    return df.withColumns(_figures(F.col("tp"), F.col("k"), F.col("n"), F.col("positives")))


def budget_metrics(df: DataFrame, label: str, ps: list[float] | None = None, ks: list[int] | None = None,
                   by: str = "anomaly_score") -> DataFrame:
    """One row per budget: p (NULL for a fixed K), k, tp, fp, fn, tn and the four ratios.

    The scores are settled once, without other columns. One aggregate for the totals,
    one Top-K of the largest budget, one aggregate over that slice; no rank is computed
    for rows outside it.
    """
    df = settle(df.select("event_id", by, F.col(label).cast("long").alias("_y")))
    n, positives = df.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    budgets = [(p, slice_size(n, p)) for p in ps or []] + [(None, min(k, n)) for k in ks or []]
    slice_ = top_k(df, max(k for _, k in budgets), by)
    cells = [
        F.struct(F.lit(p).cast("double").alias("p"), F.lit(k).cast("long").alias("k"),
                 F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("_y"))), F.lit(0)).alias("tp"))
        for p, k in budgets
    ]
    rows = slice_.agg(F.array(*cells).alias("b")).select(F.inline("b"))
    nn, pp = F.lit(n), F.lit(positives)
    return rows.withColumns({
        "fp": F.col("k") - F.col("tp"), "fn": pp - F.col("tp"),
        "tn": nn - pp - (F.col("k") - F.col("tp")),
    }).withColumns(_figures(F.col("tp"), F.col("k"), nn, pp))


def metrics_by_family(df: DataFrame, label: str, family: str, k: int, by: str = "anomaly_score") -> DataFrame:
    """Per family: positives, how many of them are in the Top-K, recall."""
    slice_ = top_k(df.select("event_id", by, family, label), k, by)
    hits = slice_.filter(F.col(label) == 1).groupBy(family).agg(F.count("*").alias("hits"))
    totals = df.filter(F.col(label) == 1).groupBy(F.col(family).alias("family")).agg(F.count("*").alias("positives"))
    h = F.coalesce("hits", F.lit(0))
    return totals.join(hits, F.col("family").eqNullSafe(F.col(family)), "left").select(
        "family", "positives", h.alias("hits"), (h / F.col("positives")).alias("recall"))


def metrics_per_day(df: DataFrame, label: str, p: float, by: str = "anomaly_score") -> DataFrame:
    """Budget metrics of each day's own Top-p slice."""
    y = F.col(label).cast("long")
    days = df.groupBy(F.to_date("timestamp").alias("_day")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("positives"))
    slices = top_p_per_day(df.select("event_id", "timestamp", by, label), p, by)
    hits = slices.groupBy("day").agg(F.count("*").alias("k"), F.coalesce(F.sum(y), F.lit(0)).alias("tp"))
    joined = hits.join(days, F.col("day").eqNullSafe(F.col("_day"))).drop("_day")
    return joined.withColumns(_figures(F.col("tp"), F.col("k"), F.col("n"), F.col("positives")))


def day_stability(per_day: DataFrame) -> DataFrame:
    """Quartiles of the daily figures (one row per figure; days are few)."""
    names = ["precision", "recall", "lift", "fpr"]
    cells = [F.struct(F.lit(c).alias("figure"), F.percentile(c, [0.25, 0.5, 0.75]).alias("q")) for c in names]
    return per_day.agg(F.array(*cells).alias("c")).select(F.inline("c")).select(
        "figure", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def sweep(neighbors: DataFrame, label: str, ks: list[int], ps: list[float]) -> DataFrame:
    """Metrics for every (k, p) from one neighbour join: the score for k is the mean of the first k distances.

    ``neighbors`` has event_id, label and ``dists`` with at least ``max(ks)`` entries. One pass makes the scores of
    every k and settles them; the slices of all k are cut and ranked together, and one aggregate counts every budget.
    """
    sums = [F.aggregate(F.slice("dists", 1, k), F.lit(0.0), lambda a, x: a + x) / F.lit(float(k)) for k in ks]
    scores = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.round(s, 9).alias("anomaly_score")) for k, s in zip(ks, sums)]))
    held = settle(neighbors.select("event_id", F.col(label).cast("long").alias("y"), scores))
    n, positives = held.where(F.col("k") == ks[0]).agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    budgets = [(p, slice_size(n, p)) for p in ps]
    near = best_rows(held, ["k"], "anomaly_score", F.lit(max(b for _, b in budgets)))
    ranked = rank_rows(near, review_order(), group=["k"])
    counted = ranked.groupBy("k").agg(F.array(*[F.struct(
        F.lit(p).cast("double").alias("p"), F.lit(b).cast("long").alias("budget"),
        F.coalesce(F.sum(F.when(F.col("rank") <= b, F.col("y"))), F.lit(0)).alias("tp")) for p, b in budgets]).alias("b"))
    rows = counted.select("k", F.inline("b"))
    nn, pp = F.lit(n), F.lit(positives)
    return rows.withColumns({
        "fp": F.col("budget") - F.col("tp"), "fn": pp - F.col("tp"), "tn": nn - pp - (F.col("budget") - F.col("tp")),
    }).withColumns(_figures(F.col("tp"), F.col("budget"), nn, pp))


def best_k(sweep_result: DataFrame) -> DataFrame:
    """Per p the k with the highest precision, smaller k on ties."""
    best = F.max(F.struct("precision", (-F.col("k")).alias("minus_k"), "recall", "lift", "fpr"))
    return sweep_result.groupBy("p").agg(best.alias("b")).select(
        "p", (-F.col("b.minus_k")).alias("k"), "b.precision", "b.recall", "b.lift", "b.fpr")


def score_summary(df: DataFrame, by: str = "anomaly_score") -> DataFrame:
    return df.agg(F.min(by).alias("score_min"), F.max(by).alias("score_max"), F.avg(by).alias("score_mean"),
                  F.count("*").alias("rows"))


def score_histogram(df: DataFrame, bins: int = 50, by: str = "anomaly_score") -> DataFrame:
    """Equal-width bins between the smallest and largest score; the top value belongs to the last bin."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    present = df.filter(F.col(by).isNotNull())
    if low is None or low == high:
        slot = F.lit(1).cast("long")
    else:
        slot = F.least(F.width_bucket(F.col(by), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return present.groupBy(slot.alias("bin")).agg(F.count("*").alias("alerts"))


def selection_rate(df: DataFrame, threshold: float, by: str = "anomaly_score") -> DataFrame:
    """Per day: rows, rows at or above a fixed threshold, their share."""
    picked = F.count_if(F.col(by) >= threshold)
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("alerts"), picked.alias("selected"), (picked / F.count("*")).alias("rate"))


def bin_edges(train: DataFrame, by: str = "anomaly_score", bins: int = 10) -> list[float]:
    """Inner quantile edges of the training scores."""
    return exact_quantiles(train, [by], [i / bins for i in range(1, bins)])[by]


def drift_by_day(df: DataFrame, edges: list[float], by: str = "anomaly_score") -> DataFrame:
    """Per day the share of scores in each training quantile bin (without drift: equal shares)."""
    slot = sum((F.when(F.col(by) > e, 1).otherwise(0) for e in edges), F.lit(0)) + 1
    day = F.to_date("timestamp")
    binned = df.groupBy(day.alias("day"), slot.alias("bin")).agg(F.count("*").alias("alerts"))
    totals = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    return binned.join(totals, F.col("day").eqNullSafe(F.col("_day"))).select(
        "day", "bin", "alerts", (F.col("alerts") / F.col("_n")).alias("share"))


def run_metadata(scored: DataFrame, selected: int, version: str, seconds: float) -> DataFrame:
    """One row: version, time window, rows, selected rows, selection rate, latency."""
    n = F.count("*")
    return scored.agg(
        F.lit(version).alias("version"), F.min("timestamp").alias("window_start"),
        F.max("timestamp").alias("window_end"), n.alias("rows"), F.lit(selected).cast("long").alias("selected"),
        (F.lit(selected) / n).alias("selection_rate"), F.lit(float(seconds)).alias("latency_s"))

