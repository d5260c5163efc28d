"""Review slices: Top-K, Top-p, per-day Top-p, threshold."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, small_side
from .quantiles import rank_rows, same_keys, twin, values_at

#: Slices up to which each partition keeps its best rows and one task merges them.
LIMIT_ROWS = 5_000
#: Rows of a group up to which a window in one task ranks all of them.
GROUP_ROWS = 200_000


def review_order(score: str = "anomaly_score", descending: bool = True, tie: str = "event_id") -> list[Column]:
    """Missing scores last in both directions, ties by event id."""
    c = F.col(f"`{score}`")
    first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return [first, F.col(tie).asc_nulls_last()] if tie != score else [first]


def top_k(df: DataFrame, k: int = 50, by: str = "anomaly_score", descending: bool = True,
          max_k: int | None = None) -> DataFrame:
    """The first ``k`` rows with their ``rank``; ``max_k`` bounds what a service accepts."""
    if by not in df.columns:
        raise ValueError(f"no column {by!r} to sort by")
    if k < 1 or (max_k is not None and k > max_k):
        raise ValueError(f"k out of range: {k}")
    return _head(df, k, by, descending) if k <= LIMIT_ROWS else _long_head(settle(df), k, by, descending)


def _head(df: DataFrame, k: int, by: str, descending: bool = True) -> DataFrame:
    order = review_order(by, descending)
    ranked = df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.select("rank", *[F.col(f"`{c}`") for c in df.columns if c != "rank"])


def _long_head(held: DataFrame, k: int, by: str, descending: bool = True) -> DataFrame:
    """The first ``k`` of a settled table, however many: only what is above the counted cut is sorted."""
    near = best_rows(held.drop("rank") if by != "rank" else held, [], by, F.lit(k), descending)
    ranked = rank_rows(near, review_order(by, descending), small_rows=LIMIT_ROWS).filter(F.col("rank") <= k)
    return ranked.select("rank", *[F.col(f"`{c}`") for c in held.columns if c != "rank"])


def slice_size(n: int, p: float) -> int:
    """Rows in a Top-p slice of ``n`` rows, at least one; ``p`` is a fraction."""
    return max(1, math.ceil(max(1e-4, min(1.0, p)) * n))


def slice_size_percent(n: int, percent: float) -> int:
    """Same for percent units, clamped to 0.0001..100 percent."""
    return max(1, math.ceil(max(1e-4, min(100.0, percent)) / 100.0 * n))


def top_p(df: DataFrame, p: float = 0.01, by: str = "anomaly_score", percent: bool = False) -> DataFrame:
    """Top-p slice with ranks; ``df`` is evaluated once and settled."""
    held = settle(df)
    n = held.count()
    if n == 0:
        return held.limit(0).select(F.lit(0).cast("long").alias("rank"), "*")
    k = slice_size_percent(n, p) if percent else slice_size(n, p)
    return _head(held, k, by) if k <= LIMIT_ROWS else _long_head(held, k, by)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def best_rows(held: DataFrame, keys: list[str], by: str, budget: Column, descending: bool = True,
              small_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of the settled table ``held`` that can be among their group's best ``budget`` ones by a number.

    The value at the budget's rank is found for all groups at once from counts, so what comes back is each group's
    slice and the rows that tie with its last one. Groups that are small, or have no more numbers than the budget, stay
    whole. ``budget`` is an expression over ``n``, the rows of a group. NaN counts as the greatest number. A column that
    is no number is not cut.
    """
    if dict(held.dtypes)[by] not in _NUMBERS:
        return held
    value = F.col(f"`{by}`").cast("double")
    value = F.when(F.isnan(value), F.lit(math.inf)).otherwise(value) * (1.0 if descending else -1.0)
    cols = [f"`{k}`" for k in keys]
    narrow = held.select(*cols, value.alias("x"), F.lit(1).alias("n"))
    groups = narrow.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("scored"), F.min("x").alias("lo"),
                                       F.max("x").alias("hi")).withColumn("budget", budget.cast("long"))
    groups = settle(groups.where((F.col("n") > small_rows) & (F.col("budget") < F.col("scored"))))
    if not groups.limit(1).count():
        return held
    wanted = groups.select(*cols, (F.col("scored") - F.col("budget")).alias("rank"), "lo", "hi", F.lit(0).alias("below"))
    cuts = settle(values_at(narrow.where("x IS NOT NULL"), keys, wanted).select(*cols, F.col("value").alias("_cut")))
    cuts = twin(small_side(cuts), keys) if keys else F.broadcast(cuts)       # without keys it is one row
    joined = held.join(cuts, same_keys(keys), "left")
    return joined.where(F.col("_cut").isNull() | (value >= F.col("_cut"))).select(*[F.col(f"`{c}`") for c in held.columns])


def day_budget(p: float) -> Column:
    """Rows of a day's Top-p slice from its ``n`` rows."""
    return F.greatest(F.lit(1), F.ceil(F.lit(max(1e-4, min(1.0, p))) * F.col("n"))).cast("long")


def top_p_per_day(df: DataFrame, p: float = 0.01, by: str = "anomaly_score", time: str = "timestamp",
                  small_rows: int = GROUP_ROWS) -> DataFrame:
    """Each day's ``max(1, ceil(p·rows of the day))`` best rows, ranked within the day.

    ``df`` is evaluated once and settled. The rank of a row counts only rows of its day's slice and their ties.
    """
    held = settle(df.withColumn("day", F.to_date(time)))
    near = best_rows(held, ["day"], by, day_budget(p), small_rows=small_rows)
    ranked = rank_rows(near, review_order(by), group=["day"], small_rows=small_rows)
    budgets = small_side(held.groupBy(F.col("day").alias("_day")).agg(F.count(F.lit(1)).alias("n")).select(
        "_day", day_budget(p).alias("_budget")))
    return ranked.join(budgets, F.col("day").eqNullSafe(F.col("_day"))).filter("rank <= _budget").drop("_day", "_budget")


def above_threshold(df: DataFrame, threshold: float, by: str = "anomaly_score") -> DataFrame:
    return df.filter(F.col(by) >= threshold)


def top_k_per_day(df: DataFrame, k: int, by: str = "anomaly_score", time: str = "timestamp") -> DataFrame:
    """Each day's ``k`` best rows; the fixed limit is applied before the shuffle (window group limit)."""
    dated = df.withColumn("day", F.to_date(time))
    spec = Window.partitionBy("day").orderBy(*review_order(by))
    return dated.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)
