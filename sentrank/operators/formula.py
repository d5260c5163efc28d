"""The plain formula score: level z-score, off-hours flag and rarity of (agent, rule).

The score depends on (agent, rule, level, off-hours) only. Those combinations are
counted once with map-side combine; mean, deviation, pair counts, minimum and
maximum all come from the counts.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MINMAX_EPS, W_LEVEL, W_OFF_HOURS, W_RARITY
from ..functions.numbers import inverse_frequency, min_max, to_double
from ..functions.times import hour_or_zero, off_hours_flag
from ..session import settle, small_side
from .rank import top_k

_KEYS = ["agent", "rule_id", "_level", "_off"]


class FormulaModel:
    """Frozen inputs of the formula: level mean/deviation, pair counts, score range."""

    def __init__(self, mean: float, spread: float, low: float, high: float,
                 combos: DataFrame, pairs: DataFrame | None):
        self.mean, self.spread, self.low, self.high = mean, spread, low, high
        self.combos, self.pairs = combos, pairs


def _parts(df: DataFrame) -> dict[str, Column]:
    """Terms whose columns exist; absent ones are constant."""
    cols = set(df.columns)
    level = F.coalesce(to_double(F.col("rule_level")), F.lit(0.0)) if "rule_level" in cols else F.lit(0.0)
    off = off_hours_flag(hour_or_zero(F.col("timestamp"))) if "timestamp" in cols else F.lit(0)
    pair = {"agent", "rule_id"} <= cols
    return {
        "agent": F.col("agent") if pair else F.lit(None).cast("string"),
        "rule_id": F.col("rule_id") if pair else F.lit(None).cast("string"),
        "_level": level, "_off": off,
    }


def _score(z_on: bool, pair_on: bool, mean: float, spread: float) -> Column:
    s = F.lit(0.0)
    if z_on:
        s = s + F.lit(W_LEVEL) * ((F.col("_level") - F.lit(mean)) / F.lit(spread))
    s = s + F.lit(W_OFF_HOURS) * F.col("_off").cast("double")
    if pair_on:
        s = s + F.lit(W_RARITY) * inverse_frequency(F.col("_n").cast("double"))
    return s


def _with_pair_count(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    p = pairs.select(F.col("agent").alias("_a"), F.col("rule_id").alias("_r"), "_n")
    cond = rows["agent"].eqNullSafe(p["_a"]) & rows["rule_id"].eqNullSafe(p["_r"])
    return rows.join(p, cond, "left").drop("_a", "_r").withColumn("_n", F.coalesce("_n", F.lit(0)))


def fit(df: DataFrame) -> FormulaModel:
    """One aggregate over the alerts; everything else works on its small result."""
    z_on, pair_on = "rule_level" in df.columns, {"agent", "rule_id"} <= set(df.columns)
    parts = _parts(df)
    combos = settle(
        df.select(*[c.alias(k) for k, c in parts.items()]).groupBy(*_KEYS)
        .agg(F.count("*").alias("rows"), F.count("rule_id").alias("named"))
    )
    pairs = combos.groupBy("agent", "rule_id").agg(F.sum("named").alias("_n"))
    pairs = small_side(settle(pairs)) if pair_on else None

    mean, spread = 0.0, 1.0
    if z_on:
        total, weighted = combos.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("_level"))).first()
        if total:
            mean = weighted / total
            squares = combos.agg(F.sum(F.col("rows") * F.pow(F.col("_level") - F.lit(mean), 2))).first()[0]
            spread = math.sqrt(squares / total) or 1.0
    scored = _with_pair_count(combos, pairs) if pair_on else combos
    scored = scored.withColumn("_s", _score(z_on, pair_on, mean, spread))
    low, high = scored.agg(F.min("_s"), F.max("_s")).first()
    return FormulaModel(mean, spread, low or 0.0, high or 0.0, scored, pairs)


def score(df: DataFrame, model: FormulaModel | None = None) -> DataFrame:
    """Adds ``anomaly_score``; fitted on ``df`` itself unless a frozen model is given.

    With a frozen model unseen pairs count 0 and scores may leave 0..1.
    """
    model = model or fit(df)
    z_on = "rule_level" in df.columns
    rows = df.withColumns({k: c for k, c in _parts(df).items() if k.startswith("_")})
    if model.pairs is not None:
        rows = _with_pair_count(rows, model.pairs)
    s = _score(z_on, model.pairs is not None, model.mean, model.spread)
    return rows.withColumn("anomaly_score", min_max(s, model.low, model.high, MINMAX_EPS)).drop("_level", "_off", "_n")


def ensure_score(df: DataFrame) -> DataFrame:
    """An existing ``anomaly_score`` wins over the formula."""
    return df if "anomaly_score" in df.columns else score(df)


def top_k_by_formula(df: DataFrame, k: int = 50) -> DataFrame:
    """Top-K by the formula without scoring every row.

    The best combinations that together cover ``k`` rows fix a score cut; only
    rows of combinations at or above the cut are scored and sorted.
    """
    if "anomaly_score" in df.columns:
        return top_k(df, k)
    model = fit(df)
    head = model.combos.select("_s", "rows").orderBy(F.desc("_s")).limit(k)
    run = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        head.withColumn("_sum", F.sum("rows").over(run)).filter(F.col("_sum") >= k)
        .agg(F.max("_s")).first()[0]
    )
    if cut is None:
        return top_k(score(df, model), k)
    best = small_side(model.combos.filter(F.col("_s") >= cut).select(*[F.col(c).alias(f"k_{c}") for c in _KEYS]))
    keyed = df.withColumns({f"_p_{k_}": c for k_, c in _parts(df).items()})
    cond = F.lit(True)
    for c in _KEYS:
        cond = cond & keyed[f"_p_{c}"].eqNullSafe(best[f"k_{c}"])
    near = keyed.join(best, cond, "left_semi").select(*df.columns)
    return top_k(score(near, model), k)

