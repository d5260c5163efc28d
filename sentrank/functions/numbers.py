"""Numeric coercion and normalisation expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_HOST_LEVEL, LABEL_TOKENS


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_level(c: Column) -> Column:
    """Whole number from text (``5``, ``5.0``, `` 5 ``); fractions and text give NULL."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number).try_cast("int")


def ratio_or_zero(x: Column, mean: Column, spread: Column) -> Column:
    """z-score; a missing or zero spread, or a missing value, gives 0."""
    return F.coalesce((x - mean) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def min_max(x: Column, low: float, high: float, eps: float) -> Column:
    return (x - F.lit(low)) / F.lit(high - low + eps)


def log1p_clipped(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def outlier_level(host_mean: Column, bump: Column) -> Column:
    """A level 4 to 5 above the host's mean, inside 0..15."""
    mean = F.coalesce(host_mean, F.lit(DEFAULT_HOST_LEVEL))
    return F.least(F.lit(15), F.greatest(F.lit(0), F.ceil(mean + 4 + bump))).cast("int")


def label_to_score(label: Column) -> Column:
    """Numeric labels pass through; words naming an anomaly are 1, others 0."""
    text = F.lower(label)
    named = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in LABEL_TOKENS])
    return F.coalesce(label.try_cast("double"), named.cast("double"))


def oriented(score: Column, higher_is_anomalous: bool) -> Column:
    """Anomaly scores always grow with anomaly; flip the ones that do not."""
    return score if higher_is_anomalous else -score


def inverse_frequency(n: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + n)
