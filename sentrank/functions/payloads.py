"""Explanation cells: lenient parsing, summaries and JSON records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DELTA_KEY
from .times import format_iso_seconds


def parse_explanation(cell: Column) -> Column:
    """VARIANT of a JSON cell; ``\\'`` is tried as a quote; other text is kept as ``{"raw": …}``."""
    text = F.trim(cell)
    # a failing parse is slow: only text that can begin a JSON value is tried
    maybe = F.left(text, F.lit(1)).isin(*'{["-0123456789') | text.isin("true", "false", "null")
    escaped = F.contains(text, F.lit("\\'"))
    requoted = F.replace(text, F.lit("\\'"), F.lit('"'))
    raw = F.parse_json(F.to_json(F.struct(text.alias("raw"))))
    return F.when(text != "", F.coalesce(
        F.when(maybe, F.try_parse_json(text)), F.when(escaped, F.try_parse_json(requoted)), raw))


def _three_decimals(x: Column) -> Column:
    """``0.5``, ``-1.25``, ``2.0``: three decimals without trailing zeros."""
    fixed = F.round(x, 3).cast("decimal(38,3)").cast("string")
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def summarise_explanation(parsed: Column, first_n: int = 3) -> Column:
    """``feature:delta`` of the first entries; entries without a numeric delta are skipped."""
    entries = F.try_variant_get(parsed, "$.top_features", "array<variant>")

    def part(entry: Column) -> Column:
        name = F.coalesce(F.try_variant_get(entry, "$.feature", "string"), F.lit("None"))
        delta = F.try_variant_get(entry, f"$.{DELTA_KEY}", "variant")
        value = F.try_variant_get(entry, f"$.{DELTA_KEY}", "double")
        absent = delta.isNull()
        return F.when(absent, F.concat(name, F.lit(":0"))).when(
            value.isNotNull(), F.concat(name, F.lit(":"), _three_decimals(value))
        )

    parts = F.array_compact(F.transform(F.slice(entries, 1, first_n), part))
    return F.nullif(F.array_join(parts, ", "), F.lit(""))


def json_record(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON text per row: times as ISO seconds, NaN and NULL as ``null``."""
    fields = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = format_iso_seconds(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
