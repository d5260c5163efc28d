"""From raw columns to the six canonical ones, and removal of repeated alerts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CANONICAL, CLEAN_CANDIDATES, RAW_TIMESTAMP, SERVICE_CANDIDATES
from ..functions.numbers import to_level
from ..functions.times import parse_any_time, parse_export_time


def resolve_columns(columns: list[str], candidates: dict[str, list[str]]) -> dict[str, str | None]:
    """For every target the first candidate that exists (a schema choice, not a row-wise one)."""
    present = set(columns)
    return {k: next((c for c in names if c in present), None) for k, names in candidates.items()}


def clean_mapping(columns: list[str]) -> dict[str, str | None]:
    """Mapping of the batch path: host name before host id, either is enough."""
    found = resolve_columns(columns, CLEAN_CANDIDATES)
    name, host_id = found.pop("agent_name"), found.pop("agent_id")
    return _checked({**found, "agent": name or host_id})


def service_mapping(columns: list[str]) -> dict[str, str | None]:
    """Mapping of the scoring service: canonical names win."""
    return _checked(resolve_columns(columns, SERVICE_CANDIDATES))


def _checked(mapping: dict[str, str | None]) -> dict[str, str | None]:
    missing = [c for c in CANONICAL if c != "event_id" and mapping.get(c) is None]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return {c: mapping.get(c) for c in CANONICAL}


def dropped_columns(columns: list[str], mapping: dict[str, str | None]) -> list[str]:
    used = set(mapping.values())
    return [c for c in columns if c not in used]


def canonicalise(df: DataFrame, mapping: dict[str, str | None] | None = None,
                 strict_time: bool = False) -> DataFrame:
    """Typed canonical columns; what cannot be coerced becomes NULL.

    Without any id column a number unique within the frame is used.
    """
    mapping = mapping or clean_mapping(df.columns)

    def src(name: str) -> Column:
        return F.col(f"`{mapping[name]}`")

    types = dict(df.dtypes)
    when = src("timestamp")
    if types[mapping["timestamp"]] == "string":
        when = parse_export_time(when, strict=True) if strict_time else parse_any_time(when)
    event_id = src("event_id") if mapping["event_id"] else F.monotonically_increasing_id()
    return df.select(
        event_id.cast("string").alias("event_id"),
        when.cast("timestamp_ntz").alias("timestamp"),
        src("agent").cast("string").alias("agent"),
        src("rule_id").cast("string").alias("rule_id"),
        to_level(src("rule_level")).alias("rule_level"),
        src("decoder").cast("string").alias("decoder"),
    )


def dedup_keep_first(df: DataFrame, key: str = "event_id", time: str = "timestamp") -> DataFrame:
    """One row per key: the earliest, ties by the remaining columns; NULL keys are one key.

    An aggregate with map-side combine, so a key that holds a third of all rows
    shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    others = [c for c in rest if c != time]
    first = F.min(F.struct(F.col(time).isNull().alias("_late"), F.col(time), *[F.col(f"`{c}`") for c in others]))
    return (
        df.groupBy(key).agg(first.alias("_r"))
        .select(*[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in df.columns])
    )


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null_time(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.filter(F.col(time).isNotNull())


def time_first(df: DataFrame, time: str = RAW_TIMESTAMP) -> DataFrame:
    if time not in df.columns:
        return df
    return df.select(F.col(f"`{time}`"), *[F.col(f"`{c}`") for c in df.columns if c != time])


def normalise_time(df: DataFrame, time: str = RAW_TIMESTAMP) -> DataFrame:
    """Parse the raw time column in place, if there is one."""
    if time not in df.columns:
        return df
    return df.select(*[
        parse_any_time(F.col(f"`{c}`")).alias(c) if c == time else F.col(f"`{c}`") for c in df.columns
    ])


def sort_by_time(df: DataFrame, time: str = RAW_TIMESTAMP, tie: str | None = None) -> DataFrame:
    """Time order, missing times last; ties by an id or by a hash of the row."""
    if time not in df.columns:
        return df
    if tie is None:
        tie = resolve_columns(df.columns, {"id": CLEAN_CANDIDATES["event_id"]})["id"]
    last = F.col(f"`{tie}`") if tie else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.orderBy(F.col(f"`{time}`").asc_nulls_last(), last)


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns`` in that order; absent ones are NULL text."""
    return df.select(*[
        F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns
    ])


def pick_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in preferred if c in df.columns])
