"""Coverage profile, cleaning report, uniform sample and corpus description."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import RAW_TIMESTAMP
from ..functions.hashing import row_key
from .quantiles import hex_cutoffs

_EXAMPLES = 5
_ZERO = r"^\s*[-+]?(0+\.?0*|\.0+)([eE][-+]?\d+)?\s*$"
COLUMNS_PER_PASS = 50


def _profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Figures per column from (column, cell) pairs, folded on the map side to one row per column.

    Zeros are found by pattern, because a failing numeric cast is slow on text. Few
    columns at a time keep the plan small and the aggregate in its hash map.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns
    ])
    c = F.col("cell")
    return df.select(F.inline(cells)).groupBy("column").agg(
        F.count(c).alias("non_null"),
        F.count("*").alias("total"),
        F.hll_sketch_agg(c).alias("sketch"),
        F.count_if(F.contains(c, F.lit("0")) & c.rlike(_ZERO)).alias("zeros"),
    )


def example_values(df: DataFrame, columns: list[str], n: int = _EXAMPLES, width: int = 120) -> DataFrame:
    """(column, example): candidates for the ``n`` smallest distinct values per column, each cut to ``width`` characters.

    Every partition keeps a set of at most ``n`` values per column, which batch after batch is merged with the batch's
    own smallest ones; so ``n`` rows per column and partition come out, whatever the number of distinct values.
    """
    names = {f"c{i}": c for i, c in enumerate(columns)}
    cells = df.select(*[F.left(F.col(f"`{c}`").cast("string"), F.lit(width)).alias(i) for i, c in names.items()])

    def smallest(batches):
        kept = {i: pa.array([], pa.string()) for i in names}
        for batch in batches:
            for i in names:
                both = pc.unique(pa.chunked_array([kept[i], batch.column(i).drop_null()]))
                kept[i] = both.take(pc.select_k_unstable(both, k=n, sort_keys=[("x", "ascending")]))
        rows = [(names[i], x) for i, xs in kept.items() for x in xs.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in (0, 1)], names=["column", "example"])

    return cells.mapInArrow(smallest, "column string, example string")


def coverage_report(frames: DataFrame | list[DataFrame], denominator: str = "all") -> DataFrame:
    """Per column: non_null, total, coverage, distinct estimate, zeros, examples (five smallest distinct values).

    ``frames`` may be the header groups of a scan. ``denominator="present"``
    divides by the rows of the groups that have the column, ``"all"`` by all rows.
    Wide groups are profiled some columns at a time, each pass reading only its
    columns of a columnar source.
    """
    groups = frames if isinstance(frames, list) else [frames]
    rows = examples = None
    for g in groups:
        for i in range(0, len(g.columns), COLUMNS_PER_PASS):
            names = g.columns[i:i + COLUMNS_PER_PASS]
            part, values = _profile_columns(g, names), example_values(g, names)
            rows = part if rows is None else rows.unionByName(part)
            examples = values if examples is None else examples.unionByName(values)
    report = rows.groupBy("column").agg(
        F.sum("non_null").alias("non_null"), F.sum("total").alias("total"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
        F.sum("zeros").alias("zeros"),
    )
    few = examples.groupBy(F.col("column").alias("_column")).agg(
        F.slice(F.array_sort(F.collect_set("example")), 1, _EXAMPLES).alias("e"))
    report = report.join(F.broadcast(few), F.col("column") == F.col("_column"), "left")       # a row per column
    if denominator == "all" and len(groups) > 1:
        whole = sum(g.count() for g in groups)
        report = report.withColumn("total", F.lit(whole).cast("long"))
    return report.select(
        "column", "non_null", "total",
        F.round(F.col("non_null") / F.greatest(F.col("total"), F.lit(1)), 6).alias("coverage"),
        "distinct_estimate", "zeros", F.coalesce(F.array_join("e", "; "), F.lit("")).alias("examples"),
    )


def select_columns(report: DataFrame, min_pct: float = 0.85, top_n: int = 0,
                   time: str = RAW_TIMESTAMP) -> list[str]:
    """Names to keep, time first; the report has one row per column, so it is small."""
    kept = report.filter(F.col("coverage") >= min_pct).orderBy(
        F.desc("coverage"), F.desc("non_null"), "column")
    if top_n > 0:
        kept = kept.limit(top_n)
    names = [r["column"] for r in kept.select("column").collect()]
    if report.filter(F.col("column") == time).limit(1).count():
        names = [time] + [n for n in names if n != time]
    return names


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: type, rows and missing rows."""
    types = dict(df.dtypes)
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.count("*").alias("rows"),
                 F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"))
        for c in df.columns
    ]
    return df.agg(F.array(*cells).alias("p")).select(F.inline("p"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; exact mode counts after a distinct of (column, value)."""
    if approximate:
        cells = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(f"`{c}`").alias("n_distinct"))
                 for c in columns]
        return df.agg(F.array(*cells).alias("p")).select(F.inline("p"))
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns
    ])
    return (
        df.select(F.inline(pairs)).distinct().groupBy("column").agg(F.count("value").alias("n_distinct"))
    )


def uniform_sample(df: DataFrame, n: int, seed: int = 42, key: str = "event_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniform and repeatable: those with the smallest seeded keys.

    The cut key is found by counting key prefixes, so no task sorts the table. Rows without a key are drawn by their
    content. Rows that share the cut key are in order of their content's hash, and of fully equal ones any will do.
    """
    k = row_key(df, key, seed, "sample")
    (cut,) = hex_cutoffs(df, k, [n])
    if cut is None:
        return df
    below, at = df.agg(F.count_if(k < cut), F.count_if(k == cut)).first()
    if below + at == n:
        return df.filter(k <= cut)
    ties, content = df.filter(k == cut), F.md5(F.to_json(F.struct("*")))
    (last,) = hex_cutoffs(ties, content, [n - below])
    inside = ties.agg(F.count_if(content < last)).first()[0]
    return df.filter(k < cut).union(ties.filter(content < last)).union(ties.filter(content == last).limit(n - below - inside))


def counted(df: DataFrame, name: str, time: str = "timestamp") -> tuple[DataFrame, Observation]:
    """``df`` with row and missing-time counts taken along by the next action (no extra pass)."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), F.count_if(F.col(time).isNull()).alias("no_time")), seen


def cleaning_report(raw: DataFrame, clean: DataFrame, mapping: dict[str, str | None],
                    dropped: list[str]) -> DataFrame:
    """Long report (metric, key, value): sizes, mapping, dropped columns, types, null counts, duplicates."""
    spark = raw.sparkSession
    n_raw, n_clean = raw.count(), clean.count()
    facts = [("rows_raw", "", str(n_raw)), ("cols_raw", "", str(len(raw.columns))),
             ("rows_clean", "", str(n_clean)), ("cols_clean", "", str(len(clean.columns))),
             ("duplicates_removed", "event_id", str(n_raw - n_clean))]
    facts += [("mapping", k, v or "") for k, v in mapping.items()]
    facts += [("dropped_column", c, "") for c in dropped]
    facts += [("dtype", c, t) for c, t in clean.dtypes]
    nulls = null_counts(clean).select(
        F.lit("null_count").alias("metric"), F.col("column").alias("key"),
        F.col("nulls").cast("string").alias("value"))
    return spark.createDataFrame(facts, "metric string, key string, value string").unionByName(nulls)


# --- corpus description -------------------------------------------------------

def corpus_summary(df: DataFrame, extra_columns: list[str] | None = None) -> DataFrame:
    """Rows, time range and distinct counts (agents, rules, decoders and any extra columns)."""
    names = {"agents": "agent", "rules": "rule_id", "decoders": "decoder",
             **{c: c for c in extra_columns or []}}
    distinct = distinct_counts(df, list(names.values()))
    wide = distinct.agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("n_distinct"))), F.lit(0)).alias(f"n_{k}")
        for k, c in names.items()
    ])
    base = df.agg(F.count("*").alias("rows"), F.min("timestamp").alias("min_time"),
                  F.max("timestamp").alias("max_time"))
    found = wide.select(F.struct("*")).scalar()
    return base.select("*", *[found.getField(f"n_{k}").alias(f"n_{k}") for k in names])


def per_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("alerts"))


def per_hour(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("alerts"))


def per_weekday(df: DataFrame) -> DataFrame:
    return df.groupBy(F.weekday("timestamp").alias("weekday")).agg(F.count("*").alias("alerts"))


def off_hours_share(df: DataFrame) -> DataFrame:
    off = F.count_if(F.hour("timestamp") <= 6)
    return df.agg(F.count("*").alias("alerts"), off.alias("off_hours"),
                  F.round(off / F.count("*"), 6).alias("share"))


def hour_weekday_matrix(df: DataFrame) -> DataFrame:
    """24 rows by seven weekday columns, Monday first."""
    days = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    return df.groupBy(F.hour("timestamp").alias("hour")).agg(
        *[F.count_if(F.weekday("timestamp") == i).alias(d) for i, d in enumerate(days)]
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with their share of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("alerts"))
    total = df.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("share", F.round(F.col("alerts") / total, 6))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        df.groupBy(column).agg(F.count("*").alias("alerts"))
        .orderBy(F.desc("alerts"), F.col(column)).limit(n)
    )


def top_groups(df: DataFrame, json_list: str, n: int = 10) -> DataFrame:
    """Most frequent members of a column that holds a JSON list of names."""
    member = F.explode(F.from_json(F.col(f"`{json_list}`"), "array<string>")).alias("group")
    return top_values(df.select(member), "group", n)
