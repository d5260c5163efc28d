"""Exact order statistics and exact ranks without a single hot task.

``values_at`` finds the values at given ranks of all groups at once by counted
buckets. ``exact_quantiles`` bounds ranks by a sketch first, so that the rows are read
twice. ``rank_rows`` numbers rows by a range-sorted table, so no window partition holds
a whole group.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, small_side

SMALL_ROWS = 200_000
_BUCKETS = 1024
_SKETCH_K = 4096
#: A sketch's ranks are off by about 0.0013 of the rows; a rank outside its interval is found in the whole range.
_SLACK = 0.004


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], small_rows: int = SMALL_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolated percentiles of several DOUBLE columns, NULL and NaN ignored.

    The rows are read twice. The first pass counts them and builds a KLL sketch per
    column. Up to ``small_rows`` the second one is the built-in percentile (its state is
    bounded by that count). Beyond it the sketches give an interval for every wanted
    rank, and the second pass counts, with map-side combine, the rows between intervals
    and the values inside; that settled table of counted values gives the exact ranks.
    Infinite values are ranks of their own in both ways, and both interpolate with the
    same weights.
    """
    data = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}")
                       for i, c in enumerate(columns)])
    ends = [min(1.0, max(0.0, p + side)) for p in probs for side in (-_SLACK, _SLACK)]
    facts = data.agg(*[F.struct(
        F.count(f"x{i}").alias("n"), F.min(f"x{i}").alias("lo"), F.max(f"x{i}").alias("hi"),
        F.when(F.count(f"x{i}") > small_rows, F.array(*[F.kll_sketch_get_quantile_double(
            F.kll_sketch_agg_double(f"x{i}", F.lit(_SKETCH_K)), F.lit(r)) for r in ends])).alias("q"),
    ).alias(f"x{i}") for i in range(len(columns))]).first()
    if max(f["n"] for f in facts) <= small_rows:
        row = data.agg(*[F.percentile(f"x{i}", probs).alias(f"x{i}") for i in range(len(columns))]).first()
        return {c: list(r) if r is not None else [None] * len(probs) for c, r in zip(columns, row, strict=True)}

    positions = [[p * (f["n"] - 1) for p in probs] if f["n"] else [] for f in facts]
    ranks = [sorted({int(g(x)) for x in xs for g in (math.floor, math.ceil)}) for xs in positions]
    intervals = [_merged(f, ends) if f["n"] else [] for f in facts]
    found = _ranked(data, facts, ranks, intervals)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = [None] * len(probs) if not facts[i]["n"] else []
        for x in positions[i]:
            low, high = math.floor(x), math.ceil(x)
            a, b = found[i, low], found[i, high]
            out[c].append(a if low == high or a == b else (high - x) * a + (x - low) * b)
    return out


def _merged(facts, ends: list[float]) -> list[tuple[float, float]]:
    """Disjoint intervals, in order, that hold the wanted ranks by the sketch's word."""
    q = facts["q"] or [facts["lo"], facts["hi"]] * (len(ends) // 2)
    pairs = sorted((facts["lo"] if ends[2 * j] == 0.0 else q[2 * j], facts["hi"] if ends[2 * j + 1] == 1.0 else q[2 * j + 1])
                   for j in range(len(ends) // 2))
    out = [pairs[0]]
    for lo, hi in pairs[1:]:
        if lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _ranked(data: DataFrame, facts, ranks: list[list[int]], intervals: list[list[tuple[float, float]]]) -> dict:
    """(column, 0-based rank) to value, from one pass that counts what lies in the intervals and between them."""
    cells = []
    for i, spans in enumerate(intervals):
        x = F.col(f"x{i}")
        if spans:
            passed = sum((F.when(x > hi, 1).otherwise(0) for _, hi in spans), F.lit(0))
            inside = F.get(F.array(*[F.lit(float(lo)) for lo, _ in spans]), passed) <= x
            cells.append(F.when(x.isNotNull(), F.struct(
                F.lit(i).alias("i"), passed.alias("slot"), F.when(inside, x).alias("x"))))
    counted = settle(data.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("i", "slot", "x").agg(
        F.count(F.lit(1)).alias("n")))
    sums = {(r["i"], r["slot"], r["gap"]): r["n"] for r in counted.groupBy(
        "i", "slot", F.col("x").isNull().alias("gap")).agg(F.sum("n").alias("n")).collect()}
    wanted, missed = [], []
    for i, spans in enumerate(intervals):
        seen, todo = 0, list(ranks[i])
        for slot in range(len(spans) + 1):
            seen += sums.get((i, slot, True), 0)
            missed += [(i, 0, r, facts[i]["lo"], facts[i]["hi"], 0) for r in todo if r < seen]
            todo = [r for r in todo if r >= seen]
            n = sums.get((i, slot, False), 0)
            wanted += [(i, slot, r, *map(float, spans[slot]), seen) for r in todo if r < seen + n]
            seen, todo = seen + n, [r for r in todo if r >= seen + n]
    spark, schema = data.sparkSession, "i int, slot int, rank bigint, lo double, hi double, below bigint"
    parts = [values_at(counted.where("x IS NOT NULL"), ["i", "slot"], spark.createDataFrame(wanted, schema))] if wanted else []
    if missed:
        long = data.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(0).alias("slot"), F.col(f"x{i}").alias("x"))
                                              for i in range(len(ranks))]))).where("x IS NOT NULL").withColumn("n", F.lit(1))
        parts.append(values_at(settle(long), ["i", "slot"], spark.createDataFrame(missed, schema)))
    return {(r["i"], r["rank"]): r["value"] for part in parts for r in part.collect()}


def _slot(x: Column, lo: Column, hi: Column) -> Column:
    """Bucket of a value within [lo, hi], as a number that grows with the value.

    Infinite ends are cut off first. An interval too wide for a finite width is halved
    in scale; one too narrow for a width holds few numbers, each its own bucket.
    """
    step = hi / _BUCKETS - lo / _BUCKETS
    endless = F.when(x == -math.inf, -1.0).when(x == math.inf, 2.0).when(x < 0, 0.0).otherwise(1.0)
    even = F.least(F.floor(x / F.nullif(step, F.lit(0.0)) - lo / F.nullif(step, F.lit(0.0))), F.lit(_BUCKETS - 1)).cast("double")
    return F.when((lo == -math.inf) | (hi == math.inf), endless).when(
        (step == 0) | (lo + step == lo) | (hi - step == hi), x).otherwise(even)


def twin(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its keys renamed for a join with a frame that has them too."""
    return df.withColumnsRenamed({k: f"_g_{k}" for k in keys})


def same_keys(keys: list[str]) -> Column:
    """Null-safe equality of each key with its twin."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`_g_{k}`"))
    return cond


def values_at(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, rank, value): the values at 0-based ascending ranks of all groups at once.

    ``rows`` (keys, x, n) is a settled table of counted values without NULL or NaN; ``wanted`` (keys, rank, lo, hi,
    below) names for each rank an interval that holds it and the rows below that. Every round counts 1024 buckets per
    open interval in one pass and goes on in the bucket of each rank, so a group may hold any share of the rows; an
    interval ends where it holds one value.
    """
    cols = [f"`{k}`" for k in keys]
    open_, done = settle(wanted.select(*cols, "rank", "lo", "hi", "below")), []
    ahead = Window.partitionBy(*cols, "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        done.append(open_.where("lo = hi").select(*cols, "rank", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")
        if not open_.limit(1).count():
            break
        spans = small_side(twin(open_.select(*cols, "lo", "hi").distinct(), keys))
        met = rows.join(spans, same_keys(keys) & F.col("x").between(F.col("lo"), F.col("hi")))
        counted = met.withColumn("b", _slot(F.col("x"), F.col("lo"), F.col("hi"))).groupBy(*cols, "lo", "hi", "b").agg(
            F.sum("n").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        placed = twin(counted.withColumn("before", F.coalesce(F.sum("m").over(ahead), F.lit(0))), [*keys, "lo", "hi"])
        hit = open_.join(placed, same_keys([*keys, "lo", "hi"]))
        below, last = F.col("below") + F.col("before"), F.col("below") + F.col("before") + F.col("m") - 1
        hit = hit.where(F.col("rank").between(below, last))
        open_ = settle(hit.select(
            *cols, "rank",
            F.when(F.col("rank") == last, F.col("most")).otherwise(F.col("least")).alias("lo"),
            F.when(F.col("rank") == below, F.col("least")).otherwise(F.col("most")).alias("hi"), below.alias("below")))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def hex_cutoffs(df: DataFrame, key: Column, ranks: list[int], bound: int = 100_000) -> list[str | None]:
    """For each 1-based rank the key at that rank in ascending order of hex keys.

    Keys must be uniform hex text (an MD5). The keys are computed and settled once.
    Each level counts the prefixes, four digits longer, of all branches that hold a
    wanted rank in one pass; branches of few keys are read in one more.
    """
    keys = settle(df.select(key.alias("k")))
    found: dict[int, str] = {}
    todo = [("", 0, {r for r in ranks if r > 0})]
    width = 0
    while any(wanted for _, _, wanted in todo):
        inside = [p for p, _, _ in todo]
        here = keys.filter(F.left("k", F.lit(width)).isin(inside)) if width else keys
        width += 4
        counts = here.groupBy(F.left("k", F.lit(width)).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        few, many = [], []
        for prefix, seen, wanted in todo:
            for r in counts:
                if r["p"].startswith(prefix):
                    hit = {k for k in wanted if seen < k <= seen + r["n"]}
                    if hit:
                        (few if r["n"] <= bound else many).append((r["p"], seen, hit))
                    seen += r["n"]
        if few:
            rows: dict[str, list[str]] = {}
            for r in keys.filter(F.left("k", F.lit(width)).isin([p for p, _, _ in few])).collect():
                rows.setdefault(r["k"][:width], []).append(r["k"])
            for p, seen, hit in few:
                ordered = sorted(rows[p])
                found.update({k: ordered[k - seen - 1] for k in hit})
        if width >= 32:
            found.update({k: p for p, _, hit in many for k in hit})
            break
        todo = many
    return [found.get(r) for r in ranks]


def rank_rows(
    df: DataFrame, order: list[Column], group: list[str] | None = None, rank_col: str = "rank",
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Exact 1-based ranks, globally or per group, safe for any group size.

    Small inputs use a window. Larger ones are range-sorted on (group, order),
    settled so the numbering cannot change, and numbered as partition offset plus
    position; a group's rank is the global position minus the rows before it.
    ``order`` should end in a unique column: it makes ranks repeatable and lets
    the range sort split ties.
    """
    keys = group or []
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")) if keys else df.agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= small_rows:
        spec = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(spec).cast("long"))

    id_, part, place, start = (_free_name(df.columns, n) for n in ("_nth_id", "_nth_part", "_nth_place", "_nth_start"))
    ordered = df.orderBy(*[F.col(k).asc_nulls_first() for k in keys], *order)
    numbered = settle(ordered.withColumn(id_, F.monotonically_increasing_id()))
    in_part, pos = F.shiftright(id_, 33), F.col(id_).bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)         # one row per partition
    offsets = numbered.groupBy(in_part.alias(part)).agg(F.count("*").alias("n")).select(
        part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    placed = numbered.withColumn(part, in_part).join(F.broadcast(offsets), part).withColumn(
        place, F.col(start) + pos + 1).select(*[F.col(f"`{c}`") for c in df.columns], place)
    if not keys:
        return placed.withColumn(rank_col, F.col(place)).drop(place)
    starts = placed.groupBy(*keys).agg(F.min(place).alias(start))
    same = [placed[k].eqNullSafe(starts[k]) for k in keys]
    joined = placed.join(starts, same, "left")
    for k in keys:
        joined = joined.drop(starts[k])
    wide = joined.withColumn(rank_col, F.col(place) - F.col(start) + 1)
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], *([] if rank_col in df.columns else [rank_col]))


def _free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column (in either case of letters) has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name
