"""Labelled synthetic anomalies in a validation window.

Every draw is a function of (event id, seed, purpose). Which rows are changed is
decided by cut keys on a uniform hash, so no row order and no global sort is
needed and every row's family is a plain expression.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CANONICAL, FAMILIES
from ..functions.hashing import draw_int, row_key
from ..functions.numbers import outlier_level
from ..functions.times import with_clock
from ..session import settle
from .quantiles import hex_cutoffs, rank_rows
from .split import window_rows

FALLBACK_LOW, FALLBACK_WIDTH = 1_000_000, 8_999_999
REQUESTS_PER_SALT = 200_000
GAP_PLACES = 10_000          # unseen places that one row is spread to at once


def family_weights(spec: str = "") -> dict[str, float]:
    """``offhours:2,level_out:1`` to shares; unnamed families weigh 1, unknown names are ignored."""
    given = dict(item.split(":") for item in spec.replace(" ", "").split(",") if item)
    raw = {f: float(given.get(f, 1.0)) for f in FAMILIES}
    total = sum(raw.values())
    return {f: w / total for f, w in raw.items()}


def family_counts(n_window: int, rate: float, shares: dict[str, float]) -> dict[str, int]:
    """Whole rows per family: the rounded budget, truncated shares, rest to the heaviest first."""
    budget = max(1, round(n_window * max(0.0, rate)))
    counts = {f: int(s * budget) for f, s in shares.items()}
    heaviest = sorted(shares, key=lambda f: -shares[f])
    for i in range(budget - sum(counts.values())):
        counts[heaviest[i % len(heaviest)]] += 1
    return counts


def seen_pairs(df: DataFrame, value: str) -> DataFrame:
    """Distinct (agent, value); alerts without agent or value do not count."""
    return df.filter(F.col("agent").isNotNull() & F.col(value).isNotNull()).select("agent", value).distinct()


def host_level_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("agent").agg(F.avg("rule_level").alias("mu"))


def vocabulary(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their 0-based place in text order."""
    values = df.filter(F.col(value).isNotNull()).select(value).distinct()
    return rank_rows(values, [F.col(value)], rank_col="_place").select(value, (F.col("_place") - 1).alias("idx"))


def _seen_places(seen: DataFrame, vocab: DataFrame, value: str) -> DataFrame:
    """Per agent the seen places in order: ``pos`` = how many seen before, ``gap`` = how many unseen before."""
    by_place = Window.partitionBy("agent").orderBy("idx")
    placed = seen.join(vocab, value).select("agent", "idx")
    pos = F.row_number().over(by_place) - 1
    return placed.withColumn("pos", pos).withColumn("gap", F.col("idx") - F.col("pos"))


def unseen_gaps(hosts: DataFrame, seen: DataFrame, vocab: DataFrame, value: str) -> DataFrame:
    """What each agent has not seen, as gaps in the vocabulary's order: agent, first, last, n_values.

    A gap is a run of unseen places between two seen ones or an end, so an agent has at most one row more than values it
    has seen; nothing is listed for each agent and value.
    """
    gaps = _gap_places(hosts, seen, vocab, value)
    first, last = (vocab.select(F.col("idx").alias(f"_{side}"), F.col(value).alias(name)) for side, name in (("from", "first"), ("to", "last")))
    return gaps.join(first, "_from").join(last, "_to").select(
        "agent", "first", "last", (F.col("_to") - F.col("_from") + 1).alias("n_values"))


def unseen_values(hosts: DataFrame, seen: DataFrame, vocab: DataFrame, value: str) -> DataFrame:
    """Every (agent, value) not seen, listed from the gaps between seen places: no row is made that is not given back."""
    gaps = _gap_places(hosts, seen, vocab, value)
    cut = gaps.select("agent", "_to", F.explode(F.sequence("_from", "_to", F.lit(GAP_PLACES))).alias("_from"))
    free = cut.select("agent", F.explode(F.sequence("_from", F.least("_to", F.col("_from") + (GAP_PLACES - 1)))).alias("idx"))
    return free.join(vocab, "idx").select("agent", value)


def _gap_places(hosts: DataFrame, seen: DataFrame, vocab: DataFrame, value: str) -> DataFrame:
    """Per agent the runs of unseen places, from ``_from`` to ``_to``."""
    size = vocab.count()
    placed = seen.join(vocab, value).select("agent", "idx")
    ends = hosts.select("agent").distinct().select("agent", F.lit(size).cast("long").alias("idx"))
    prev = F.lag("idx", 1, -1).over(Window.partitionBy("agent").orderBy("idx"))
    return placed.unionByName(ends).select("agent", (prev + 1).alias("_from"), (F.col("idx") - 1).alias("_to")).filter("_from <= _to")


def draw_unseen(requests: DataFrame, seen: DataFrame, vocab: DataFrame, value: str,
                seed: int, fallback: str) -> DataFrame:
    """For each request (event_id, agent) one uniformly drawn value its host has not seen.

    The r-th unseen place of a host is r plus the number of seen places that have
    at most r unseen ones before them: a running maximum over seen places and
    requests of the host. Hosts with many requests are salted. A host that has
    seen everything gets ``fallback`` and seven digits.
    """
    size = vocab.count()
    places = _seen_places(seen, vocab, value)
    seen_n = places.groupBy("agent").agg(F.count("*").alias("n")).select(F.col("agent").alias("_a"), "n")
    asked = requests.join(seen_n, F.col("agent") == F.col("_a"), "left").select(
        "event_id", "agent", (F.lit(size) - F.coalesce("n", F.lit(0))).alias("free"))
    word = draw_int(F.col("event_id"), seed, value, 0, 1 << 32)
    asked = asked.withColumn("r", F.when(F.col("free") > 0, word % F.greatest("free", F.lit(1))))

    salts = requests.groupBy("agent").agg(
        F.ceil(F.count("*") / F.lit(REQUESTS_PER_SALT)).cast("int").alias("salts"))
    salts = salts.select(F.col("agent").alias("_a"), "salts")
    one_salt = F.pmod(F.xxhash64("event_id"), F.col("salts")).cast("int").alias("salt")
    points = asked.filter("r IS NOT NULL").join(salts, F.col("agent").eqNullSafe(F.col("_a"))).select(
        "agent", one_salt, F.col("r").alias("v"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("seen_here"), "event_id")
    marks = places.join(salts, F.col("agent") == F.col("_a")).select(
        "agent", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("gap").alias("v"),
        F.lit(0).alias("kind"), (F.col("pos") + 1).cast("long").alias("seen_here"),
        F.lit(None).cast("string").alias("event_id"))
    run = Window.partitionBy("agent", "salt").orderBy("v", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    picked = points.unionByName(marks).withColumn("_seen", F.max("seen_here").over(run)).filter("kind = 1").select(
        "event_id", (F.col("v") + F.coalesce("_seen", F.lit(0))).alias("idx"))
    drawn = picked.join(vocab, "idx").select("event_id", F.col(value).alias("drawn"))
    digits = draw_int(F.col("event_id"), seed, f"{value}:none", FALLBACK_LOW, FALLBACK_WIDTH).cast("string")
    none_left = asked.filter("r IS NULL").select("event_id", F.concat(F.lit(fallback), digits).alias("drawn"))
    return drawn.unionByName(none_left)


def assign_families(window: DataFrame, counts: dict[str, int], seed: int) -> DataFrame:
    """Adds ``synth_usecase``: disjoint uniform choices of exactly ``counts`` rows, else empty.

    Cut keys make the family a plain expression of the row. Where rows share a cut key (repeated ids), rows are numbered
    by key and content instead.
    """
    key = row_key(window, "event_id", seed, "assign")
    ends, total = [], 0
    for f in FAMILIES:
        total += counts[f]
        ends.append(total)
    cuts = hex_cutoffs(window, key, ends)
    real = [(cut, end) for cut, end in zip(cuts, ends) if cut is not None]
    held = window.agg(F.array(*[F.count_if(key <= F.lit(cut)) for cut, _ in real], F.lit(0).cast("long"))).first()[0]
    if any(n != end for n, (_, end) in zip(held, real)):
        order = [key, F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in window.columns])))]
        numbered = rank_rows(window, order, rank_col="_nth")
        family = F.lit("")
        for f, end in reversed(list(zip(FAMILIES, ends))):
            family = F.when(F.col("_nth") <= end, F.lit(f)).otherwise(family) if counts[f] else family
        return numbered.withColumn("synth_usecase", family).drop("_nth")
    family: Column = F.lit("")
    for f, cut, n in reversed(list(zip(FAMILIES, cuts, (counts[f] for f in FAMILIES)))):
        if n and cut is None:              # the window has fewer rows than asked for
            family = F.lit(f)
        elif n:
            family = F.when(key <= F.lit(cut), F.lit(f)).otherwise(family)
    return window.withColumn("synth_usecase", family)


def _shift_clock(seed: int) -> Column:
    e = F.col("event_id")
    return with_clock(
        F.col("timestamp"), draw_int(e, seed, "hour", 0, 7).cast("int"),
        draw_int(e, seed, "minute", 0, 60).cast("int"), draw_int(e, seed, "second", 0, 60).cast("int"),
        draw_int(e, seed, "milli", 0, 1000))


def disturb(chosen: DataFrame, history: DataFrame, rules: DataFrame, decoders: DataFrame, seed: int) -> DataFrame:
    """Apply each row's family: new clock, unseen rule, unseen decoder or outlier level."""
    rule = draw_unseen(chosen.filter("synth_usecase = 'rule_new'").select("event_id", "agent"),
                       seen_pairs(history, "rule_id"), rules, "rule_id", seed, "9")
    decoder = draw_unseen(chosen.filter("synth_usecase = 'decoder_new'").select("event_id", "agent"),
                          seen_pairs(history, "decoder"), decoders, "decoder", seed, "dec_")
    drawn = rule.unionByName(decoder).select(F.col("event_id").alias("_id"), "drawn")
    means = host_level_mean(history).select(F.col("agent").alias("_a"), "mu")
    is_ = lambda f: F.col("synth_usecase") == f
    bump = draw_int(F.col("event_id"), seed, "bump", 0, 2)
    return (
        chosen.join(drawn, F.col("event_id") == F.col("_id"), "left")
        .join(means, F.col("agent") == F.col("_a"), "left")
        .withColumns({
            "timestamp": F.when(is_("offhours"), _shift_clock(seed)).otherwise(F.col("timestamp")),
            "rule_id": F.when(is_("rule_new"), F.col("drawn")).otherwise(F.col("rule_id")),
            "decoder": F.when(is_("decoder_new"), F.col("drawn")).otherwise(F.col("decoder")),
            "rule_level": F.when(is_("level_out"), outlier_level(F.col("mu"), bump)).otherwise(F.col("rule_level")),
        })
        .select(*CANONICAL, "synth_usecase")
    )


def _labels(df: DataFrame, split: str, injected: Column) -> DataFrame:
    history = split == "T1"
    flag = F.lit(0) if history else injected.cast("int")
    return df.select(
        *CANONICAL, F.lit(split).alias("split"), flag.alias("is_synth_anom"),
        (F.lit(None).cast("int") if history else flag).alias("y_true_synth"),
        F.lit(0 if history else 1).alias("y_mask_eval"),
        (F.lit("") if history else F.col("synth_usecase")).alias("synth_usecase"))


def inject(
    df: DataFrame, cutoff: str, start: str, end: str, rate: float = 0.03, weights: str = "",
    seed: int = 42, mode: str = "replace", vocab: str = "history+window", with_history: bool = False,
) -> DataFrame:
    """Labelled window, optionally with the labelled history in front.

    ``mode="replace"`` changes rows in place, ``"append"`` keeps the originals and
    adds changed copies with ``-synth`` behind their id. ``vocab="all"`` also
    draws from values first seen after the window.
    """
    history = window_rows(df, "T1", cutoff, start, end)
    window = window_rows(df, "T2", cutoff, start, end)
    n = window.count()
    if n == 0:
        raise ValueError("the validation window has no rows")
    counts = family_counts(n, rate, family_weights(weights))
    known = df if vocab == "all" else history.unionByName(window)
    marked = assign_families(window.select(*CANONICAL), counts, seed)
    chosen = settle(marked.filter("synth_usecase <> ''"))
    rules, decoders = (settle(vocabulary(known, v)) for v in ("rule_id", "decoder"))
    changed = disturb(chosen, history, rules, decoders, seed)
    if mode == "append":
        copies = changed.withColumn("event_id", F.concat("event_id", F.lit("-synth")))
        whole = marked.withColumn("synth_usecase", F.lit("")).unionByName(copies)
    elif mode == "replace":
        whole = marked.filter("synth_usecase = ''").unionByName(changed)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    labelled = _labels(whole, "T2_synth", F.col("synth_usecase") != "")
    return _labels(history, "T1", F.lit(0)).unionByName(labelled) if with_history else labelled


def family_summary(labelled: DataFrame) -> DataFrame:
    return labelled.filter("is_synth_anom = 1").groupBy("synth_usecase").agg(F.count("*").alias("alerts"))
