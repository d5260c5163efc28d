"""Conversations as budgeted windows of formatted turns with a loss mask."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import textbytes as tb
from .common import buckets, settle
from .wordpieces import default_path, encoder

# The marks of the template by role; any other role is written out between marks of its own.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/END]\n")
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/END]")

_HIDE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL))
_SHOW = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROL))
TARGET, SYSTEM = "assistant", "system"
BUDGET, HISTORY = 2048, 2
#: Bytes of a conversation after which it goes on in another chunk, so that no task needs it as a whole.
CHUNK_BYTES = 4 << 20
#: What a turn counts besides its text, so that empty turns fill chunks too.
TURN_BYTES = 64
#: Long conversations up to which their list is broadcast.
BROADCAST_ROWS = 100_000
OWN, CARRIED_SYSTEM, CARRIED_HISTORY = 0, 1, 2


def escape(text: str) -> str:
    """The text with a backslash more behind the first character of control strings, plain or escaped before."""
    return _HIDE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: m[0][0] + m[0][2:], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn with its marks, and where its escaped text begins and ends."""
    head, tail = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window, escapes taken back. Escaped texts hold no mark, so the next one closes."""
    turns, at = [], 0
    while at < len(window):
        for role, (head, tail) in MARKS.items():
            if window.startswith(head, at):
                break
        else:
            role, head, tail = None, *OTHER[::2]
            if not window.startswith(head, at):
                raise ValueError(f"no turn at {at}")
        at += len(head)
        if role is None:
            end = window.index(OTHER[1], at)
            role, at = unescape(window[at:end]), end + len(OTHER[1])
        end = window.index(tail, at)
        turns.append((role, unescape(window[at:end])))
        at = end + len(tail)
    return turns


def spans(tokens: np.ndarray, first: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Windows (start of the repeated history, start and end of the new turns) over turns from ``first`` on.

    Ends are found in the prefix sums of the tokens. History is at most ``history`` turns and a quarter of the budget,
    and leaves room for the next turn; a turn that does not fit a window has one of its own.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    out, at = [], first
    while at < len(tokens):
        repeated = min(budget // 4, budget - int(tokens[at]))
        begin = at if repeated < 0 else max(0, at - history, int(np.searchsorted(sums, sums[at] - repeated, "left")))
        end = max(at + 1, int(np.searchsorted(sums, sums[begin] + budget, "right")) - 1)
        out.append((begin, at, end))
        at = end
    return out


def chunk_windows(chunk: int, turns: list[tuple], budget: int, history: int):
    """Windows (number, n_system, n_history, n_turns, n_tokens, text, loss) of one chunk of a conversation.

    ``turns`` are (how it came, role, text, head, tail, tokens) in order; carried ones come before the chunk's own.
    """
    carried = turns[0][0] == CARRIED_SYSTEM
    lead = turns[:1] if carried or (chunk == 0 and turns[0][1] == SYSTEM) else []
    rest = turns[len(lead):]
    first = next((i for i, t in enumerate(rest) if t[0] == OWN), len(rest))
    room = max(1, budget - sum(t[5] for t in lead))
    cuts = spans(np.array([t[5] for t in rest], np.int64), first, room, history)
    if lead and not carried:
        cuts = cuts or [(0, 0, 0)]
    for number, (begin, at, end) in enumerate(cuts):
        opens = bool(lead) and not carried and number == 0
        part, known = lead + rest[begin:end], (0 if opens else len(lead)) + at - begin
        place, loss = 0, []
        for k, (_, role, text, head, tail, _) in enumerate(part):
            if role == TARGET and k >= known:
                loss.append({"start": place + head, "end": place + tail})
            place += len(text)
        yield (number, known - (at - begin), at - begin, len(part) - known, sum(t[5] for t in part),
               "".join(t[2] for t in part), loss)


def _chunks(turns: DataFrame, chunk_bytes: int, history: int, long_: DataFrame) -> DataFrame:
    """Rows of long conversations with their chunk, and copies of the turns that later chunks carry along.

    Sizes before a turn are prefix sums in two steps, over range-sorted parts and inside them, of rows without texts;
    equal rows count as one with a number of copies. No step needs all rows of a conversation in one task.
    """
    spark = turns.sparkSession
    keys = turns.join(long_, turns["conv_id"].eqNullSafe(long_["long_id"]), "left_semi").withColumn(
        "tie", F.xxhash64("role", "text")).withColumn("size", F.octet_length("text") + F.lit(TURN_BYTES))
    order = ["turn", "tie"]
    narrow = keys.groupBy("conv_id", *order).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.first("role").alias("role"))
    narrow = settle(narrow.repartitionByRange(buckets(spark), "conv_id", *order).sortWithinPartitions("conv_id", *order)
                    .withColumn("part", F.spark_partition_id()), "turns")
    parts = narrow.groupBy("conv_id", "part").agg(F.sum("size").alias("size"), F.sum("copies").alias("copies"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"),
        *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"{x}_ahead") for x in ("size", "copies")])
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_chunk = Window.partitionBy("conv_id", "chunk")
    placed = narrow.join(parts, narrow["conv_id"].eqNullSafe(parts["c"]) & (narrow["part"] == parts["p"])).withColumn(
        "nth", F.col("copies_ahead") + F.coalesce(F.sum("copies").over(inside), F.lit(0))).withColumn(
        "chunk", F.floor((F.col("size_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))) / F.lit(chunk_bytes))).withColumn(
        "system", (F.col("nth") == 0) & (F.col("role") == SYSTEM)).withColumn(
        "next", (F.col("nth") + F.col("copies") > F.max(F.col("nth") + F.col("copies")).over(of_chunk) - history) & ~F.col("system"))
    placed = settle(placed.select("conv_id", *order, "nth", "chunk", "system", "next"), "turns")
    last = placed.groupBy("conv_id").agg(F.max("chunk").alias("last")).withColumnRenamed("conv_id", "l")
    placed = placed.join(last, F.col("conv_id").eqNullSafe(F.col("l"))).drop("l").toDF(
        "c", "t", "h", "nth", "chunk", "system", "next", "last")
    none = F.array().cast("array<struct<chunk:bigint,came:int>>")

    def copy(chunk, came):
        return F.struct(chunk.cast("long").alias("chunk"), F.lit(came).alias("came"))

    copies = F.concat(
        F.array(copy(F.col("chunk"), OWN)),
        F.when(F.col("system") & (F.col("last") > 0), F.transform(
            F.sequence(F.lit(1).cast("long"), F.col("last")), lambda x: copy(x, CARRIED_SYSTEM))).otherwise(none),
        F.when(F.col("next") & (F.col("chunk") < F.col("last")),
               F.array(copy(F.col("chunk") + 1, CARRIED_HISTORY))).otherwise(none))
    return keys.join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (
        F.col("tie") == F.col("h"))).select("conv_id", F.explode(copies).alias("to"), "nth", "role", "text").select(
        "conv_id", "to.chunk", "to.came", "nth", "role", "text")


_LOSS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
_COUNTS = ("n_system", "n_history", "n_turns", "n_tokens")


def windows(convs: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None,
            chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Windows of at most ``budget`` tokens of the conversations in ``convs`` (conv_id, turn, role, text).

    Returns conv_id, chunk, window, n_system, n_history, n_turns, n_tokens, text, loss and long. A window's ``text``
    holds, each between the marks of its role, the conversation's system turn (n_system, from the second window on),
    up to ``history`` turns that the window before ended with (n_history) and the next n_turns turns. ``loss`` lists the
    spans (code points, end exclusive) of assistant texts among the latter, so every one is a target once. Marks inside
    texts are escaped; ``parse`` gives roles and texts back. Rows of one chunk are in order in one partition.

    Method: prefix sums of the tokens of formatted turns choose turn-aligned spans. A turn that does not fit beside the
    system turn has a window of its own beyond the budget; nothing is cut or left out. A conversation of more than
    ``chunk_bytes`` (``long``) is cut into chunks, whose windows are made in different tasks.

    Turns are in order of turn (null first), then role and text, so repeated turns stay. A null text or role is empty,
    a null conv_id is a conversation of its own, an empty table gives no windows, other columns are left out.
    """
    path = path or default_path()
    spark = convs.sparkSession
    turns = convs.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    sizes = turns.groupBy("conv_id").agg(F.sum(F.octet_length("text") + F.lit(TURN_BYTES)).alias("size"))
    long_ = settle(sizes.where(F.col("size") > chunk_bytes).select(F.col("conv_id").alias("long_id")), "long")
    n_long = long_.limit(BROADCAST_ROWS + 1).count()
    long_ = F.broadcast(long_) if n_long <= BROADCAST_ROWS else long_
    short = turns.join(long_, turns["conv_id"].eqNullSafe(long_["long_id"]), "left_anti") if n_long else turns
    schema = StructType([
        StructField("conv_id", turns.schema["conv_id"].dataType), StructField("chunk", LongType()), StructField("window", LongType()),
        *[StructField(c, LongType()) for c in _COUNTS], StructField("text", StringType()), StructField("loss", _LOSS)])

    def run(batches):
        coder = encoder(path)
        key, turns, kind = None, [], None

        def table(rows):
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        def made():
            return [(*key, *w) for w in chunk_windows(key[1], turns, budget, history)]

        for batch in batches:
            kind = batch.column("conv_id").type
            done = [formatted(r, t) for r, t in zip(
                batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            data, offsets = tb.flat(pa.array([t for t, _, _ in done], pa.string()))
            tokens = []
            for i, j in tb.slices(offsets):
                tokens += np.diff(coder.encode(*tb.cut(data, offsets, i, j))[1]).tolist()
            rows = []
            for conv, chunk, came, (text, head, tail), role, n in zip(
                    batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist(), batch.column("came").to_pylist(),
                    done, batch.column("role").to_pylist(), tokens, strict=True):
                if key != (conv, chunk):
                    rows += made() if turns else []
                    key, turns = (conv, chunk), []
                turns.append((came, role, text, head, tail, n))
            yield table(rows)
        if turns:
            yield table(made())

    def dealt(rows, *order):
        rows = rows.repartition(buckets(spark), "conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", *order)
        return rows.select("conv_id", "chunk", "came", "role", "text").mapInArrow(run, schema)

    out = dealt(short.withColumn("chunk", F.lit(0).cast("long")).withColumn("came", F.lit(OWN)), "turn", "role", "text"
                ).withColumn("long", F.lit(False))
    if not n_long:
        return out
    return out.union(dealt(_chunks(turns, chunk_bytes, history, long_), "nth", "role", "text").withColumn("long", F.lit(True)))


def read_back(made: DataFrame) -> DataFrame:
    """One row per conversation from its ``windows``: what their texts and masks say, digested.

    Returns conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every turn), loss_chars, loss_sha256 (all
    text under the masks, escapes taken back), formatted_chars and n_windows. Texts are parsed and hashed window by
    window. Short conversations are read where their windows were made; long ones are sorted by window first, and
    one task hashes each of them as a stream. An empty table gives an empty one.
    """
    counts = ("n_turns", "loss_chars", "formatted_chars", "n_windows")
    schema = StructType([made.schema["conv_id"], *[StructField(c, LongType()) for c in counts],
                         *[StructField(c, StringType()) for c in ("turns_sha256", "loss_sha256")]])

    def run(batches):
        key, sums, digests, kind = None, None, None, None

        def table(rows):
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                columns, [kind, *[pa.int64()] * 4, pa.string(), pa.string()], strict=True)], names=schema.names)

        def row():
            return (*key, *sums, *(d.hexdigest() for d in digests))

        for batch in batches:
            kind = batch.column("conv_id").type
            rows = []
            for conv, n_system, n_history, text, loss in zip(
                    *(batch.column(c).to_pylist() for c in ("conv_id", "n_system", "n_history", "text", "loss")), strict=True):
                if key != (conv,):
                    rows += [row()] if key else []
                    key, sums, digests = (conv,), [0, 0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                new = parse(text)[n_system + n_history:]
                targets = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
                digests[0].update("".join(f"{r}\n{t}\n" for r, t in new).encode())
                digests[1].update(targets.encode())
                for k, more in enumerate((len(new), len(targets), len(text), 1)):
                    sums[k] += more
            yield table(rows)
        if key:
            yield table([row()])

    def read(some):
        return some.select("conv_id", "n_system", "n_history", "text", "loss").mapInArrow(run, schema)

    short = read(made.where(~F.col("long")))
    sorted_ = made.where("long").repartition(buckets(made.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk", "window")
    return short.union(read(sorted_))
