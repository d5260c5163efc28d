"""Benchmark decontamination by suffix arrays over the training documents."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import map_batches, settle

#: Fixed value: word bytes are ASCII letters and digits and everything beyond ASCII.
WORD_BYTES = ~tb.byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
SHARD_BYTES = 4 << 20
HASH_BYTES = 512 << 10
BLOCK_BYTES = 8 << 20
RESULT = ("n_words", "n_hit", "longest", "spans", "items", "contaminated")


def words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the lower-cased words and the first word of each document.

    Hashing takes many times the memory of the bytes, so a shard's are hashed in slices of ``HASH_BYTES``.
    """
    hashes, counts = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in tb.slices(offsets, HASH_BYTES):
        part, cuts = tb.cut(data, offsets, i, j)
        low = tb.LOWER[part]
        starts, ends, first = tb.tokens(low, cuts, WORD_BYTES)
        hashes.append(tb.token_hashes(low, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


class TestSet:
    """The suffixes of a block of benchmark items, with the windows that count."""

    __test__ = False

    def __init__(self, ids: list, texts: list, width: int):
        data, offsets = tb.flat(pa.array(texts, pa.large_string()))
        hashes, first = words(data, offsets)
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        counts = np.diff(first)
        item = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(hashes)) - first[item]
        need = np.minimum(width, counts)[item]
        window = at + need <= counts[item]
        self.least = int(need[window].min()) if window.any() else 0
        self.deepest = int(counts.max()) if len(counts) else 0
        self.codes = np.concatenate([codes.astype(np.int64) + 1, np.zeros(self.deepest + 1, np.int64)])
        starts = np.flatnonzero(window)
        # One query for each distinct suffix: equal ends of several items are searched once.
        suffix = tb.stretch_hashes(tb.prefix_sums(hashes), starts, first[item[starts] + 1])
        _, lead, group = np.unique(suffix, return_index=True, return_inverse=True)
        self.starts = starts[lead]
        self.need = need[starts[lead]]
        self.room = (first[item + 1] - np.arange(len(hashes)))[starts[lead]] if len(starts) else starts
        self.names = [None if i is None else str(i) for i in ids]
        order = np.argsort(group, kind="stable")
        self.items = np.split(item[starts][order], np.cumsum(np.bincount(group))[:-1]) if len(starts) else []


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their suffixes, compared over ``depth`` codes at least (prefix doubling)."""
    rank, length = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while length < depth and len(rank):
        follow = np.full(len(rank), 0, np.int64)
        follow[:-length] = rank[length:] + 1
        values, rank = np.unique(rank * (len(rank) + 1) + follow, return_inverse=True)
        length *= 2
        if len(values) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def bisect(keys: np.ndarray, order: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool):
    """Vectorised binary search for ``want`` among the codes at ``depth`` of the suffixes in lo..hi."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        at = keys[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(keys) - 1)]
        below = (at <= want if right else at < want) & open_
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)


def match_shard(data: np.ndarray, offsets: np.ndarray, test: TestSet):
    """Windows found in a shard of documents.

    Returns the words of each document, and for each match its document, first word, length and query, and for each
    document the longest verbatim stretch of a test suffix.
    """
    hashes, first = words(data, offsets)
    n_docs = len(offsets) - 1
    none = np.empty(0, np.int64)
    longest = np.zeros(n_docs, np.int64)
    if not len(hashes) or not test.least:
        return np.diff(first), none, none, none, none, longest
    slot = np.minimum(np.searchsorted(test.vocabulary, hashes), len(test.vocabulary) - 1)
    known = test.vocabulary[slot] == hashes
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    begins = first[:-1][np.diff(first) > 0]
    opens[begins] = known[begins]
    run = np.cumsum(opens)
    # Only runs of known words that can hold a whole window enter the suffix array; a zero ends each.
    long_enough = np.bincount(run[known], minlength=run[-1] + 1) >= test.least
    at = np.flatnonzero(known & long_enough[run])
    if not len(at):
        return np.diff(first), none, none, none, none, longest
    gaps = np.concatenate([[0], np.cumsum(run[at][1:] != run[at][:-1])])
    keys = np.zeros(len(at) + gaps[-1] + 1 + test.deepest, np.int64)
    where = np.arange(len(at)) + gaps
    keys[where] = slot[at] + 1
    place = np.full(len(keys), -1, np.int64)
    place[where] = at
    order = suffix_array(keys, test.deepest)
    lo, hi = np.zeros(len(test.starts), np.int64), np.full(len(test.starts), len(keys), np.int64)
    live = np.arange(len(test.starts))
    found: list[tuple] = []
    depth = 0
    doc_of = np.repeat(np.arange(n_docs), np.diff(first))

    def ended(low, high):
        """Suffixes low..high match over ``depth`` words and no more."""
        sizes = np.maximum(high - low, 0)
        spread = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        np.maximum.at(longest, doc_of[place[order[spread]]], depth)

    while len(live):
        want = test.codes[test.starts[live] + depth]
        new_lo = bisect(keys, order, depth, lo[live], hi[live], want, False)
        new_hi = bisect(keys, order, depth, new_lo, hi[live], want, True)
        full = test.need[live] <= depth
        ended(lo[live][full], new_lo[full])
        ended(new_hi[full], hi[live][full])
        lo[live], hi[live] = new_lo, new_hi
        live = live[new_lo < new_hi]
        depth += 1
        done = live[test.need[live] == depth]
        if len(done):
            found.append((done, lo[done], hi[done]))
        out = live[test.room[live] == depth]
        ended(lo[out], hi[out])
        live = live[test.room[live] > depth]
    if not found:
        return np.diff(first), none, none, none, none, longest
    query, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    sizes = high - low
    spread = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    words_at = place[order[spread]]
    return (np.diff(first), doc_of[words_at], words_at - first[doc_of[words_at]],
            np.repeat(test.need[query], sizes), np.repeat(query, sizes), longest)


def _keyed(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))


def _n_blocks(items: DataFrame, block_bytes: int) -> int:
    total = _keyed(items).select(F.sum(F.octet_length("t") + 16).alias("b")).first().b or 0
    return max(1, math.ceil(total / block_bytes))


def _block(items: DataFrame, k: int, n: int) -> list:
    """One of ``n`` blocks of the benchmark, small enough for the driver and for a broadcast."""
    keyed = _keyed(items)
    return (keyed if n == 1 else keyed.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).collect()


def find(docs: DataFrame, items: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the benchmark windows of ``items`` (item_id, text) that occur in each.

    Words are runs of ASCII letters and digits and of all bytes beyond ASCII, lower-cased in A-Z. A window is ``width``
    consecutive words of an item; a shorter item, if not empty, is one window. Adds ``n_words``, ``n_hit`` (words
    inside occurrences), ``longest`` (words of the longest verbatim stretch that begins with a window), ``spans``
    (runs of hit words, end exclusive), ``items`` (ids as text, sorted) and ``contaminated`` (a twentieth of the words
    or more are hit). Columns with these names are replaced.

    Each task builds a suffix array over each shard of some megabytes of its documents and searches all test suffixes
    in it by bisection. The benchmark is the stated query set; it is sent in blocks of at most about ``block_bytes``,
    one pass over the documents for each. With several blocks every pass but the last is settled before the next block
    is read, so one block is on the driver and one broadcast is live at a time.

    Null texts have no words. An item without id marks words but is not listed. Repeated rows and null doc_ids are
    treated like any other row. Without items nothing is hit.
    """
    keep = [c for c in docs.columns if c not in RESULT]
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = (out.limit(0).select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"),
        F.array().cast("array<long>").alias("__edges"), F.array().cast("array<string>").alias("items"))).schema
    context = docs.sparkSession.sparkContext
    previous, test, n = None, None, _n_blocks(items, block_bytes)
    for k in range(n):
        if test is not None:
            # The pass is done and its block gone before the next one is read.
            previous = settle(previous, "decontaminated")
            test.destroy()
        rows = _block(items, k, n)
        test = context.broadcast(TestSet([r.i for r in rows], [r.t for r in rows], width))
        del rows
        previous = map_batches(out if previous is None else previous, _scanner(test, previous is not None), schema)
    starts = F.transform(F.sequence(F.lit(0), F.size("__edges") - 1, F.lit(2)), lambda i: F.struct(
        F.get("__edges", i).alias("start"), F.get("__edges", i + 1).alias("end")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return previous.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", "longest", "items",
        F.when(F.size("__edges") > 0, starts).otherwise(
            F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")).withColumn(
        "n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scanner(test, again: bool):
    def scan(batches):
        for batch in batches:
            data, offsets = tb.flat(batch.column(batch.schema.get_field_index("text")))
            counts, longest, edges, names = [], [], [], []
            for i, j in tb.slices(offsets, SHARD_BYTES):
                part, ends = tb.cut(data, offsets, i, j)
                n_words, doc, start, length, query, deep = match_shard(part, ends, test.value)
                counts.append(n_words)
                longest.append(deep)
                order = np.argsort(doc, kind="stable")
                doc, start, length, query = doc[order], start[order], length[order], query[order]
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(j - i):
                    a, b = cuts[k], cuts[k + 1]
                    old = (batch.column("__edges")[i + k].as_py(), batch.column("items")[i + k].as_py()) if again \
                        else ([], [])
                    if a == b:
                        edges.append(old[0])
                        names.append(old[1])
                        continue
                    edges.append(_merge(np.concatenate([start[a:b], old[0][::2]]).astype(np.int64),
                                        np.concatenate([start[a:b] + length[a:b], old[0][1::2]]).astype(np.int64)))
                    hit = {test.value.names[t] for q in set(query[a:b].tolist()) for t in test.value.items[q]}
                    names.append(sorted((hit - {None}) | set(old[1])))
            cols = {n: batch.column(n) for n in batch.schema.names}
            deep = np.concatenate(longest) if longest else np.empty(0, np.int64)
            if again:
                deep = np.maximum(deep, batch.column("longest").to_numpy(zero_copy_only=False))
            cols["n_words"] = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            cols["longest"] = pa.array(deep, pa.int64())
            cols["__edges"] = pa.array(edges, pa.list_(pa.int64()))
            cols["items"] = pa.array(names, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return scan


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Starts and ends, alternating, of the merged stretches."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return np.stack([starts[new], reach[last]], 1).ravel().tolist()


def clean(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with its columns.

    Null and empty texts stay, repeated rows are judged like any other, and without items every row stays.
    """
    return find(docs, items, width).where("NOT contaminated").select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in RESULT])
