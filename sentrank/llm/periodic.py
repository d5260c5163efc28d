"""Periodic runs of words, found by minimizers of several scales, and their collapse to one period."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import map_batches

#: Periods below it are scanned lag by lag; the scales above it are its doublings.
SHORTEST = 16
LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RESULT = ("n_words", "runs", "collapsed")


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words; a number of its own stands before the words of each document."""
    words = np.unique(tb.token_hashes(data, starts, ends), return_inverse=True)[1]
    n_docs = len(first) - 1
    codes = np.empty(len(words) + n_docs, np.int64)
    walls = first[:-1] + np.arange(n_docs)
    inside = np.ones(len(codes), bool)
    inside[walls] = False
    codes[walls] = -1 - np.arange(n_docs)
    codes[inside] = words
    return codes


class Stretches:
    """Lengths of common stretches by hashes of prefixes, doubled and halved for many pairs at once."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        spread = tb.mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        self.sums = tb.prefix_sums(spread)

    def hashes(self, starts, ends):
        return tb.stretch_hashes(self.sums, starts, ends)

    def after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many codes from x on equal those from y on (x < y)."""
        low, high = np.zeros(len(x), np.int64), self.n - y
        while (go := low < high).any():
            middle = (low + high + 1) >> 1
            same = go & (self.hashes(x, x + middle) == self.hashes(y, y + middle))
            low, high = np.where(same, middle, low), np.where(go & ~same, middle - 1, high)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many codes that end before x equal those that end before y (x < y)."""
        low, high = np.zeros(len(x), np.int64), x.copy()
        while (go := low < high).any():
            middle = (low + high + 1) >> 1
            same = go & (self.hashes(x - middle, x) == self.hashes(y - middle, y))
            low, high = np.where(same, middle, low), np.where(go & ~same, middle - 1, high)
        return low


def _lag_runs(codes: np.ndarray, lag: int, least: int) -> np.ndarray:
    """(start, end, lag) of the stretches that repeat with ``lag``."""
    same = np.concatenate([[False], codes[lag:] == codes[:-lag], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, end = edge[::2], edge[1::2] + lag
    long_ = end - start >= max(least, 2 * lag)
    return np.stack([start[long_], end[long_], np.full(long_.sum(), lag)], 1)


def _leftmost(hashes: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the least value of every ``width`` consecutive values, from those of 1, 2, 4, ... values."""
    value, at, step = hashes, np.arange(len(hashes)), 1

    def merge(value, at, shift):
        right = value[shift:] < value[:-shift]
        return np.where(right, value[shift:], value[:-shift]), np.where(right, at[shift:], at[:-shift])

    while step * 2 <= width:
        value, at = merge(value, at, step)
        step *= 2
    return merge(value, at, width - step)[1] if width > step else at


def _seeds(codes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places at a distance of ``scale`` to less than twice that where equal minimizers stand.

    A window has scale/4 grams of scale/4 codes, and one window of each scale/2 places is a seed. A run of a period in
    the scale begins with a seed's window, and the window one period later, which is still inside, has its least gram
    at the same place. So that place and the period are among the pairs. A seed has at most ``scale`` partners.
    """
    size = scale // 4
    grams = tb.gram_hashes(tb.mix(codes.astype(np.uint64) + np.uint64(1)) | np.uint64(1), size)
    if len(grams) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = _leftmost(grams, size)
    x = np.unique(least[::scale // 2])
    y = np.unique(least)
    order = np.lexsort((y, grams[y]))
    names, rank = np.unique(grams[y], return_inverse=True)
    # Numbers that rise with the gram, then with the place: a range of places of one gram is a range of numbers.
    span = np.int64(len(codes) + 2 * scale)
    sorted_ = (rank * span + y)[order]
    base = np.searchsorted(names, grams[x]) * span + x
    low, high = np.searchsorted(sorted_, base + scale), np.searchsorted(sorted_, base + 2 * scale)
    some = np.repeat(np.arange(len(x)), high - low)
    within = np.arange(len(some)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    return x[some], y[order[low[some] + within]]


def _known(runs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a run already found holds x and y at a multiple of its period: their lag gives that run again."""
    if not len(runs):
        return np.zeros(len(x), bool)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    reach = np.maximum.accumulate(runs[:, 1] * len(runs) + np.arange(len(runs))) % len(runs)
    at = np.searchsorted(runs[:, 0], x, "right") - 1
    run = runs[reach[np.maximum(at, 0)]]
    return (at >= 0) & (run[:, 1] > y) & ((y - x) % run[:, 2] == 0)


def _exact(codes: np.ndarray, x: int, lag: int) -> tuple[int, int]:
    """The stretch around x that repeats with ``lag``, by comparison in growing steps."""
    end, step = x + lag, 64
    while end < len(codes):
        stop = min(len(codes), end + step)
        unlike = np.flatnonzero(codes[end:stop] != codes[end - lag:stop - lag])
        if len(unlike):
            end += int(unlike[0])
            break
        end, step = stop, 2 * step
    start, step = x, 64
    while start > 0:
        stop = max(0, start - step)
        unlike = np.flatnonzero(codes[stop:start] != codes[stop + lag:start + lag])
        if len(unlike):
            start = stop + int(unlike[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def find_runs(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all maximal runs of at least two periods and ``least`` codes, by start and period.

    Negative codes are walls: each occurs once, so no run holds one.
    """
    found = [_lag_runs(codes, lag, least) for lag in range(1, min(SHORTEST, len(codes) // 2 + 1))]
    runs = np.concatenate([*found, np.empty((0, 3), np.int64)])
    walls = np.flatnonzero(codes < 0)
    longest = int(np.diff(np.append(walls, len(codes))).max(initial=0)) - 1 if len(walls) else len(codes)
    stretches, scale = None, SHORTEST
    while 2 * scale <= longest:
        x, y = _seeds(codes, scale)
        fresh = (codes[x] >= 0) & ~_known(runs, x, y)
        x, y = x[fresh], y[fresh]
        if len(x):
            stretches = stretches or Stretches(codes)
            start, end, lag = x - stretches.before(x, y), y + stretches.after(x, y), y - x
            long_ = end - start >= np.maximum(least, 2 * lag)
            more = np.unique(np.stack([start, end, lag, x], 1)[long_], axis=0)
            more = more[np.concatenate([[True], (more[1:, :3] != more[:-1, :3]).any(1)])] if len(more) else more
            sure = []
            for s, e, p, at in more.tolist():
                if not np.array_equal(codes[s:e - p], codes[s + p:e]):      # two hashes met by chance
                    s, e = _exact(codes, at, p)
                if e - s >= max(least, 2 * p):
                    sure.append((s, e, p))
            runs = np.concatenate([runs, np.array(sure, np.int64).reshape(-1, 3)])
        scale *= 2
    # A stretch that repeats with a period repeats with its multiples too; the least is the period.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words joined by spaces, and where each document's begin; ``bounds`` are the documents' first words."""
    size = ends - starts + 1
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    size[last] -= 1
    to = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
    out = data[np.minimum(take, max(len(data) - 1, 0))]
    gaps = to[1:] - 1
    out[np.delete(gaps, last)] = 0x20
    return out, to[bounds]


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` (text, ...) with the periodic runs of their words and the texts without the repetitions.

    Words are maximal runs of other bytes than ASCII blanks. A run is a stretch of words whose smallest period q fits
    at least twice, of at least ``least`` words, that no neighbouring word extends; ``runs`` lists (start, length,
    period) in words by start, then period. ``collapsed`` is the words that remain when every run keeps only its first
    q words, joined by one space, and ``n_words`` the number of words before. A word that one run drops is dropped,
    also where another run's first words hold it.

    Method: windows of several scales take their least gram; inside a run the window one period later takes the same
    one, so equal minimizers at a distance of the scale seed a run, which common stretches extend. Periods below 16
    are scanned lag by lag. Each document is worked on in its own task, many at a time; a seed has no more partners
    than its scale is wide, so the work is bounded by n log n pairs also in a text of one repeated word.

    A null text is empty and has no words. Rows are treated one by one, so null and repeated doc_ids mean nothing. An
    empty table gives an empty one. Columns named as the results are replaced; others may have any name.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULT])
    schema = source.limit(0).withColumn("n_words", F.lit(0).cast("long")).withColumn(
        "runs", F.array().cast(RUNS)).withColumn("collapsed", F.lit("")).schema
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            data, offsets = tb.flat(batch.column(batch.schema.get_field_index("text")))
            for i, j in tb.slices(offsets):
                part, bounds = tb.cut(data, offsets, i, j)
                starts, ends, first = tb.tokens(part, bounds, tb.NOT_BLANK)
                runs = find_runs(_codes(part, starts, ends, first), least)
                doc = np.searchsorted(first[:-1] + np.arange(j - i), runs[:, 0], "right") - 1
                shift = first[:-1] + np.arange(j - i) + 1       # the walls before a document's words
                edge = np.zeros(len(starts) + 1, np.int64)
                at = runs[:, 0] - 1 - doc
                np.add.at(edge, at + runs[:, 2], 1)
                np.add.at(edge, at + runs[:, 1] - runs[:, 0], -1)
                left = np.cumsum(edge[:-1]) == 0
                text, text_bounds = joined(part, starts[left], ends[left], np.concatenate([[0], np.cumsum(left)])[first])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(runs[:, 0] - shift[doc]), pa.array(runs[:, 1] - runs[:, 0]),
                                                pa.array(runs[:, 2])], fields=list(kind)))
                texts = pa.StringArray.from_buffers(
                    j - i, pa.py_buffer(text_bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)))
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(np.diff(first)), lists, texts], names=[*batch.schema.names, *RESULT])

    return map_batches(source, run, schema)
