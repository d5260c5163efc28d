"""Removal of repeated word runs by relative Lempel-Ziv parsing."""

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import textbytes as tb
from .decontaminate import bisect
from .slabs import HEAVY_SYMBOLS, Pieces, Slab, Spec, doubled_ranks, repeated
from .suffix_dedup import content_groups, edges, select, windows

WINDOW = 20
ANCHOR = 6
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<bigint>, kept string"


def _symbols(data, offsets):
    starts, ends, first = tb.tokens(data, offsets, tb.NOT_BLANK)
    return tb.token_hashes(data, starts, ends), first


class Least:
    """Least of any range of values, from the least of all ranges of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For ranges of one value at least."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            row = self.levels[k]
            out[some] = np.minimum(row[lo[some]], row[hi[some] - (1 << k)])
        return out


def parse(words: np.ndarray, place: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """End of the factor that each position belongs to, when every piece is factored greedily from its start.

    A factor is the longest match of what follows with words of the reference block at an earlier place, or one word
    where there is none. The block is indexed by its suffix array. All pieces are read word by word side by side: the
    suffixes that begin with a piece's factor are a range, which the next word narrows by bisection; the factor ends
    where no suffix of an earlier place is left.
    """
    n = len(words)
    order = np.argsort(doubled_ranks(words, int(size.max(initial=1)))[-1][1], kind="stable")
    least = Least(place[order])
    begins, ends = [], []
    begin, at, stop = first.copy(), first.copy(), first + size
    lo, hi = np.zeros(len(first), np.int64), np.full(len(first), n, np.int64)
    while len(at):
        want, depth = words[at], at - begin
        low = bisect(words, order, depth, lo, hi, want, False)
        high = bisect(words, order, depth, low, hi, want, True)
        longer = low < high
        longer[longer] = least.of(low[longer], high[longer]) < place[begin[longer]]
        alone = ~longer & (depth == 0)
        at = at + (longer | alone)
        closed = ~longer | (at == stop)
        begins.append(begin[closed])
        ends.append(at[closed])
        begin = np.where(closed, at, begin)
        lo, hi = np.where(closed, 0, low), np.where(closed, n, high)
        live = at < stop
        begin, at, stop, lo, hi = begin[live], at[live], stop[live], lo[live], hi[live]
    begin, end = np.concatenate([*begins, np.empty(0, np.int64)]), np.concatenate([*ends, np.empty(0, np.int64)])
    out = np.arange(n) + 1
    length = end - begin
    out[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())] = np.repeat(end, length)
    return out


def looked_up(words: np.ndarray, place: np.ndarray, runs: np.ndarray, asked: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``asked`` runs also start at an earlier place, by a table of all ``runs`` with their least places."""
    grams = tb.gram_hashes(tb.mix(words.astype(np.uint64)) | np.uint64(1), length)
    order = np.lexsort((place[runs], grams[runs]))
    ranked = grams[runs][order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[:len(ranked)]
    slot = np.searchsorted(ranked[head], grams[asked])
    return place[runs][order][head][slot] < place[asked]


def find(pieces: Pieces, spec: Spec) -> np.ndarray:
    """Which runs of a chunk also start earlier (a smaller doc_id, or the same document and an earlier place).

    Equal pieces enter once, at their first place; the others are repeats as a whole. The rest is the reference block:
    each piece is factored greedily into longest matches with earlier places of the block. Factors of a run's length
    or more are repeats throughout. What else could be one is a run over a factor's end; those are looked up.
    """
    length = spec.length
    group, _ = content_groups(pieces, pieces.text)
    row = np.lexsort((pieces.doc, pieces.slab, pieces.ids, pieces.no_id))
    new = np.concatenate([[True], (np.diff(pieces.doc[row]) != 0) | (np.diff(pieces.slab[row]) != 0)])
    rank = np.empty(len(row), np.int64)
    rank[row] = np.cumsum(new) - 1
    place = (rank << 40) + pieces.start
    order = np.lexsort((place, group))
    lead = order[np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))]
    words, first, old = select(pieces, lead)
    size = pieces.size[lead]
    # A zero ends each piece, so no match goes beyond it.
    inner = np.arange(len(words)) - np.repeat(first, size)
    at = np.arange(len(words)) + np.repeat(np.arange(len(lead)), size)
    first = first + np.arange(len(lead))
    codes, where = (np.zeros(len(words) + len(lead), np.int64) for _ in range(2))
    codes[at] = np.unique(words, return_inverse=True)[1] + 1
    where[at] = np.repeat(place[lead], size) + inner
    ends = parse(codes, where, first, size)
    runs = windows(Pieces(*[None] * 5, first, size, codes), length)
    inside = ends[runs] - runs >= length
    inside[~inside] = looked_up(codes, where, runs, runs[~inside], length)
    back = np.zeros(len(codes), np.int64)
    back[at] = old
    mask = np.zeros(len(pieces.text), bool)
    mask[back[runs[inside]]] = True
    later = np.ones(len(group), bool)
    later[lead] = False
    runs = windows(pieces, length)
    runs = runs[later[np.searchsorted(pieces.first, runs, "right") - 1]]
    mask[runs] = True
    return mask


def _finish(texts: bool):
    def finish(slab: Slab, codes, offsets, mask):
        starts, ends, first = tb.tokens(slab.data, slab.offsets, tb.NOT_BLANK)
        raw = slab.data.tobytes()
        rows = []
        for k in range(len(slab.ids)):
            a, b = first[k], first[k + 1]
            gone = mask[a:b]
            text = raw[slab.offsets[k]:slab.offsets[k + 1]]
            left = b" ".join(text.split() if not gone.any() else
                             [raw[s:e] for s, e in zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist(), strict=True)])
            rows.append((None if slab.no_id[k] else int(slab.ids[k]), int(b - a), int(gone.sum()),
                         hashlib.sha256(left).hexdigest(), edges(gone).tolist(), left.decode("utf-8", "replace") if texts else None))
        return rows
    return finish


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True,
                   heavy: int = HEAVY_SYMBOLS) -> DataFrame:
    """What is left of every document (doc_id, text) without words inside runs that also start earlier.

    Words are runs of anything but ASCII blanks. Each word inside a run of ``window`` words whose sequence also starts
    earlier (in a smaller doc_id, or earlier in the same document) goes; runs are judged on the input. One row per row
    of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (starts and ends in words, alternating) and, with
    ``texts``, the kept words joined by one space.

    A null text has no words. Rows without doc_id come last; rows that share a doc_id count as different documents in
    the order they are stored in, so of fully equal rows the first keeps its words. Further columns are not read.

    Bounds: as for ``suffix_dedup``; words are compared by 64-bit hashes of their bytes.
    """
    spec = Spec(min(ANCHOR, window), window, _symbols, np.uint64, False, find, heavy)
    return repeated(docs, spec, _finish(texts), SCHEMA)
