"""Removal of repeated byte strings by longest-previous-factor arrays."""

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import textbytes as tb
from .slabs import HEAVY_SYMBOLS, Pieces, Slab, Spec, doubled_ranks, repeated, smaller_neighbours

LENGTH = 50
ANCHOR = 20
SCHEMA = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
          "spans array<bigint>, kept binary")


def _symbols(data, offsets):
    return data, offsets


def windows(pieces: Pieces, length: int) -> np.ndarray:
    """Positions in a chunk from which a whole run fits into its piece."""
    inside = np.zeros(len(pieces.text) + 1, np.int32)
    fits = pieces.size >= length
    np.add.at(inside, pieces.first[fits], 1)
    np.add.at(inside, (pieces.first + pieces.size - length + 1)[fits], -1)
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def content_groups(pieces: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the content of each piece, and the pieces of equal content in a row."""
    hashes = tb.stretch_hashes(tb.prefix_sums(codes), pieces.first, pieces.first + pieces.size)
    group = np.unique(hashes, return_inverse=True)[1]
    return group, np.argsort(group, kind="stable")


def select(pieces: Pieces, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of the pieces ``lead`` alone, their first positions there, and the old position of each new one."""
    size = pieces.size[lead]
    first = np.cumsum(size) - size
    old = np.repeat(pieces.first[lead] - first, size) + np.arange(size.sum())
    return pieces.text[old], first, old


def find(pieces: Pieces, spec: Spec) -> np.ndarray:
    """Which runs of a chunk also start in a document with a smaller doc_id.

    Equal pieces enter once, with their least doc_id; those of other documents are repeats as a whole. The suffixes of
    the rest are ordered over ``length`` bytes. A suffix's longest previous factor is the longer of its matches with
    the previous and the next suffix of a smaller doc_id in that order; where it has ``length`` bytes, the run is a
    repeat.
    """
    length = spec.length
    mask = np.zeros(len(pieces.text), bool)
    group, order = content_groups(pieces, tb.BYTE_CODES[pieces.text])
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, pieces.ids)
    lead = order[np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))]
    text, first, old = select(pieces, lead)
    starts = windows(Pieces(*[None] * 5, first, pieces.size[lead], text), length)
    if len(starts):
        packed = np.zeros(len(text), np.int64)
        wide = np.concatenate([text, np.zeros(7, np.uint8)]).astype(np.int64)
        for b in range(7):
            packed = (packed << 8) | wide[b:b + len(text)]
        rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
        rank = doubled_ranks(rank, length, 7)[-1][1][starts]
        piece = np.searchsorted(first, starts, "right") - 1
        doc = least[group[lead]][piece]
        suffixes = np.argsort(rank, kind="stable")
        rank, key = rank[suffixes], doc[suffixes]
        before, after = smaller_neighbours(key)
        n = len(rank)
        factor = ((before >= 0) & (rank[np.maximum(before, 0)] == rank)) | ((after < n) & (rank[np.minimum(after, n - 1)] == rank))
        repeat = np.zeros(len(text), bool)
        repeat[starts[suffixes[factor]]] = True
    # The result of a content holds for its pieces of the least doc_id.
    at_lead = np.empty(len(lead), np.int64)
    at_lead[group[lead]] = np.arange(len(lead))
    source = first[at_lead[group]]
    shift = np.repeat(source - pieces.first, pieces.size) + np.arange(len(pieces.text))
    runs = windows(pieces, length)
    piece = np.searchsorted(pieces.first, runs, "right") - 1
    later = pieces.ids > least[group]
    mask[runs] = later[piece] | (repeat[shift[runs]] if len(starts) else False)
    return mask


def edges(mask: np.ndarray) -> np.ndarray:
    """Starts and ends, alternating, of the true stretches."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))


def _finish(texts: bool):
    def finish(slab: Slab, codes, offsets, mask):
        rows = []
        for k in range(len(slab.ids)):
            part, gone = slab.data[offsets[k]:offsets[k + 1]], mask[offsets[k]:offsets[k + 1]]
            spans = edges(gone)
            left = part[~gone].tobytes() if len(spans) else part.tobytes()
            rows.append((None if slab.no_id[k] else int(slab.ids[k]), len(part), len(part) - len(left), len(spans) // 2,
                         hashlib.sha256(left).hexdigest(), spans.tolist(), left if texts else None))
        return rows
    return finish


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True,
                   heavy: int = HEAVY_SYMBOLS) -> DataFrame:
    """What is left of every document (doc_id, text) without bytes that also occur in an earlier one.

    Texts are UTF-8 bytes. Each byte inside a string of ``length`` bytes that also starts in a document with a smaller
    doc_id goes; overlaps count, strings never cross documents and are judged on the input. One row per row of
    ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends in bytes, alternating) and, with
    ``texts``, the bytes kept.

    A null text is empty. Rows without doc_id have no place in the order: they stay whole and remove nothing. Rows that
    share a doc_id remove nothing from each other. Further columns are not read.

    Bounds: a task holds a slab of a megabyte (or one longer document), or one bucket's pieces; suffix arrays are
    built over some hundred thousand bytes of them at a time. A passage in any number of documents reaches its bucket at most
    once per slab for each document with the slab's least doc_id. An anchor with more than ``heavy`` symbols around it
    is in no task as a whole: its runs are dealt by 64-bit hashes of all their bytes, one entry per slab each.
    """
    spec = Spec(min(ANCHOR, length), length, _symbols, np.uint8, True, find, heavy)
    return repeated(docs, spec, _finish(texts), SCHEMA)
