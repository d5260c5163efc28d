"""Sum-of-squares packing of tokenised documents into sequences."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .wordpieces import default_path, encoder, text_column

END_ID = 1
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")
MOST_OPEN = 1024


class Packer:
    """Online packing; ``levels[h]`` counts the open sequences that hold h tokens.

    An item goes where the sum of the squared counts grows least: onto an open level or into a new sequence. Open
    sequences keep their pieces. When more than ``most_open`` are open, and at the end, ``settle`` cuts the pieces of
    the emptiest ones to fill the gaps of the fullest.
    """

    def __init__(self, size: int, base: int, most_open: int = MOST_OPEN):
        self.size, self.next_id, self.most_open = size, base, most_open
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray):
        total, at = len(ids), 0
        while total - at >= self.size:
            self._close([(doc, at, ids[at:at + self.size], total)])
            at += self.size
        if at < total:
            self._place((doc, at, ids[at:], total))
        if self.n_open > self.most_open:
            self.settle()

    def _place(self, piece: tuple):
        r = len(piece[2])
        here = self.levels[1:self.size - r + 1]
        level = 0
        if self.n_open and len(here):
            gain = 2 * (self.levels[r + 1:] - here + 1)
            gain[-1] = 1 - 2 * here[-1]
            gain = np.where(here > 0, gain, np.iinfo(np.int64).max)
            best = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[best] <= 2 * self.levels[r] + 1:
                level = best + 1
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + r == self.size:
            self._close(pieces)
        else:
            self.open[level + r].append(pieces)
            self.levels[level + r] += 1
            self.n_open += 1

    def _close(self, pieces: list[tuple]):
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def settle(self, last: bool = False):
        """Close all open sequences as full ones but for one, which is cut into powers of two at the ``last`` call."""
        full = [p for h in range(self.size, 0, -1) for p in self.open[h]]
        self.open = [[] for _ in range(self.size + 1)]
        self.levels[:] = 0
        self.n_open = 0
        low, high = 0, len(full) - 1
        spare: list[tuple] = []
        while low <= high:
            pieces = full[low]
            low += 1
            gap = self.size - sum(len(p[2]) for p in pieces)
            while gap:
                if not spare:
                    if low > high:
                        break
                    spare = full[high]
                    high -= 1
                doc, start, ids, total = spare.pop()
                if len(ids) > gap:
                    spare.append((doc, start + gap, ids[gap:], total))
                    ids = ids[:gap]
                pieces.append((doc, start, ids, total))
                gap -= len(ids)
            if gap == 0:
                self._close(pieces)
            else:
                spare, low = pieces, high + 1
        if not spare:
            return
        length = sum(len(p[2]) for p in spare)
        if not last:
            self.open[length].append(spare)
            self.levels[length] = self.n_open = 1
            return
        power = self.size
        while spare:
            power = min(power, 1 << (length.bit_length() - 1))
            part, need = [], power
            while need:
                doc, start, ids, total = spare.pop()
                if len(ids) > need:
                    spare.append((doc, start + need, ids[need:], total))
                    ids = ids[:need]
                part.append((doc, start, ids, total))
                need -= len(ids)
            self._close(part)
            length -= power


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = END_ID,
         most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most ``size`` tokens.

    A document is its ids by the tokenizer at ``path`` (which lower-cases and drops white space) and ``end_id``. It is
    cut where a whole sequence is full; its rest is packed by the sum of squares, by each task for its own documents,
    with at most ``most_open`` open sequences. Sequences are full, but for the last of each task: these have the length
    of a power of two. One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty: one end id. Null or repeated doc_ids and repeated rows are documents like any other.
    Sequence ids hold the partition's number, so they are unique. No rows in, no rows out.
    """
    path = path or default_path()
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        packer = Packer(size, TaskContext.get().partitionId() << 36, most_open)
        coder = encoder(path)

        def rows():
            out, packer.rows = packer.rows, []
            kinds = [pa.int64()] * len(columns)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

        for batch in batches:
            data, offsets = tb.flat(text_column(batch))
            names = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for i, j in tb.slices(offsets):
                ids, bounds = coder.encode(*tb.cut(data, offsets, i, j))
                for k in range(j - i):
                    packer.add(names[i + k], np.append(ids[bounds[k]:bounds[k + 1]], np.int32(end_id)))
                if packer.rows:
                    yield rows()
        packer.settle(last=True)
        if packer.rows:
            yield rows()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
