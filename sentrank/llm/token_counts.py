"""Token counts of edited documents by segment trees over pre-tokens."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import map_batches
from .wordpieces import WordEncoder, default_path, encoder

EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
RESULT = ("n_edits", "tokens_before", "tokens_after", "n_reencoded", "n_updated")
#: What personal data is besides e-mail addresses: IPv4 addresses, access keys, and runs of four digits or more.
NUMBERS = re.compile(rb"(?:[0-9]{1,3}\.){3}[0-9]{1,3}|AKIA[A-Z0-9]{12,}|[0-9]{4,}")
#: Bytes of an address before and behind its sign.
_LOCAL = tb.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"._%+-"])
_DOMAIN = re.compile(rb"[A-Za-z0-9.-]+")


def personal_spans(text: bytes) -> list[tuple[int, int]]:
    """E-mail addresses and ``NUMBERS`` from left to right, none over another.

    An address begins where the run of local bytes before its sign does, or where the address before it ends. Runs are
    found once, and what lies between addresses is searched once, so a long run costs no more than its length.
    """
    spans, at = [], 0
    if b"@" in text:
        data = np.frombuffer(text, np.uint8)
        walls = np.flatnonzero(~_LOCAL[data])
        for sign in np.flatnonzero(data == 0x40).tolist():
            behind = int(np.searchsorted(walls, sign))
            start = max(at, int(walls[behind - 1]) + 1 if behind else 0)
            domain = _DOMAIN.match(text, sign + 1)
            if start < sign and domain:
                spans += [m.span() for m in NUMBERS.finditer(text, at, start)]
                spans.append((start, domain.end()))
                at = domain.end()
    return spans + [m.span() for m in NUMBERS.finditer(text, at)]


class SegmentTree:
    """Sums over the leaves of a document, one leaf per pre-token."""

    def __init__(self, leaves: np.ndarray):
        self.n = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.sums = np.zeros(2 * self.n, np.int64)
        self.sums[self.n:self.n + len(leaves)] = leaves
        level = self.n
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def update(self, at: np.ndarray, values: np.ndarray) -> int:
        """Set leaves and renew the sums above them, level by level; returns the number of nodes touched."""
        self.sums[self.n + at] = values
        touched, nodes = len(at), self.n + at
        while len(nodes) and nodes[0] > 1:
            nodes = np.unique(nodes >> 1)
            self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
            touched += len(nodes)
        return touched


def in_order(edits: list[tuple[int, int, bytes]], size: int) -> list[tuple[int, int, bytes]]:
    """Edits by start, then end; bounds are cut to the text, and one that begins inside the edit before it is left out.

    Insertions at one place, or at an end of another edit, are kept in the order given.
    """
    out: list[tuple[int, int, bytes]] = []
    for start, end, text in sorted(edits, key=lambda e: e[:2]):
        start, end = min(max(0, start), size), min(max(0, start, end), size)
        if not out or start >= out[-1][1]:
            out.append((start, end, text))
    return out


def apply(text: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return b"".join([*parts, text[at:]])


def recount(text: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, edits: list[tuple[int, int, bytes]],
            coder: WordEncoder) -> tuple[int, int, int]:
    """Tokens of a text after ``edits``, from the counts of its parts: total, parts encoded again, nodes updated.

    A region is what an edit touches and, as context, the rest of the words (runs without blanks) at its borders;
    edits with a region in common are done together. Only regions are encoded again.
    """
    tree = SegmentTree(np.concatenate([[0], counts]))       # leaf 0 stands for what comes before the first part
    regions: list[list] = []
    for start, end, new in edits:
        low = start
        while low and not text[low - 1:low].isspace():
            low -= 1
        high = end
        while high < len(text) and not text[high:high + 1].isspace():
            high += 1
        if regions and low <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], high)
            regions[-1][2].append((start, end, new))
        else:
            regions.append([low, high, [(start, end, new)]])
    touched = again = 0
    for low, high, inside in regions:
        fresh = apply(text[low:high], [(a - low, b - low, t) for a, b, t in inside])
        n = coder.count(fresh)
        first, last = int(np.searchsorted(starts, low)), int(np.searchsorted(ends, high, "right"))
        if first < last:
            at = np.arange(first, last) + 1
            values = np.zeros(last - first, np.int64)
            values[0] = n
        else:
            # Between words there is no leaf: the one before, whose region is done, takes the new tokens along.
            at = np.array([first])
            values = tree.sums[tree.n + at] + n
        touched += tree.update(at, values)
        again += last - first
    return tree.total, again, touched


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (text, edits, ...) with token counts before and after the edits.

    ``edits`` are (start, end, text) in code points of the original text; an edit that begins inside the one before it
    is left out. Tokens are those of the tokenizer at ``path``, which drops white space, so words between ASCII blanks
    are encoded independently. Adds ``n_edits`` (applied), ``tokens_before``, ``tokens_after``, ``n_reencoded`` (old
    pre-tokens in the regions encoded again) and ``n_updated`` (tree nodes renewed); columns with these names are
    replaced and ``edits`` is dropped. A text with "<|" could spell a special token across words' parts and is encoded
    whole. A null text is empty, null edits are none, an edit with a null bound is left out, a null replacement is
    empty. Every row is counted on its own, whatever its doc_id.
    """
    path = path or default_path()
    keep = [c for c in docs.columns if c not in (*RESULT, "edits")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("edits").cast(EDITS).alias("edits"))
    schema = source.drop("edits").limit(0)
    for name in RESULT:
        schema = schema.withColumn(name, F.lit(0).cast("long"))

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            data, offsets = tb.flat(batch.column(batch.schema.get_field_index("text")))
            edits = batch.column("edits").to_pylist()
            rows = []
            for i, j in tb.slices(offsets):
                part, bounds = tb.cut(data, offsets, i, j)
                starts, ends, first = coder.parts(part, bounds)
                lengths = coder.lookup(part, starts, ends)[1] if len(starts) else np.empty(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(lengths)])
                before = np.diff(sums[first])
                raw = part.tobytes()
                special = b"<|" in raw
                for k in range(j - i):
                    text = raw[bounds[k]:bounds[k + 1]]
                    wanted = [(e["start"], e["end"], (e["text"] or "").encode()) for e in edits[i + k] or []
                              if e and e["start"] is not None and e["end"] is not None]
                    n = int(before[k])
                    if not wanted:
                        n = coder.count(text) if special and b"<|" in text else n
                        rows.append((0, n, n, 0, 0))
                        continue
                    if not text.isascii():
                        place = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
                        top = len(place) - 1
                        wanted = [(int(place[min(max(a, 0), top)]), int(place[min(max(b, 0), top)]), t) for a, b, t in wanted]
                    wanted = in_order(wanted, len(text))
                    if b"<|" in text or any(b"<" in t or b"|" in t for _, _, t in wanted):
                        new = apply(text, wanted)
                        rows.append((len(wanted), coder.count(text), coder.count(new), int(first[k + 1] - first[k]), 0))
                        continue
                    a, b = first[k], first[k + 1]
                    total, again, touched = recount(text, starts[a:b] - bounds[k], ends[a:b] - bounds[k], lengths[a:b], wanted, coder)
                    rows.append((len(wanted), n, total, again, touched))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(RESULT)
            rest = [n for n in batch.schema.names if n != "edits"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in rest] + [pa.array(c, pa.int64()) for c in columns], names=[*rest, *RESULT])

    return map_batches(source, run, schema.schema)


def personal_edits(docs: DataFrame, label: str = "redacted") -> DataFrame:
    """``docs`` (text, ...) with ``edits`` that replace personal data by ``label``."""
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "edits"])
    schema = source.limit(0).withColumn("edits", F.array().cast(EDITS)).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            data, offsets = tb.flat(batch.column(batch.schema.get_field_index("text")))
            digit = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39) | (data == 0x40))])
            some = digit[offsets[1:]] > digit[offsets[:-1]]
            keys = b"AKIA" in data.tobytes()
            out: list = []
            for k in range(len(offsets) - 1):
                if not some[k] and not keys:
                    out.append([])
                    continue
                text = data[offsets[k]:offsets[k + 1]].tobytes()
                spans = personal_spans(text)
                if spans and not text.isascii():
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    spans = [(int(points[a]), int(points[b])) for a, b in spans]
                out.append([{"start": a, "end": b, "text": label} for a, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "edits"])

    return map_batches(source, run, schema)
