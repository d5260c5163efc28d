"""Secret scan with linking of the parts of credentials."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import map_batches

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
_DENSE = tb.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_="])
USER = re.compile(rb"(?:user(?:name|_?id)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})", re.IGNORECASE)
_SCHEME = tb.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+.-"])
_LETTER = re.compile(rb"[A-Za-z]")
_BODY = re.compile(rb"://[^\x00-\x20\"'<>]+")
ADDRESS = re.compile(rb"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])(?::[0-9]+)?")
BREAK = re.compile(rb"\n[\x20\t\r]*\n")
REACH = 200
LEAST_KEY = 32
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _mixed(token: bytes) -> bool:
    """Lower and upper case and digits all occur, as in a random key but not in prose."""
    return bool(re.search(rb"[a-z]", token) and re.search(rb"[A-Z]", token) and len(re.findall(rb"[0-9]", token)) >= 3)


def endpoint_spans(text: bytes) -> list[tuple[int, int]]:
    """URLs (a scheme that begins with a letter, ``://`` and a body) and IPv4 addresses from left to right.

    A scheme begins at the first letter of the run before its ``://``; runs are found once, so a long one costs no more
    than its length.
    """
    spans, at = [], 0
    if b"://" in text:
        walls = np.flatnonzero(~_SCHEME[np.frombuffer(text, np.uint8)])
        for sign in (m.start() for m in re.finditer(rb"://", text)):
            if sign < at:
                continue
            behind = int(np.searchsorted(walls, sign))
            letter = _LETTER.search(text, max(at, int(walls[behind - 1]) + 1 if behind else 0), sign)
            body = _BODY.match(text, sign) if letter else None
            if body:
                spans += [m.span() for m in ADDRESS.finditer(text, at, letter.start())]
                spans.append((letter.start(), body.end()))
                at = body.end()
    return spans + [m.span() for m in ADDRESS.finditer(text, at)]


def _linked(parts: list[tuple], others: list[tuple], breaks: np.ndarray, reach: int) -> list[tuple]:
    """Interval join: the ``parts`` that have one of ``others`` within ``reach`` bytes and in the same paragraph."""
    if not parts or not others:
        return []
    begin, end = (np.array(sorted(x), np.int64) for x in zip(*((s, e) for _, s, e in others), strict=True))
    out = []
    for kind, s, e in parts:
        scope = int(np.searchsorted(breaks, s, "right"))
        low = max(s - reach, int(breaks[scope - 1]) if scope else 0)
        high = min(e + reach, int(breaks[scope]) if scope < len(breaks) else e + reach)
        # Intervals that touch low..high: those that begin before its end, less those that end before its beginning.
        if np.searchsorted(begin, high, "left") > np.searchsorted(end, low, "right"):
            out.append((kind, s, e))
    return out


def scan_text(text: bytes, dense: list[tuple[int, int]], reach: int = REACH) -> list[tuple]:
    """(kind, start, end) in bytes; ``dense`` holds the runs of key characters of at least sixteen bytes."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    weak = []
    for a, b in dense:
        found += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(text[a:b])]
        if b - a >= LEAST_KEY and _mixed(text[a:b]):
            weak.append(("key", a, b))
    taken = sorted((s, e) for _, s, e in found)
    reach_of = np.maximum.accumulate([e for _, e in taken]) if taken else np.empty(0, np.int64)
    starts = np.array([s for s, _ in taken], np.int64)

    def free(part):
        at = int(np.searchsorted(starts, part[2], "left"))
        return at == 0 or reach_of[at - 1] <= part[1]

    weak = [w for w in weak if free(w)]
    secrets = [p for p in found if p[0] in ("assign", "hex")] + weak
    if not secrets:
        return found
    breaks = np.array([m.start() for m in BREAK.finditer(text)], np.int64)
    users = [p for p in (("user", *m.span()) for m in USER.finditer(text)) if free(p)]
    endpoints = [p for p in (("endpoint", *span) for span in endpoint_spans(text)) if free(p)]
    identifiers = [p for p in found if p[0] == "access"] + users
    found += _linked(weak, identifiers + endpoints, breaks, reach)
    found += _linked(users, secrets, breaks, reach)
    return found + _linked(endpoints, secrets, breaks, reach)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``secrets``: spans (kind, start, end) in code points, end exclusive.

    Base kinds are reported wherever their pattern matches: ``assign``, ``access`` and ``hex``. Weak candidates are
    ``key`` (a long run of mixed characters), ``user`` (an account name) and ``endpoint`` (a URL or an IPv4 address).
    They are reported only if a complementary part lies within ``reach`` bytes in the same paragraph: for a key an
    identifier (access or user) or an endpoint, for the others a secret (assign, hex or key). Parts are linked by an
    interval join inside the document's own task, so nothing is shuffled and no pairs are listed.

    Spans are in order of start, then kind as listed, then end. A null text is empty. Repeated rows and null doc_ids
    are treated like any other row. A column named ``secrets`` is replaced.
    """
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"])
    schema = keep.limit(0).withColumn("secrets", F.array().cast(SPAN)).schema
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = tb.flat(batch.column(batch.schema.get_field_index("text")))
            out = []
            for i, j in tb.slices(offsets):
                part, ends = tb.cut(data, offsets, i, j)
                a, b, _ = tb.tokens(part, ends, _DENSE)
                long_ = b - a >= LEAST_HEX
                a, b = a[long_], b[long_]
                of = np.searchsorted(a, ends)
                raw = part.tobytes()
                for k in range(j - i):
                    dense = list(zip((a[of[k]:of[k + 1]] - ends[k]).tolist(), (b[of[k]:of[k + 1]] - ends[k]).tolist(),
                                     strict=True))
                    text = raw[ends[k]:ends[k + 1]]
                    found = scan_text(text, dense, reach)
                    if found and not text.isascii():
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                        found = [(kind, int(points[s]), int(points[e])) for kind, s, e in found]
                    out.append([{"kind": kind, "start": s, "end": e} for kind, s, e in sorted(
                        found, key=lambda p: (p[1], KINDS.index(p[0]), p[2]))])
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind_of)], names=[*names, "secrets"])

    return map_batches(keep, run, schema)
