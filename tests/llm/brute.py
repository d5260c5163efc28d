"""Plain single-process versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

BLANK = " \t\n\x0b\x0c\r"


def covered(n, starts, length):
    gone = [False] * n
    for s in starts:
        for i in range(s, min(n, s + length)):
            gone[i] = True
    return gone


def spans(gone):
    return sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))


def suffix_dedup(rows, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256), one document per id."""
    least = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w not in least or doc < least[w]:
                least[w] = doc
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        gone = covered(len(b), [i for i in range(len(b) - length + 1) if least[b[i:i + length]] < doc], length)
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), len(b) - len(left), spans(gone), hashlib.sha256(left).hexdigest())
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring_dedup(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        starts = []
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                starts.append(i)
            seen.add(key)
        gone = covered(len(w), starts, window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def line_dedup(rows, width=3):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        starts = []
        for i in range(len(lines) - width + 1):
            key = tuple(lines[i:i + width])
            if key in seen:
                starts.append(i)
            seen.add(key)
        gone = covered(len(lines), starts, width)
        out[doc] = ("\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone), spans(gone))
    return out


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = words(low(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(rows, k, percent):
    sets = [(doc, shingles(text, k)) for doc, text in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        least[root(i)].append(doc)
    return [(doc, len(s), min((x for x in least[root(i)] if x is not None), default=None) if s else doc)
            for i, (doc, s) in enumerate(sets)]


def decontaminate(rows, items, width=13):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))

    windows = defaultdict(set)
    for name, text in items:
        w = split(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows[tuple(w[i:i + k])].add(name)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in rows:
        w, hit, names = split(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i:i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    names |= found
        listed = sorted(str(n) for n in names if n is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    """Base spans in code points, straight from the patterns of the contract."""
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def exact(rows):
    """Rows as (doc_id, keep_id, group_size, kept, sha256) for distinct doc_ids."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups["".join(c for c in text or "" if c not in BLANK)].append((-len(text or ""), doc))
    return [(doc, min(g)[1], len(g), doc == min(g)[1], hashlib.sha256(bare.encode()).hexdigest())
            for bare, g in groups.items() for _, doc in g]


def check_pieces(pieces, ids_of, size=2048):
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) against ids; returns tokens padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        ids = ids_of[doc]
        assert length > 0 and total == len(ids)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start:start + length])) == crc
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(ids_of)
    for doc, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids_of[doc])
    padded = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded
