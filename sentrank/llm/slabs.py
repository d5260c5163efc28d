"""Documents in numbered slabs, and the exchange that brings equal stretches of them together.

A slab holds some megabytes of whole documents in one row, so exchanges move few large rows. Slabs are written to the
shared folder once: a row of the input is from then on known by (slab, place in it), whatever its doc_id.

Stretches are found as follows. Every run of ``length`` symbols (bytes, words) holds an anchor: the k symbols with the
least hash in it, the leftmost at ties. Equal runs hold equal anchors. Slabs send the hashes of their anchors to
buckets and learn, one bit each, which of them occur elsewhere too. Around those, runs that share one anchor are sent
as one piece to the bucket of the anchor, so equal runs meet there, and nothing else of the text moves.

An anchor with very many pieces would fill one task with surroundings that differ. Its runs are dealt one by one, by
the hash of the whole run, with the least place of each slab: a run is one short entry per slab, whatever it is part of.

There is a bucket for some megabytes of text, so the group that a task holds does not grow with the table, and every
shuffle partition gets equally many buckets.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import buckets, settle

SLAB_BYTES = 1 << 20
SLAB_ROWS = 1 << 16
CHUNK_SYMBOLS = 1 << 18
#: Text for which there is one bucket.
BUCKET_BYTES = 1 << 24
#: Symbols around one anchor beyond which its runs are dealt by themselves.
HEAVY_SYMBOLS = 1 << 20
SLAB = "slab bigint, raw_bytes bigint, doc_ids binary, no_id binary, keys binary, offsets binary, text binary"
_HIGH = np.uint64(0xFFFFFFFF00000000)
_ZSTD = dict(codec="zstd")


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, asbytes=True, **_ZSTD)


def unsqueeze(value: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True, **_ZSTD)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)
    at, out = 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes[1:].tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


@dataclass
class Slab:
    """The documents of one slab."""

    number: int
    ids: np.ndarray
    no_id: np.ndarray
    #: Hashes of the texts, to find the rows again in a table without row numbers.
    keys: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def read(row: dict) -> "Slab":
        text = pa.decompress(row["text"], row["raw_bytes"], asbytes=True, **_ZSTD) if row["raw_bytes"] else b""
        return Slab(row["slab"], np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["no_id"], bool), np.frombuffer(row["keys"], np.int64),
                    np.frombuffer(text, np.uint8), np.frombuffer(row["offsets"], np.int64))


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def _ranges(offsets: np.ndarray, slab_bytes: int):
    """As ``slices``, with a bound on the number of documents too."""
    for i, j in tb.slices(offsets, slab_bytes):
        for k in range(i, j, SLAB_ROWS):
            yield k, min(j, k + SLAB_ROWS)


def to_slabs(docs: DataFrame, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) as a settled table of slabs; a null text is empty."""

    def run(batches):
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            (data, offsets), ids = tb.flat(batch.column(1)), batch.column(0)
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in _ranges(offsets, slab_bytes):
                part, ends = tb.cut(data, offsets, i, j)
                row = [number, len(part), ids[i:j].tobytes(), no_id[i:j].tobytes(), keys[i:j].tobytes(), ends.tobytes(),
                       pa.compress(part.tobytes(), asbytes=True, **_ZSTD) if len(part) else b""]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(row, [pa.int64()] * 2 + [pa.binary()] * 5, strict=True)],
                    names=[c.split()[0] for c in SLAB.split(", ")])
                number += 1

    return settle(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash()).mapInArrow(
        run, SLAB), "slabs")


def each_slab(batches) -> Iterator[Slab]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Slab.read(batch.slice(k, 1).to_pylist()[0])


def batch_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


@dataclass
class Spec:
    """What runs are looked for, and what becomes of them."""

    k: int
    length: int
    #: Codes of the symbols of a slab and the offsets of its documents in them.
    symbols: Callable
    #: Type in which codes are sent.
    kind: type
    #: Only rows with a doc_id take part, and only other doc_ids count.
    by_document: bool
    #: Pieces of one chunk to a mask of the run starts that came before: see suffix_dedup and rlz_dedup.
    find: Callable
    heavy: int = HEAVY_SYMBOLS


def run_starts(slab: Slab, spec: Spec, offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions, of ``n`` in a slab, from which a whole run fits into a document that takes part."""
    within = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    fits = sizes >= spec.length
    if spec.by_document:
        fits &= ~slab.no_id
    np.add.at(within, offsets[:-1][fits], 1)
    np.add.at(within, offsets[:-1][fits] + sizes[fits] - spec.length + 1, -1)
    return np.flatnonzero(np.cumsum(within[:n]) > 0)


def content_hashes(codes: np.ndarray, spec: Spec, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = tb.BYTE_CODES[codes] if spec.kind == np.uint8 else codes
    return tb.stretch_hashes(tb.prefix_sums(raw), start, end)


def anchored(slab: Slab, spec: Spec):
    """Codes, document offsets, run starts, number of each run's anchor, anchor positions and their 48-bit names.

    Names are mixed again: anchors have the least hashes of their surroundings, names are spread evenly.
    """
    codes, offsets = spec.symbols(slab.data, slab.offsets)
    n = len(codes) - spec.length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return codes, offsets, none, none, none, np.empty(0, np.uint64)
    hashes = tb.gram_hashes(codes.astype(np.uint64) if spec.kind != np.uint8 else tb.BYTE_CODES[codes], spec.k)
    ranked = hashes & _HIGH
    ranked |= np.arange(len(hashes), dtype=np.uint64)
    ranked = tb.sliding(ranked, spec.length - spec.k + 1)
    ranked &= ~_HIGH
    anchor = ranked.view(np.int64)
    runs = run_starts(slab, spec, offsets, n)
    anchor = anchor[runs]
    new = np.ones(len(runs), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    at = anchor[new]
    return codes, offsets, runs, np.cumsum(new) - 1, at, tb.mix(hashes[at]) >> np.uint64(16)


def _distinct(spec: Spec, offsets, at, own):
    """Sorted distinct anchor names, which occur more than once here (in two documents, if only those count), how often."""
    doc = np.searchsorted(offsets, at, "right") - 1
    order = np.lexsort((doc, own)) if spec.by_document else np.argsort(own, kind="stable")
    own, doc = own[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    last = np.concatenate([first[1:], [len(own)]]) - 1 if len(own) else first
    again = (doc[last] != doc[first]) if spec.by_document else last > first
    return own[first], again, (last - first + 1).astype(np.uint32)


def bucket_count(slabs: DataFrame, parts: int) -> int:
    """Buckets for settled ``slabs``: one for ``BUCKET_BYTES`` of text, equally many for each of ``parts`` partitions."""
    raw = slabs.agg(F.sum("raw_bytes")).first()[0] or 0
    return parts * max(1, -(-raw // (BUCKET_BYTES * parts)))


def by_bucket(sent: DataFrame, run: Callable, schema: str, parts: int) -> DataFrame:
    """``run(bucket's rows)`` for each bucket; buckets go to partitions in turn, not by a hash that leaves some empty."""

    def each(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return run(group)

    return sent.withColumn("part", F.col("bucket") % parts).repartitionById(parts, F.col("part")).groupBy(
        "part", "bucket").applyInArrow(each, schema)


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket of ``to`` with the places that go there."""
    order = np.argsort(to, kind="stable")
    found, first = np.unique(to[order], return_index=True)
    for b, a, z in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
        yield b, order[a:z]


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 48-bit hash; grows with the hash, so sorted hashes fall into ranges."""
    return ((hashes >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


ANCHORS = "bucket int, slab bigint, hashes binary, again binary, counts binary"
BITS = "slab bigint, bucket int, n bigint, bits binary, heavy binary"
PIECES = "bucket int, slab bigint, pieces binary, runs binary, known binary"
KNOWN = "slab bigint, known binary, runs binary"


def _six(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(value: bytes) -> np.ndarray:
    wide = np.zeros((len(value) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(value, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def shared_bits(slabs: DataFrame, spec: Spec, n_buckets: int, parts: int) -> DataFrame:
    """For each slab and bucket, one bit for each of the slab's distinct anchors: does it occur elsewhere too?

    Where there are any, a second one says which have more than ``spec.heavy`` symbols around them.
    """

    def send(batches):
        for slab in each_slab(batches):
            _, offsets, _, _, at, names = anchored(slab, spec)
            own, again, counts = _distinct(spec, offsets, at, names)
            bucket = _bucket(own, n_buckets)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = [(int(bucket[a]), slab.number, _six(own[a:b]), np.packbits(again[a:b]).tobytes(),
                     squeeze(counts[a:b]) if (counts[a:b] > 1).any() else None)
                    for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True) if b > a]
            yield from batch_of(rows, ANCHORS).to_batches()

    def compare(group: pa.Table) -> pa.Table:
        blobs, flags = group["hashes"].to_pylist(), group["again"].to_pylist()
        sizes = [len(b) // 6 for b in blobs]
        hashes = np.concatenate([_from_six(b) for b in blobs])
        again = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n)
                                for f, n in zip(flags, sizes, strict=True)])
        counts = np.concatenate([np.ones(n, np.int64) if c is None else unsqueeze(c, np.uint32)[0].astype(np.int64)
                                 for c, n in zip(group["counts"].to_pylist(), sizes, strict=True)])
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        many = np.diff(np.concatenate([first, [len(ranked)]]))
        shared = np.empty(len(ranked), bool)
        shared[order] = np.repeat((many > 1) | (np.add.reduceat(again[order].astype(np.int64), first) > 0), many)
        heavy = np.empty(len(ranked), bool)  # a piece has up to 2 * length - k symbols
        heavy[order] = np.repeat(np.add.reduceat(counts[order], first) * (2 * spec.length - spec.k) > spec.heavy, many)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return batch_of([(s, k, n, np.packbits(shared[a:a + n]).tobytes(),
                          np.packbits(heavy[a:a + n]).tobytes() if heavy[a:a + n].any() else None) for s, k, n, a in zip(
            group["slab"].to_pylist(), group["bucket"].to_pylist(), sizes, cuts[:-1], strict=True)
            if shared[a:a + n].any()], BITS)

    return by_bucket(slabs.mapInArrow(send, ANCHORS), compare, BITS, parts)


def pieces_of(slab: Slab, bits: list[dict], spec: Spec, n_buckets: int) -> pa.Table:
    """The slab's pieces around shared anchors, dealt to buckets; what is decided within the slab goes along.

    Of equal pieces, only those of the least doc_id (or the first one, if places count) are sent: the others are known
    to be repeats.
    """
    codes, offsets, runs, anchors, at, names = anchored(slab, spec)
    own, _, _ = _distinct(spec, offsets, at, names)
    shared, heavy = np.zeros(len(own), bool), np.zeros(len(own), bool)
    by_bucket = {b["bucket"]: b for b in bits}
    bucket = _bucket(own, n_buckets)
    for b, row in by_bucket.items():
        a, z = np.searchsorted(bucket, [b, b + 1])
        shared[a:z] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=row["n"]).astype(bool)
        if row["heavy"] is not None:
            heavy[a:z] = np.unpackbits(np.frombuffer(row["heavy"], np.uint8), count=row["n"]).astype(bool)
    name = np.searchsorted(own, names)
    mine = shared[name][anchors] if len(own) else np.empty(0, bool)
    single = mine & heavy[name][anchors] if len(own) else mine
    dealt, known = _dealt_runs(slab, spec, codes, offsets, runs[single], n_buckets)
    mine &= ~single
    runs, anchors = runs[mine], anchors[mine]
    if not len(runs):
        return batch_of([(b, slab.number, None, r, k) for (b, r), k in zip(dealt.items(), [known] + [None] * len(dealt))], PIECES)
    new = np.concatenate([[True], (np.diff(runs) > 1) | (np.diff(anchors) != 0)])
    start = runs[new]
    end = np.concatenate([runs[:-1][new[1:]], runs[-1:]]) + spec.length
    anchor = names[anchors[new]]
    doc = np.searchsorted(offsets, start, "right") - 1
    content = content_hashes(codes, spec, start, end)
    rank = slab.ids if spec.by_document else _order(slab.no_id, slab.ids)
    order = np.lexsort((start, rank[doc], content))
    lead = np.concatenate([[True], np.diff(content[order]) != 0])
    least = np.empty(len(order), np.int64)
    least[order] = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    keep = rank[doc] == rank[doc[least]] if spec.by_document else least == np.arange(len(order))
    rows = [] if known is None else [(next(iter(dealt)), slab.number, None, None, known)]
    known = squeeze(doc[~keep].astype(np.int32), (start - offsets[doc])[~keep],
                    (end - start)[~keep].astype(np.int32))
    rows.append((int(_bucket(anchor[keep][:1], n_buckets)[0]), slab.number, None, None, known))
    rows += [(b, slab.number, None, r, None) for b, r in dealt.items()]
    start, end, anchor, doc = start[keep], end[keep], anchor[keep], doc[keep]
    for b, some in _dealt(_bucket(anchor, n_buckets)):
        some = some[np.argsort(anchor[some], kind="stable")]
        size = (end - start)[some]
        total = np.concatenate([[0], np.cumsum(size)])
        text = codes[np.repeat(start[some] - total[:-1], size) + np.arange(total[-1])].astype(spec.kind)
        rows.append((b, slab.number, squeeze(
            anchor[some], slab.ids[doc[some]], slab.no_id[doc[some]], doc[some].astype(np.int32),
            (start - offsets[doc])[some], size.astype(np.int32), text), None, None))
    return batch_of(rows, PIECES)


def _dealt_runs(slab: Slab, spec: Spec, codes: np.ndarray, offsets: np.ndarray, runs: np.ndarray,
                n_buckets: int) -> tuple[dict[int, bytes], bytes | None]:
    """Runs of heavy anchors by bucket, each once with its least doc_id here; what the slab knows of them itself."""
    if not len(runs):
        return {}, None
    content = content_hashes(codes, spec, runs, runs + spec.length)
    doc = np.searchsorted(offsets, runs, "right") - 1
    rank = slab.ids if spec.by_document else _order(slab.no_id, slab.ids)
    order = np.lexsort((runs, rank[doc], content))
    new = np.concatenate([[True], np.diff(content[order]) != 0])
    lead = order[np.flatnonzero(new)]
    least = np.empty(len(order), np.int64)
    least[order] = lead[np.cumsum(new) - 1]
    again = rank[doc] != rank[doc[least]] if spec.by_document else least != np.arange(len(order))
    at, of = runs[again], doc[again]
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(of) != 0)]) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]])[:len(first)] - 1
    known = squeeze(of[first].astype(np.int32), at[first] - offsets[of[first]],
                    (at[last] - at[first] + spec.length).astype(np.int32))
    to = _bucket(tb.mix(content[lead]) >> np.uint64(16), n_buckets)
    out = {}
    for b, places in _dealt(to):
        some = lead[places]
        out[b] = squeeze(content[some], slab.ids[doc[some]], slab.no_id[doc[some]])
    return out, known


def _later_runs(slabs: list[int], runs: list[bytes | None], by_document: bool) -> list[tuple[int, None, bytes]]:
    """For each slab, hashes of its runs that came before in another one: then all of them there are repeats."""
    some = [(s, *unsqueeze(r, np.uint64, np.int64, bool)) for s, r in zip(slabs, runs, strict=True) if r is not None]
    if not some:
        return []
    content, ids, no_id = (np.concatenate([x[i] for x in some]) for i in (1, 2, 3))
    slab = np.repeat(np.array([x[0] for x in some], np.int64), [len(x[1]) for x in some])
    order = np.lexsort((slab, ids, no_id, content))
    new = np.concatenate([[True], np.diff(content[order]) != 0])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(order), bool)
    later[order] = ids[order] != ids[lead] if by_document else ~new
    cuts = np.cumsum([0, *(len(x[1]) for x in some)])
    return [(x[0], None, squeeze(content[a:b][later[a:b]])) for x, a, b in zip(some, cuts[:-1], cuts[1:], strict=True)
            if later[a:b].any()]


def _order(no_id: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ranks of the documents of a slab: by doc_id, none last, then as stored."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((np.arange(len(ids)), ids, no_id))] = np.arange(len(ids))
    return rank


@dataclass
class Pieces:
    """Pieces of a chunk of a bucket, with all pieces of each anchor in it."""

    ids: np.ndarray
    no_id: np.ndarray
    slab: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    first: np.ndarray
    size: np.ndarray
    text: np.ndarray


def resolve(group: pa.Table, spec: Spec) -> pa.Table:
    """Runs of a bucket's pieces that are repeats, for the slabs they come from."""
    slabs, known, pieces = (group[c].to_pylist() for c in ("slab", "known", "pieces"))
    rows = _later_runs(slabs, group["runs"].to_pylist(), spec.by_document) if "runs" in group.column_names else []
    rows += [(s, v, None) for s, v in zip(slabs, known, strict=True) if v is not None]
    slabs = [s for s, p in zip(slabs, pieces, strict=True) if p is not None]
    parts = [unsqueeze(p, np.uint64, np.int64, bool, np.int32, np.int64, np.int32, spec.kind)
             for p in pieces if p is not None]
    if not parts:
        return batch_of(rows, KNOWN)
    anchor, ids, no_id, doc, start, size, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    slab = np.array(slabs, np.int64)[of]
    del parts
    first = np.cumsum(size, dtype=np.int64) - size
    order = np.argsort(anchor, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]) != 0, [True]]))
    weight = np.concatenate([[0], np.cumsum(size[order], dtype=np.int64)])[heads]
    found = []
    at = 0
    while at < len(heads) - 1:
        # Whole anchors of about ``CHUNK_SYMBOLS`` symbols, one at least.
        stop = max(at + 1, int(np.searchsorted(weight, weight[at] + CHUNK_SYMBOLS, "right")) - 1)
        some = order[heads[at]:heads[stop]]
        at = stop
        cut = np.cumsum(size[some], dtype=np.int64)
        gathered = text[np.repeat(first[some] - (cut - size[some]), size[some]) + np.arange(cut[-1])]
        mask = spec.find(Pieces(ids[some], no_id[some], slab[some], doc[some], start[some], cut - size[some],
                                size[some].astype(np.int64), gathered), spec)
        # Runs that follow one another become one stretch.
        where = np.flatnonzero(mask)
        if len(where):
            piece = np.searchsorted(cut, where, "right")
            new = np.concatenate([[True], (np.diff(where) > 1) | (np.diff(piece) != 0)])
            last = np.concatenate([where[:-1][new[1:]], where[-1:]])
            begin, piece = where[new], piece[new]
            found.append((of[some][piece], doc[some][piece], start[some][piece] + begin - (cut - size[some])[piece],
                          last - begin + spec.length))
    if found:
        source, doc, begin, span = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(source, kind="stable")
        cuts = np.searchsorted(source[order], np.arange(len(slabs) + 1))
        for k, s in enumerate(slabs):
            some = order[cuts[k]:cuts[k + 1]]
            if len(some):
                rows.append((s, squeeze(doc[some].astype(np.int32), begin[some], span[some].astype(np.int32)), None))
    return batch_of(rows, KNOWN)


def repeated(docs: DataFrame, spec: Spec, finish: Callable, schema: str) -> DataFrame:
    """Run the exchange and hand each slab with its covered symbols to ``finish(slab, codes, offsets, mask)``."""
    parts = buckets(docs.sparkSession)
    slabs = to_slabs(docs)
    n = bucket_count(slabs, parts)
    bits = shared_bits(slabs, spec, n, parts)

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([pieces_of(Slab.read(row), right.to_pylist(), spec, n) for row in left.to_pylist()]) \
            if left.num_rows and right.num_rows else batch_of([], PIECES)

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            slab = Slab.read(row)
            codes, offsets = spec.symbols(slab.data, slab.offsets)
            mask = np.zeros(len(codes) + 1, np.int32)
            for value in filter(None, right["known"].to_pylist()):
                doc, start, size = unsqueeze(value, np.int32, np.int64, np.int32)
                at = offsets[doc] + start
                np.add.at(mask, at, 1)
                np.add.at(mask, at + size, -1)
            told = [unsqueeze(v, np.uint64)[0] for v in right["runs"].to_pylist() if v is not None]
            if told:
                runs = run_starts(slab, spec, offsets, len(codes) - spec.length + 1)
                runs = runs[np.isin(content_hashes(codes, spec, runs, runs + spec.length), np.concatenate(told))]
                np.add.at(mask, runs, 1)
                np.add.at(mask, runs + spec.length, -1)
            out += finish(slab, codes, offsets, np.cumsum(mask[:-1]) > 0)
        return batch_of(out, schema)

    pieces = slabs.groupBy("slab").cogroup(bits.groupBy("slab")).applyInArrow(deal, PIECES)
    known = by_bucket(pieces, lambda group: resolve(group, spec), KNOWN, parts)
    return slabs.groupBy("slab").cogroup(known.groupBy("slab")).applyInArrow(end, schema)


def doubled_ranks(rank: np.ndarray, length: int, step: int = 1) -> list[tuple[int, np.ndarray]]:
    """Ranks of the stretches of 1, 2, 4, ... and at last ``length`` symbols from each position (prefix doubling).

    Stretches that run past the end compare as shorter ones. Equal ranks mean equal stretches; ranks follow their order.
    """
    out = [(step, rank)]
    while step < length:
        more = min(step, length - step)
        follow = np.zeros(len(rank), np.int64)
        follow[:-more or None] = rank[more:] + 1
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + follow, return_inverse=True)[1].astype(np.int64)
        step += more
        out.append((step, rank))
    return out


def smaller_neighbours(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the previous and the next smaller key of each, -1 and n where there is none.

    All pointers jump along their targets' pointers until they rest, a logarithmic number of times as a rule.
    """
    n = len(key)
    sides = []
    for part in (key, key[::-1]):
        at = np.arange(n) - 1
        todo = np.arange(n)
        while len(todo):
            todo = todo[at[todo] >= 0]
            todo = todo[part[at[todo]] >= part[todo]]
            at[todo] = at[at[todo]]
        sides.append(at)
    return sides[0], n - 1 - sides[1][::-1]
