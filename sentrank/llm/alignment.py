"""Alignment of two tokenizers by inverted bitmaps of the id pairs that overlap in a text."""

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from . import textbytes as tb
from .common import buckets, settle

#: Most documents of a block, and the bytes of text after which a block is closed.
BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Texts longer than this are encoded in parts.
PART_CHARS = 1 << 20
#: Counted pairs up to which their table is broadcast (two numbers each); beyond, it is joined in salted parts.
BROADCAST_PAIRS = 400_000
SALTS = 16
BORDER = re.compile(r"(?<=\S) (?=\S)")
LONG_BLANK = re.compile(r"\s{1000}")
RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


class ByteTokenizer:
    """Byte-level BPE: ids of a space and a text, and the number of bytes of each id."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.whole.no_padding()
        self.whole.no_truncation()
        self.names = np.full(1 << 16, b"", object)
        for name, i in ranks.items():
            self.names[i] = name

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        # The matcher of the faster library recurses over white space; long runs go to the other one.
        return [np.array(self.whole.encode(" " + p, add_special_tokens=False).ids, np.int64) if LONG_BLANK.search(p)
                else self.fast.encode_to_numpy(" " + p, disallowed_special=()).astype(np.int64) for p in parts]


class PieceTokenizer:
    """BPE over pieces with byte fallback; it puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.names = np.full(1 << 16, b"", object)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.names[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(parts, num_threads=1)]


_LOADED: dict[tuple, tuple] = {}


def tokenizers(paths: tuple[str, str, str]) -> tuple[ByteTokenizer, PieceTokenizer]:
    """One pair of tokenizers per worker process and files."""
    if paths not in _LOADED:
        from public_tokenizers import PATTERN

        _LOADED[paths] = ByteTokenizer(paths[0], paths[1], PATTERN), PieceTokenizer(paths[2])
    return _LOADED[paths]


def default_paths() -> tuple[str, str, str]:
    """Files of A, of A's ranks and of B."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


def parts_of(text: str) -> list[str]:
    """A text cut at single spaces between words, which no token of either kind spans; the spaces are left out."""
    if len(text) <= PART_CHARS:
        return [text]
    parts, at = [], 0
    while (m := BORDER.search(text, at + PART_CHARS)) is not None:
        parts.append(text[at:m.start()])
        at = m.end()
    return [*parts, text[at:]]


#: Decimal ids followed by what separates them from the next one: in a group, after A's ids, after the group.
_SEPARATED = np.array([f"{i}{end}" for end in ",|;" for i in range(1 << 16)], object)


class Links:
    """Groups and links of the texts of one slice.

    Ends of tokens are marked on the bytes of all texts in a row. Every stretch between two marks lies in one token of
    A and one of B, and no other stretch lies in the same two, so stretches are links; marks of both kinds end groups.
    """

    def __init__(self, texts: list[str], a: ByteTokenizer, b: PieceTokenizer):
        parts = [parts_of(t) if t else [] for t in texts]
        flat = [p for ps in parts for p in ps]
        of_doc = np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])
        tokens = []
        for side in (a, b):
            ids = side.encode(flat) if flat else []
            doc = np.repeat(of_doc, [len(x) for x in ids])
            tokens.append((np.concatenate([*ids, np.empty(0, np.int64)]), doc))
        want = ["" if not t else " " + t for t in texts]
        good = np.array([bool(t) for t in texts], bool)
        for side, (ids, doc) in zip((a, b), tokens, strict=True):
            names = side.names[ids].tolist()
            if b"".join(names) != "".join(want).encode():
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
                good &= [b"".join(names[i:j]) == w.encode() for i, j, w in zip(first, first[1:], want, strict=False)]
        (ids_a, doc_a), (ids_b, doc_b) = ((ids[good[doc]], doc[good[doc]]) for ids, doc in tokens)
        n = len(texts)
        self.n_a, self.n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
        ends_a, ends_b = (np.cumsum(np.fromiter(map(len, side.names[ids].tolist()), np.int64, len(ids)))
                          for side, ids in ((a, ids_a), (b, ids_b)))
        mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] |= 2
        at = np.flatnonzero(mark)
        kind = mark[at]
        in_a, in_b, both = (kind & 1) > 0, kind > 1, kind == 3
        self.pair = ids_a[np.cumsum(in_a) - in_a] << 16 | ids_b[np.cumsum(in_b) - in_b]
        self.doc = doc_a[np.cumsum(in_a) - in_a]
        self.n_links, self.n_groups = np.bincount(self.doc, minlength=n), np.bincount(self.doc[both], minlength=n)
        group = np.cumsum(both) - both
        group_a, group_b = group[in_a], group[in_b]
        item = np.empty(len(ids_a) + len(ids_b), np.int64)
        item[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")] = ids_a + (both[in_a].astype(np.int64) << 16)
        item[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = ids_b + (both[in_b].astype(np.int64) << 17)
        self.names = _SEPARATED[item].tolist()

    def groups(self) -> list[str]:
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(self.names[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]


def _plane(keys: np.ndarray, plane: int, n_docs: int):
    """(pairs, plane, sizes, bytes, lengths) of one plane: the short lists of documents, then the bitmaps."""
    if not len(keys):
        return
    width = (n_docs + 7) // 8
    pair, doc = keys >> 12, (keys & 4095).astype("<u2")
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    dense = 2 * size > width
    yield pair[first[~dense]], plane, size[~dense], doc[np.repeat(~dense, size)].tobytes(), 2 * size[~dense]
    some = np.flatnonzero(dense)
    for rows in np.split(some, range(1024, len(some), 1024)):
        bits = np.zeros((len(rows), 8 * width), np.uint8)
        for row, k in enumerate(rows.tolist()):
            bits[row, doc[first[k]:first[k] + size[k]]] = 1
        yield pair[first[rows]], plane, size[rows], np.packbits(bits, axis=1).tobytes(), np.full(len(rows), width)


def bitmaps(keys: np.ndarray, times: np.ndarray, n_docs: int):
    """Compressed planes of a block, from sorted ``pair << 12 | document`` and the links of each.

    Plane 0 is the bitmap of the documents that hold a pair; plane k > 0 is that of the documents in which bit k - 1 of
    the number of further links is set. A plane is a list of 16-bit places or, where that is longer than two thirds of
    the bits, a bitmap of the block; lists have two bytes a document, bitmaps fewer.
    """
    yield from _plane(keys, 0, n_docs)
    plane, more = 1, times - 1
    while more.any():
        yield from _plane(keys[(more & 1) > 0], plane, n_docs)
        rest = more > 1
        keys, more, plane = keys[rest], more[rest] >> 1, plane + 1


def set_places(sizes: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and documents of all set bits of some planes."""
    lengths = np.fromiter(map(len, bits), np.int64, len(bits))
    listed = lengths == 2 * sizes
    rows = [np.repeat(np.flatnonzero(listed), sizes[listed])]
    docs = [np.frombuffer(b"".join([b for b, k in zip(bits, listed.tolist(), strict=True) if k]), "<u2").astype(np.int64)]
    for row in np.flatnonzero(~listed).tolist():
        docs.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits[row], np.uint8))))
        rows.append(np.full(len(docs[-1]), row))
    return np.concatenate(rows), np.concatenate(docs)


class Block:
    """Bitmaps and document rows of consecutive documents of a task, from slices."""

    def __init__(self, number: int):
        self.number, self.docs, self.bytes = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, links: Links, n: int, size: int):
        keys, times = np.unique(links.pair << 12 | (links.doc + self.docs), return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.docs += n
        self.bytes += size

    def planes(self):
        """The slices hold different documents, so sorting their places together is the union of their bitmaps."""
        keys = np.concatenate([*self.keys, np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        yield from bitmaps(keys[order], np.concatenate([*self.times, np.empty(0, np.int64)])[order], self.docs)


_PLANE = StructType([StructField("block", LongType()), StructField("pos", IntegerType()), StructField("pair", LongType()),
                     StructField("plane", ByteType()), StructField("n", IntegerType()), StructField("bits", BinaryType())])
_COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def postings(docs: DataFrame, paths: tuple[str, str, str] | None = None, texts: bool = True) -> DataFrame:
    """The settled index: rows of documents (pair null) and of planes (pair, plane, n, bits), both with their block.

    Columns of ``docs`` are c0, c1, ... there, without those of the result. A document has its place ``pos`` in the
    block; a pair is ``a << 16 | b``. One task numbers its blocks, so neither doc_ids nor their order matter.
    """
    paths = paths or default_paths()
    keep = [c for c in docs.columns if c not in RESULT and (texts or c != "text")]
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))
    own = [f for f in sent.schema.fields if f.name != "text"]
    schema = StructType([*_PLANE.fields, *[StructField(f.name, f.dataType) for f in own],
                         *[StructField(c, LongType()) for c in _COUNTED], StructField("groups", StringType())])

    def run(batches):
        sides = tokenizers(paths)
        block, step = Block(TaskContext.get().partitionId() << 32), min(1024, BLOCK_DOCS)

        def filled(n, given, kinds):
            return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(n, t)) for k, t in kinds], names=[k for k, _ in kinds])

        def closed(kinds):
            for pair, plane, size, data, lengths in block.planes():
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield filled(len(pair), {
                    "block": pa.array(np.full(len(pair), block.number)), "pair": pa.array(pair),
                    "plane": pa.array(np.full(len(pair), plane, np.int8)), "n": pa.array(size.astype(np.int32)),
                    "bits": pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer(ends), pa.py_buffer(data)]),
                }, kinds)

        kinds = None
        for batch in batches:
            kinds = [("block", pa.int64()), ("pos", pa.int32()), ("pair", pa.int64()), ("plane", pa.int8()), ("n", pa.int32()),
                     ("bits", pa.binary()), *[(f.name, batch.column(f.name).type) for f in own],
                     *[(c, pa.int64()) for c in _COUNTED], ("groups", pa.string())]
            column = batch.column("text")
            offsets = tb.flat(column)[1]
            for i, j in tb.slices(offsets):
                for i, j in [(k, min(j, k + step)) for k in range(i, j, step)]:
                    if block.docs + j - i > BLOCK_DOCS or block.bytes >= BLOCK_BYTES:
                        yield from closed(kinds)
                        block = Block(block.number + 1)
                    links = Links(column.slice(i, j - i).to_pylist(), *sides)
                    groups = links.groups()
                    if not texts:
                        groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                    given = {c: pa.array(getattr(links, c), pa.int64()) for c in _COUNTED}
                    yield filled(j - i, given | {f.name: batch.column(f.name).slice(i, j - i) for f in own} | {
                        "block": pa.array(np.full(j - i, block.number)), "groups": pa.array(groups, pa.string()),
                        "pos": pa.array(np.arange(block.docs, block.docs + j - i, dtype=np.int32))}, kinds)
                    block.add(links, j - i, int(offsets[j] - offsets[i]))
        if kinds:
            yield from closed(kinds)

    return settle(sent.mapInArrow(run, schema), "alignment")


def pair_counts(posted: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links) of every linked id pair of the corpus.

    Blocks hold different documents, so the union of a pair's bitmaps has as many bits as they have together.
    """
    return posted.where("pair is not null").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"),
        F.sum(F.col("n").cast("long") * F.expr("shiftleft(1L, greatest(plane - 1, 0))")).alias("n_links"),
    ).select("pair", F.expr("cast(shiftright(pair, 16) as int)").alias("a"), F.expr("cast(pair & 65535 as int)").alias("b"),
             "n_docs", "n_links")


def _scores(batches):
    """Sums per document of blocks that come one after the other."""
    block, sums = None, np.zeros((2, BLOCK_DOCS), np.int64)

    def done():
        at = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(at), block or 0)), pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])],
            names=["block", "pos", "n_best", "count_sum"])

    for batch in batches:
        of = batch.column("block").to_numpy()
        weight = 1 << np.maximum(batch.column("plane").to_numpy().astype(np.int64) - 1, 0)
        size, count = batch.column("n").to_numpy(), batch.column("n_docs").to_numpy()
        best = weight * batch.column("best").to_numpy(zero_copy_only=False)
        bits = batch.column("bits").to_pylist()
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))[:len(of)]
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=False):
            if of[i] != block:
                if block is not None:
                    yield done()
                block, sums = int(of[i]), np.zeros((2, BLOCK_DOCS), np.int64)
            row, doc = set_places(size[i:j], bits[i:j])
            np.add.at(sums[0], doc, best[i:j][row])
            np.add.at(sums[1], doc, (weight * count)[i:j][row])
    if block is not None:
        yield done()


def align(docs: DataFrame, paths: tuple[str, str, str] | None = None, texts: bool = True,
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``docs`` (text, ...) with the alignment of tokenizers A and B and how usual its links are in the corpus.

    Both encode a space and the text. Groups are the stretches between bytes at which tokens of both end; ``groups``
    lists them as ``a1,a2|b1;a3|b2,b3`` (with ``texts=False`` its SHA-256, and the column ``text`` is left out). Links
    are all overlapping token occurrences. The count of an id pair is the number of documents that hold it linked;
    ``n_best`` counts the links whose count is the highest of their A id, ``count_sum`` sums counts over links.

    Method: every block of documents has a compressed bitmap for each id pair, and planes of bits for how often it is
    linked; popcounts of all blocks give the counts, which are joined back to the postings and added up per document.
    A posting is met once in the join; a pair that every block holds is joined in sixteen salted parts.

    A text that is null or empty, or that the tokens of A or B do not spell out again, has no tokens: zeros and ''.
    Rows are documents of their own, whatever their doc_id; an empty table gives an empty one. Very long texts are
    encoded in parts. Columns with the names of the result are replaced, others may have any name.
    """
    posted = postings(docs, paths, texts)
    counts = settle(pair_counts(posted), "pairs")
    # One row per id of A at most, so the broadcast is bounded by its vocabulary.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("highest")))
    scored = counts.join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))
    planes = posted.where("pair is not null").select("block", "pair", "plane", "n", "bits")
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        met = planes.join(F.broadcast(scored), "pair")
    else:
        salted = scored.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
        met = planes.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
        met = met.repartition(buckets(docs.sparkSession), "block").sortWithinPartitions("block")
    sums = met.select("block", "plane", "n", "bits", "n_docs", "best").mapInArrow(
        _scores, "block bigint, pos int, n_best bigint, count_sum bigint").groupBy("block", "pos").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    keep = [c for c in docs.columns if c not in RESULT and (texts or c != "text")]
    return posted.where("pair is null").join(sums, ["block", "pos"], "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *_COUNTED,
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")], "groups")
