"""Jaccard self-join of documents on word shingles, as components of links."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import buckets, components, settle
from .slabs import Slab, batch_of, each_slab, squeeze, text_hash, to_slabs, unsqueeze

UNIT_SHINGLES = 8 << 20
SETS = "vertex bigint, doc_id bigint, text_hash bigint, n_shingles bigint, d1 bigint, d2 bigint"
SIGNS = "bucket int, slab bigint, signs binary"
COUNTS = "slab bigint, bucket int, counts binary"
EDGES = "u bigint, v bigint"
BLOBS = "bucket int, sets binary"
#: Sets of one task of the search; a large unit is a group of its own.
UNITS = "bucket bigint, sets binary"
#: Sets of a large component that all its blocks meet first.
LEADS = 8
_ROW_BITS = 20


def shingle_sets(slab: Slab, words: int):
    """Distinct shingle hashes of each document in order, their documents and the first of each document."""
    low = tb.LOWER[slab.data]
    starts, ends, first = tb.tokens(low, slab.offsets, tb.NOT_BLANK)
    codes = tb.token_hashes(low, starts, ends)
    counts = np.diff(first)
    grams = tb.gram_hashes(codes, words)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(grams))
    fits = at + words <= first[doc[:len(grams)] + 1]
    short = np.flatnonzero((counts > 0) & (counts < words))
    values = np.concatenate([grams[fits], tb.stretch_hashes(tb.prefix_sums(codes), first[short], first[short + 1])])
    doc = np.concatenate([doc[:len(grams)][fits], short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, doc, np.searchsorted(doc, np.arange(len(counts) + 1))


def digests(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each document's set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.zeros(n_docs, np.uint64)
        np.add.at(total, doc, tb.mix(values ^ np.uint64(salt)))
        out.append(tb.mix(total).view(np.int64))
    return out[0], out[1]


def size_classes(most: int, percent: int) -> np.ndarray:
    """Least sizes of the classes: a linked set is in the same class as the smaller one or in the next."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(100 * bounds[-1] // percent + 1)
    bounds.append(100 * bounds[-1] // percent + 1)
    return np.array(bounds, np.int64)


def signatures(values: np.ndarray, doc: np.ndarray, first: np.ndarray, chosen: np.ndarray, percent: int):
    """Signatures of the ``chosen`` documents such that linked, unequal sets have some in common.

    Sets of a size class with at most D shingles that only one of them has are cut, by hash, into more than D parts:
    of f filled parts of a set, f - D at least are the same in the other. Each set takes part at the level of its own
    class and at that of the class below. A set with too few filled parts also sends its empty ones, which closes the
    gap between two such. Returns the signatures, their group (two for each document: 2 * document + step) and, for
    each group, how many of its signatures may be left out.
    """
    sizes = np.diff(first)
    bounds = size_classes(int(sizes.max(initial=1)), percent)
    own = np.searchsorted(bounds, sizes, "right") - 1
    signs, of = [], []
    spare = np.zeros(2 * len(sizes), np.int64)
    for step in (0, 1):
        level = own - step
        apart = (100 - percent) * (bounds[np.maximum(level, 0) + 1] - 1) // percent
        use = chosen & (level >= 0) & (apart > 0) & (sizes > 0)
        if not use.any():
            continue
        parts = np.where(use, (12 * (apart + 1) + 9) // 10 + 3, 0)
        base = np.cumsum(parts) - parts
        mine = use[doc]
        h, d = values[mine], doc[mine]
        part = ((h >> np.uint64(32)) * parts[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total, filled = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), bool)
        np.add.at(total, base[d] + part, tb.mix(h))
        filled[base[d] + part] = True
        owner = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(total)) - base[owner]
        count = np.bincount(owner[filled], minlength=len(parts))
        few = count <= apart
        spare[step::2] = np.where(use, np.maximum(count - apart - 1, 0), 0)
        send = filled | few[owner]
        place = tb.mix((level[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1))
        signs.append(tb.mix(total + place)[send] >> np.uint64(16))
        of.append(2 * owner[send] + step)
    if not signs:
        return np.empty(0, np.uint64), np.empty(0, np.int64), spare
    return np.concatenate(signs), np.concatenate(of), spare


def _describe(words: int):
    def run(batches):
        for slab in each_slab(batches):
            values, doc, first = shingle_sets(slab, words)
            d1, d2 = digests(values, doc, len(slab.ids))
            yield pa.RecordBatch.from_arrays([
                pa.array((slab.number << _ROW_BITS) + np.arange(len(slab.ids))), pa.array(slab.ids, mask=slab.no_id),
                pa.array(slab.keys), pa.array(np.diff(first)), pa.array(d1), pa.array(d2)], names=[c.split()[0] for c in SETS.split(", ")])
    return run


def _signed(slab: Slab, words: int, percent: int, n_buckets: int):
    """Signatures of a slab in order of their buckets, one set of each content; groups, spare ones, bucket bounds."""
    values, doc, first = shingle_sets(slab, words)
    d1, d2 = digests(values, doc, len(slab.ids))
    chosen = np.zeros(len(slab.ids), bool)
    chosen[np.unique(np.stack([d1, d2, np.diff(first)], 1), axis=0, return_index=True)[1]] = True
    signs, of, spare = signatures(values, doc, first, chosen, percent)
    to = ((signs >> np.uint64(16)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return signs[order], of[order], spare, np.searchsorted(to[order], np.arange(n_buckets + 1))


def _six(signs: np.ndarray) -> np.ndarray:
    return signs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _from_six(six: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(six) // 6, 8), np.uint8)
    wide[:, :6] = six.reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _sign(words: int, percent: int, n_buckets: int):
    def run(batches):
        for slab in each_slab(batches):
            signs, _, _, cuts = _signed(slab, words, percent, n_buckets)
            rows = [(b, slab.number, squeeze(_six(signs[cuts[b]:cuts[b + 1]])))
                    for b in np.flatnonzero(np.diff(cuts)).tolist()]
            yield from batch_of(rows, SIGNS).to_batches()
    return run


def _count(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """For each slab how often each of its signatures occurs in all (255 stands for more)."""
    parts = [_from_six(unsqueeze(v, np.uint8)[0]) for v in group["signs"].to_pylist()]
    _, which, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    found = np.split(np.minimum(n, 255).astype(np.uint8)[which], np.cumsum([len(p) for p in parts])[:-1])
    return batch_of([(s, b, squeeze(c)) for s, b, c in zip(
        group["slab"].to_pylist(), group["bucket"].to_pylist(), found, strict=True) if (c > 1).any()], COUNTS)


def _choose(words: int, percent: int, n_buckets: int):
    """The signatures of a slab that are sent on, with their documents.

    Linked sets have more signatures in common than either may spare. So each leaves out its most frequent ones, in
    one order for all: the rarest common one stays in both. What occurs once links nothing. Passages that many
    documents quote fill frequent signatures and are gone after this.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return batch_of([], SIGNS)
        slab = Slab.read(left.to_pylist()[0])
        signs, of, spare, cuts = _signed(slab, words, percent, n_buckets)
        counts = np.ones(len(signs), np.uint8)
        for r in right.to_pylist():
            counts[cuts[r["bucket"]]:cuts[r["bucket"] + 1]] = unsqueeze(r["counts"], np.uint8)[0]
        order = np.lexsort((signs, counts, of))
        size = np.bincount(of, minlength=len(spare))
        end = np.cumsum(size)
        from_top = np.empty(len(signs), np.int64)
        from_top[order] = end[of[order]] - 1 - np.arange(len(signs))
        keep = (from_top >= spare[of]) & (counts > 1)
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[b], cuts[b + 1])
            some = keep[mine]
            if some.any():
                rows.append((b, slab.number, squeeze(_six(signs[mine][some]), (of[mine][some] >> 1).astype(np.uint16))))
        return batch_of(rows, SIGNS)
    return run


def _meet(n_buckets: int):
    """Of each signature's documents, links of the others with the first, dealt on by link."""
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        links = _first_links(group)
        to = (tb.mix(tb.mix(links[:, 0].view(np.uint64)) ^ links[:, 1].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(n_buckets + 1))
        return batch_of([(b, squeeze(links[order[cuts[b]:cuts[b + 1]]].ravel())) for b in np.unique(to).tolist()], BLOBS)
    return run


def _once(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """A bucket's links, each vertex once: near copies have many signatures in common."""
    return stars(np.concatenate([unsqueeze(v, np.int64)[0] for v in group["sets"].to_pylist()]).reshape(-1, 2))


def stars(links: np.ndarray) -> pa.Table:
    """Every vertex of some links with the least vertex that these links reach from it."""
    vertices, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    low = np.arange(len(vertices))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (low[low] != low).any():
            low = low[low]
    far = np.flatnonzero(low != np.arange(len(low)))
    return pa.table({"u": pa.array(vertices[far], pa.int64()), "v": pa.array(vertices[low[far]], pa.int64())})


def _first_links(group: pa.Table) -> np.ndarray:
    signs, vertices = [], []
    for slab, value in zip(group["slab"].to_pylist(), group["signs"].to_pylist(), strict=True):
        six, of = unsqueeze(value, np.uint8, np.uint16)
        signs.append(_from_six(six))
        vertices.append((slab << _ROW_BITS) + of.astype(np.int64))
    sign, vertex = np.concatenate(signs), np.concatenate(vertices)
    order = np.lexsort((vertex, sign))
    sign, vertex = sign[order], vertex[order]
    head = np.concatenate([[True], sign[1:] != sign[:-1]])
    lead = vertex[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return np.ascontiguousarray(np.unique(np.stack([lead, vertex], 1)[lead != vertex], axis=0))


class Lists:
    """Inverted lists of the sets of a unit that are not yet in a component."""

    def __init__(self, values: np.ndarray, first: np.ndarray, members: np.ndarray):
        size = np.diff(first)[members]
        total = np.cumsum(size) - size
        at = np.repeat(first[members] - total, size) + np.arange(size.sum())
        _, slot = np.unique(values[at], return_inverse=True)
        doc = np.repeat(np.arange(len(members)), size)
        order = np.lexsort((doc, slot))
        self.members, self.doc = members, doc[order]
        self.begin = np.searchsorted(slot[order], np.arange(slot.max(initial=-1) + 2))
        self.slot, self.own = slot, np.concatenate([total, [size.sum()]])
        self.size = size

    def search(self, q: int, percent: int, alive: np.ndarray) -> np.ndarray:
        """Sets that overlap set ``q`` enough, by DivideSkip.

        A linked set has at least T shingles of q. The L longest lists are set aside; a set that occurs T times in all
        occurs T - L times in the short ones, which are merged. What reaches that is looked up in the long lists by
        binary search.
        """
        slots = self.slot[self.own[q]:self.own[q + 1]]
        begin, end = self.begin[slots], self.begin[slots + 1]
        length = end - begin
        need = -(-percent * int(self.size[q]) // 100)
        long_ = min(need - 1, int(need / (0.01 * math.log2(max(2, int(length.max()))) + 1)))
        order = np.argsort(length, kind="stable")
        cut = len(order) - long_
        short, far = order[:cut], order[cut:]
        total = np.cumsum(length[short]) - length[short]
        merged = self.doc[np.repeat(begin[short] - total, length[short]) + np.arange(int(length[short].sum()))]
        found, count = np.unique(merged, return_counts=True)
        reach = (count >= need - long_) & alive[found] & (found != q)
        found, count = found[reach], count[reach]
        for a, b in zip(begin[far].tolist(), end[far].tolist(), strict=True):
            if not len(found):
                break
            part = self.doc[a:b]
            at = np.minimum(np.searchsorted(part, found), len(part) - 1)
            count = count + (part[at] == found)
        return found[100 * count >= percent * (self.size[q] + self.size[found] - count)]


def links_of(values: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a unit's sets. Each set is searched once, among sets not yet reached."""
    waiting = np.arange(len(first) - 1)
    out = []
    while len(waiting) > 1:
        lists = Lists(values, first, waiting)
        alive = np.ones(len(waiting), bool)
        queue: list[int] = []
        left = len(waiting)
        while left and (queue or 2 * left > len(waiting)):
            if not queue:
                queue = [int(np.argmax(alive))]
                alive[queue[0]] = False
                left -= 1
            q = queue.pop()
            near = lists.search(q, percent, alive)
            alive[near] = False
            left -= len(near)
            queue += near.tolist()
            out += [(int(waiting[q]), int(waiting[r])) for r in near.tolist()]
        waiting = waiting[alive]
    return out


def _gather(words: int, n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if right.num_rows and left.num_rows:
            slab = Slab.read(left.to_pylist()[0])
            values, _, first = shingle_sets(slab, words)
            unit, vertex, bucket = (right[c].to_numpy() for c in ("unit", "rep", "bucket"))
            row = vertex & ((1 << _ROW_BITS) - 1)
            for b in np.unique(bucket).tolist():
                some = np.flatnonzero(bucket == b)
                size = np.diff(first)[row[some]]
                total = np.cumsum(size) - size
                at = np.repeat(first[row[some]] - total, size) + np.arange(size.sum())
                rows.append((b, squeeze(unit[some], vertex[some], size, values[at])))
        return batch_of(rows, UNITS)
    return run


def _verify(percent: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [unsqueeze(v, np.int64, np.int64, np.int64, np.uint64) for v in group["sets"].to_pylist()]
        unit, vertex, size, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.cumsum(size) - size
        order = np.argsort(unit, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(unit[order]) != 0, [True]]))
        links = [np.empty((0, 2), np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = order[a:b]
            own = np.cumsum(size[some]) - size[some]
            at = np.repeat(first[some] - own, size[some]) + np.arange(size[some].sum())
            found = links_of(values[at], np.concatenate([own, [len(at)]]), percent)
            if found:
                links.append(vertex[some[np.array(found)]])
        return stars(np.concatenate(links))
    return run


def _searched(slabs: DataFrame, members: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """Links that span the components of each unit; ``members`` are (rep, unit, alone), once each.

    Sets are read off their slabs and meet by unit: a large one (``alone``) is a group, small ones share buckets.
    """
    placed = members.select(
        "rep", "unit", F.shiftright("rep", _ROW_BITS).alias("slab"),
        F.when(F.col("alone"), F.col("unit")).otherwise(F.pmod("unit", F.lit(n))).alias("bucket"))
    return slabs.groupBy("slab").cogroup(placed.groupBy("slab")).applyInArrow(_gather(words, n), UNITS).groupBy(
        "bucket").applyInArrow(_verify(percent), EDGES)


def _block(count):
    return F.pmod(F.xxhash64("rep"), count).cast("int")


def with_leads(large: DataFrame) -> DataFrame:
    """(rep, unit, alone): each block of the sets (rep, root, blocks) of large components, and with it the leads.

    A set is sent once, leads once a block, so what is sent grows with the component.
    """
    nth = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("rep", F.lit(7)), "rep"))
    leads = large.withColumn("nth", nth).where(F.col("nth") <= LEADS)
    copies = leads.select("rep", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return large.select("rep", "root", _block(F.col("blocks")).alias("block")).union(copies).distinct().select(
        "rep", F.xxhash64("root", "block").alias("unit"), F.lit(True).alias("alone"))


def not_reached(large: DataFrame, reached: DataFrame, unit_shingles: int) -> DataFrame:
    """(rep, unit, alone): every block of a large component with every block of the sets outside its main part.

    ``reached`` (v, root) are the components that links make of its sets so far. The main part is the one with the most
    sets; links within it are not needed any more. Without other sets there is no unit.
    """
    parts = large.join(reached.select(F.col("v").alias("rep"), F.col("root").alias("part")), "rep", "left").withColumn(
        "part", F.coalesce("part", "rep"))
    sizes = parts.groupBy("root", "part").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("root").agg(F.max_by("part", F.struct("members", "part")).alias("main"))
    rest = parts.join(main, "root").where("part <> main")
    counts = rest.groupBy("root").agg(F.ceil(2 * F.sum("n_shingles") / F.lit(unit_shingles)).cast("int").alias("others"))
    out = rest.join(counts, "root").select(
        "rep", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), _block(F.col("others")).alias("other"))
    every = large.join(counts, "root").select(
        "rep", "root", _block(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    return out.union(every).distinct().select("rep", F.xxhash64("root", "block", "other").alias("unit"), F.lit(True).alias("alone"))


def link(docs: DataFrame, words: int = 5, percent: int = 80, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """Components of documents (doc_id, text) whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Words are runs of anything but ASCII blanks, lower-cased in A-Z. A set holds the distinct runs of ``words`` words,
    or a shorter text's whole sequence as one. One row per row of ``docs``: ``vertex`` (row number), doc_id, text_hash,
    ``n_shingles``, ``component_id`` (the least doc_id that can be reached by links) and ``first`` (it stands for its
    component).

    Steps: equal sets are one class throughout. Signatures (see ``signatures``) that linked sets must have in common,
    without the most frequent ones (see ``_choose``), give groups of candidates, joined into candidate components. Each of these is searched by DivideSkip over inverted
    lists; every set is searched once, among the sets not yet reached, so a large group of near copies is no list of
    pairs. A candidate component beyond ``unit_shingles`` shingles is cut into blocks, each searched in a task of its
    own together with a few leads of the component; sets that this does not join to its main part then meet every
    block. The links found are joined into components again.

    A text without words has an empty set, no links and its own doc_id as component. A null text has no words. A row
    without doc_id takes part, but its component is named after the others (null if there are none). Repeated rows are
    copies like any other. Further columns are not read.
    """
    spark = docs.sparkSession
    n = buckets(spark)
    slabs = to_slabs(docs)
    sets = settle(slabs.mapInArrow(_describe(words), SETS), "sets")
    counts = slabs.mapInArrow(_sign(words, percent, n), SIGNS).groupBy("bucket").applyInArrow(_count, COUNTS)
    signs = slabs.groupBy("slab").cogroup(counts.groupBy("slab")).applyInArrow(_choose(words, percent, n), SIGNS)
    candidates = signs.groupBy("bucket").applyInArrow(_meet(n), BLOBS).groupBy("bucket").applyInArrow(_once, EDGES)
    near = components(candidates)
    classes = sets.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(
        F.min("vertex").alias("rep"), F.min("doc_id").alias("least"),
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "vertex")).alias("lead"))
    classes = settle(classes.join(near.withColumnRenamed("v", "rep"), "rep", "left"), "classes")
    members = classes.where("root IS NOT NULL").select("rep", "root", "n_shingles")
    weights = members.groupBy("root").agg(F.sum("n_shingles").alias("weight"), F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(2 * F.col("weight") / F.lit(unit_shingles)).cast("int")
    members = members.join(weights.where("members > 1").select(
        "root", F.when(F.col("weight") <= unit_shingles, 1).otherwise(blocks).alias("blocks")), "root")
    small = members.where("blocks = 1").select("rep", F.xxhash64("root").alias("unit"), F.lit(False).alias("alone"))
    large = settle(members.where("blocks > 1"), "large")
    if not large.limit(1).count():
        links = _searched(slabs, small, words, percent, n)
    else:
        links = settle(_searched(slabs, small.union(with_leads(large)), words, percent, n), "links")
        rest = settle(not_reached(large, components(links), unit_shingles), "rest")
        if rest.limit(1).count():
            links = links.union(_searched(slabs, rest, words, percent, n))
    final = components(links)
    labelled = classes.drop("root").join(final.withColumnRenamed("v", "rep"), "rep", "left").withColumn(
        "root", F.coalesce("root", "rep"))
    named = labelled.join(labelled.groupBy("root").agg(
        F.min("least").alias("component_id"), F.min("lead").alias("front")), "root")
    return sets.join(named.select("d1", "d2", "n_shingles", "component_id", F.col("front.vertex").alias("front")),
                     ["d1", "d2", "n_shingles"], "left").select(
        "vertex", "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | (F.col("vertex") == F.col("front"))).alias("first"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept, the one with the least doc_id.

    Rows with equal doc_id and text count as one document. A document without doc_id comes last in its component.
    """
    gone = link(docs, words, percent).groupBy("doc_id", "text_hash").agg(F.max("first").alias("stays")).where(
        "NOT stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (text_hash() == F.col("__hash")), "left_anti")
