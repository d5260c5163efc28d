"""Isolation forest grown and scored by Spark.

Training rows are folded to distinct vectors with counts; every tree draws a
Poisson bootstrap of them. Where all vectors fit into one task, they are sent to
every worker and a task draws and grows whole trees, so no sample is shuffled.
Beyond that, vectors are packed column by column, with codes where a column has few
values, and every group of trees gets them once; a task draws and grows the trees of
a group and walks the rows to be scored down each tree while it grows, so nodes are
kept only if they are asked for. With still more vectors a tree is a group, and gets
those it draws. Where a task cannot hold even these, large nodes are split level by
level from aggregated minima and maxima, with the samples drawn anew where the
vectors lie; then samples are shuffled once, packed, and whatever is small enough
is finished inside one task per (tree, node). Inside a task all small nodes of a level
are split in one pass over their rows, which lie in order of the nodes.

Every draw is a function of what it is for (vector and tree, tree and feature, node
and feature), so all routes grow the same trees. The model is a table of nodes in
heap numbering (root 1, children 2i and 2i+1).
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .features import matrix
from .neighbors import distinct_vectors, plain_id

NODE_SCHEMA = "tree int, node long, feature int, threshold double, path double"
TASK_VECTORS = 200_000
TREE_ROWS = 500_000              # vectors times trees that a task draws at once
BLOCK_VECTORS = 40_000           # vectors whose samples are drawn together beyond that
TABLE_VALUES = 30_000            # columns with more values are packed as they are, without codes
GROUP_VECTORS = 8_000_000        # packed vectors, or rows to be scored, that a group of trees gets whole
TREE_VECTORS = 16_000_000        # sampled rows of a tree that one task grows
BROADCAST_NODES = 4_000_000      # 22 bytes each
CHUNK_ROWS = 500_000             # rows that meet a group of trees in one task
NODE_VECTORS = 8_000             # nodes with more are split one by one where a task holds all vectors
NEAR_ROWS = 65_536               # rows whose values lie together in a task below that
_EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    many = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, many))


@dataclass
class Grower:
    """What the trees of a large forest are drawn from and grown by."""

    vectors: DataFrame     # settled: key, w and the columns
    names: list[str]
    trees: int
    share: float
    seed: int
    n_features: int
    max_depth: int
    drawn_only: bool       # a tree is a group of its own and gets the vectors it draws


@dataclass
class Forest:
    kept: DataFrame | None
    features: list[str]
    trees: int
    sample: int            # expected rows per tree
    grower: Grower | None = None

    @property
    def nodes(self) -> DataFrame:
        """The settled nodes; those of a forest that is grown while it scores are settled when first asked for."""
        if self.kept is None:
            self.kept = settle(_by_groups(self.grower))
        return self.kept


_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (two rounds of shift and multiplication)."""
    with np.errstate(over="ignore"):
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(32))


def chained(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit number for whole numbers in a row; each may be an array (they broadcast)."""
    h = np.uint64(0)
    for p in parts:
        h = _mixed(np.bitwise_xor(h, np.asarray(p).astype(np.uint64)))
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) with 53 bits of a hash."""
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _poisson(rate: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Poisson draws by inversion, beyond rate 30 by a rounded normal."""
    u = uniform(h)
    small = np.minimum(rate, 30.0)
    term = np.broadcast_to(np.exp(-small), u.shape).ravel()
    out = np.zeros(u.size)
    live = np.flatnonzero(u.ravel() > term)
    above, small, term = u.ravel()[live], np.broadcast_to(small, u.shape).ravel()[live], term[live]
    total = term.copy()
    for j in range(1, 120):
        if not len(live):
            break
        out[live] += 1
        term = term * small / j
        total += term
        more = above > total
        live, above, small, term, total = live[more], above[more], small[more], term[more], total[more]
    rate, out = np.broadcast_to(rate, u.shape), out.reshape(u.shape)
    if not (rate > 30.0).any():
        return out.astype(np.int64)
    normal = np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * uniform(_mixed(h)))
    return np.where(rate > 30.0, np.maximum(np.rint(rate + np.sqrt(rate) * normal), 0.0), out).astype(np.int64)


# What a draw is for; the first number of a chain.
_OF_VECTOR, _OF_TREE, _OF_NODE, _OF_CUT = 1, 2, 3, 4


def _vector_hashes(key: np.ndarray, seed: int) -> np.ndarray:
    return chained(seed, _OF_VECTOR, key)


def _draws(h: np.ndarray, rate: np.ndarray, tree: np.ndarray | int) -> np.ndarray:
    """How often each vector is in a tree's sample."""
    return _poisson(rate, _mixed(h ^ np.asarray(tree).astype(np.uint64)))


def _code(tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    """One number for a tree's node, in order of trees and nodes."""
    return (np.asarray(tree, np.int64) << 48) | np.asarray(node, np.int64)


def _held(batches):
    """Tables of some ``BLOCK_VECTORS`` rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= BLOCK_VECTORS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _blocks(batches, names: list[str], seed: int, share: float):
    """Values, hashes and rates of some ``BLOCK_VECTORS`` vectors at a time."""
    for f in _held(batches):
        x = np.stack([f[c].to_numpy() for c in names], axis=1).astype(float)
        yield x, _vector_hashes(f["key"].to_numpy(), seed), f["w"].to_numpy().astype(float) * share


def _placed(batches, names: list[str], trees: int, share: float, seed: int, tops: dict[str, np.ndarray]):
    """The with-replacement samples of a task's vectors, tree after tree, and the node each vector has come to.

    Yields values, codes of nodes in order, vectors and how often each is drawn. Vectors in leaves are left out.
    """
    for x, h, rate in _blocks(batches, names, seed, share):
        step = max(1, TREE_ROWS // len(x))
        for s in range(0, trees, step):
            n = _draws(h[None, :], rate[None, :], np.arange(s, min(trees, s + step))[:, None])
            tree, row = np.nonzero(n)
            n, tree = n[tree, row], tree + s
            node, live, inside = np.ones(len(row), np.int64), np.arange(len(row)), np.ones(len(row), bool)
            while len(live) and len(tops["code"]):
                code = _code(tree[live], node[live])
                at = np.minimum(np.searchsorted(tops["code"], code), len(tops["code"]) - 1)
                known = tops["code"][at] == code
                live, at = live[known], at[known]
                feature = tops["feature"][at]
                inside[live[feature < 0]] = False
                live, at, feature = live[feature >= 0], at[feature >= 0], feature[feature >= 0]
                node[live] = 2 * node[live] + (x[row[live], feature] > tops["threshold"][at])
            code, row, n = _code(tree, node)[inside], row[inside], n[inside]
            order = np.argsort(code, kind="stable")
            yield x, code[order], row[order], n[order]


def _heads(code: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)


def _members(vectors: DataFrame, names: list[str], trees: int, share: float, seed: int,
             tops: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(tree, node, x, counts, n): the drawn vectors of each node, packed column by column, and the rows drawn."""
    keyed = vectors if "key" in vectors.columns else _keyed(vectors)
    tops = tops or _NO_TOPS

    def pack(batches):
        for x, code, row, n in _placed(batches, names, trees, share, seed, tops):
            heads = _heads(code)
            ends = np.append(heads[1:], len(code))
            yield pa.RecordBatch.from_arrays([
                pa.array(code[heads] >> 48, pa.int32()), pa.array(code[heads] & ((1 << 48) - 1)),
                pa.array([x[row[a:b]].T.tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()),
                pa.array(np.add.reduceat(n, heads) if len(heads) else n)],
                names=["tree", "node", "x", "counts", "n"])

    return keyed.select("key", "w", *names).mapInArrow(pack, "tree int, node long, x binary, counts binary, n long")


def _keyed(vectors: DataFrame) -> DataFrame:
    """Vectors with a number of their own: of the least event id or, without one, of the vector itself."""
    name = F.coalesce(F.nullif(plain_id(F.col("id")), F.lit("")), F.col("id"))
    return vectors.withColumn("key", F.conv(F.left(F.md5(name), F.lit(15)), 16, 10).cast("long"))


def _whole_trees(vectors: DataFrame, names: list[str], trees: int, share: float, seed: int, n_features: int,
                 max_depth: int) -> DataFrame:
    """All nodes of all trees, each tree drawn and grown by one task; the draws are those of ``_members``."""
    spark = vectors.sparkSession
    f = _keyed(vectors).select("key", "w", *names).toArrow()
    sent = spark.sparkContext.broadcast((
        np.stack([f[c].to_numpy() for c in names]).astype(float),
        _vector_hashes(f["key"].to_numpy(), seed), f["w"].to_numpy().astype(float) * share))
    at_once = max(1, TREE_ROWS // max(1, len(f)))

    def grow(frames):
        x, h, rate = sent.value
        for f in frames:
            ids = f["id"].to_numpy()
            for s in range(0, len(ids), at_once):
                some = ids[s:s + at_once]
                n = _draws(h[None, :], rate[None, :], some[:, None])
                tree, row = np.nonzero(n)
                roots, first = np.unique(tree, return_index=True)
                yield _grow(x, row, n[tree, row], first, some[roots], np.ones(len(roots), np.int64),
                            seed, n_features, max_depth)

    tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, trees, 1, tasks).mapInPandas(grow, NODE_SCHEMA)


def _feature_order(seed: int, tree: np.ndarray, node: np.ndarray, width: int, n_features: int) -> np.ndarray:
    """Keys of the features at each node: the least of those that vary is split. Other trees' features are at infinity."""
    if len(tree) and (tree == tree[0]).all():
        own, of = tree[:1], np.zeros(len(tree), np.int64)
    else:
        own, of = np.unique(tree, return_inverse=True)
    ranks = np.argsort(np.argsort(uniform(chained(seed, _OF_TREE, own[:, None], np.arange(width))), axis=1), axis=1)
    asked = np.flatnonzero((ranks < n_features).any(axis=0))
    keys = np.full((len(tree), width), np.inf)
    keys[:, asked] = uniform(chained(seed, _OF_NODE, tree[:, None], node[:, None], asked))
    return keys if len(own) == 1 else np.where((ranks < n_features)[of], keys, np.inf)


def _cut_shares(seed: int, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    return uniform(chained(seed, _OF_CUT, tree, node))


def _cut(low: np.ndarray | float, high: np.ndarray | float, share: np.ndarray | float) -> np.ndarray:
    cut = low + share * (high - low)
    return np.where(cut < high, cut, low)


def _cuts(seed: int, tree: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _cut(low, high, _cut_shares(seed, tree, node))


def _depth(node: np.ndarray) -> np.ndarray:
    return np.frexp(np.asarray(node).astype(float))[1] - 1


def _segments(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of some segments in a row, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _levels(x: np.ndarray, rows: np.ndarray, n: np.ndarray, first: np.ndarray, tree: np.ndarray, node: np.ndarray,
            seed: int, n_features: int, max_depth: int):
    """(tree, node, feature, cut, path) of all nodes below some start nodes, level by level; leaves have feature -1.

    ``x`` holds a column after the other. ``rows`` are places in its columns, drawn ``n`` times each, in order of their
    nodes; ``first`` is where each node's rows begin. All nodes of a level are bounded, cut and parted together; the
    children of the i-th of its k split nodes are the next level's nodes i and k + i.
    """
    flat, width, m = x.ravel(), *x.shape
    while len(tree):
        count = np.diff(np.append(first, len(rows)))
        size = np.add.reduceat(n, first)
        feature, low, high = np.full(len(tree), -1, np.int64), np.zeros(len(tree)), np.zeros(len(tree))
        live = (size > 1) & (count > 1) & (_depth(node) < max_depth)
        if not live.all():
            kept = np.repeat(live, count)
            rows, n = rows[kept], n[kept]
        of = todo = np.flatnonzero(live)
        count = count[live]
        first = np.cumsum(count) - count
        values = flat[:0]
        if len(todo):
            keys = _feature_order(seed, tree[todo], node[todo], width, n_features)
            at, lengths, heads = None, count, first
            for _ in range(n_features):
                pick = np.argmin(keys, axis=1)
                v = flat.take((np.repeat(pick * m, lengths) + (rows if at is None else rows[at])))
                lo, hi = np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads)
                found = hi > lo
                feature[todo[found]], low[todo[found]], high[todo[found]] = pick[found], lo[found], hi[found]
                if at is None:
                    values = v
                else:
                    values[at] = v
                if found.all():
                    break
                keys[np.arange(len(todo)), pick] = np.inf
                at = np.flatnonzero(np.repeat(~found, lengths)) if at is None else at[np.repeat(~found, lengths)]
                todo, keys, lengths = todo[~found], keys[~found], lengths[~found]
                heads = np.cumsum(lengths) - lengths
        inner = feature >= 0
        split = inner[of]
        if not split.all():
            kept = np.repeat(split, count)
            rows, n, values, count = rows[kept], n[kept], values[kept], count[split]
            first = np.cumsum(count) - count
        cut, path = np.zeros(len(tree)), np.zeros(len(tree))
        cut[inner] = _cuts(seed, tree[inner], node[inner], low[inner], high[inner])
        path[~inner] = _depth(node[~inner]) + average_path(size[~inner])
        yield tree, node, feature, cut, path
        if not len(count):
            break
        right = values > np.repeat(cut[inner], count)
        to_right = np.add.reduceat(right, first, dtype=np.int64)
        rows, n = (np.concatenate([v[~right], v[right]]) for v in (rows, n))
        count = np.concatenate([count - to_right, to_right])
        first = np.cumsum(count) - count
        tree, node = np.tile(tree[inner], 2), np.concatenate([2 * node[inner], 2 * node[inner] + 1])


def _grow(x: np.ndarray, rows: np.ndarray, n: np.ndarray, first: np.ndarray, tree: np.ndarray, node: np.ndarray,
          seed: int, n_features: int, max_depth: int) -> pd.DataFrame:
    """All nodes below some start nodes in order of trees and nodes; see ``_levels``."""
    levels = _levels(x, rows, n, first, tree, node, seed, n_features, max_depth)
    tree, node, feature, cut, path = (np.concatenate(c) for c in zip(*levels, strict=True))
    order = np.lexsort((node, tree))
    return pd.DataFrame({"tree": tree[order].astype(np.int32), "node": node[order], "feature": feature[order].astype(np.int32),
                         "threshold": cut[order], "path": path[order]})


class _Columns:
    """Columns of vectors: codes of a table of values in order where a column has one, else the values."""

    def __init__(self, columns: list[np.ndarray], tables: list[np.ndarray | None]):
        self.columns, self.tables = columns, tables

    def __len__(self) -> int:
        return len(self.columns[0])

    def some(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The asked columns of some rows as values, one after the other; the others are left as they are."""
        out = np.empty((len(self.columns), len(rows)))
        for f in asked:
            v = self.columns[f].take(rows)
            out[f] = v if self.tables[f] is None else self.tables[f].take(v)
        return out

    def bounds(self, f: int, v: np.ndarray) -> tuple[float, float]:
        lo, hi = v.min(), v.max()
        return (lo, hi) if self.tables[f] is None else (self.tables[f][lo], self.tables[f][hi])

    def above(self, f: int, v: np.ndarray, cut: float) -> np.ndarray:
        if self.tables[f] is None:
            return v > cut
        at = np.searchsorted(self.tables[f], cut, "right")
        return v >= at if at < len(self.tables[f]) else np.zeros(len(v), bool)


def _tree(x: _Columns, drawn: np.ndarray, n: np.ndarray, tree: int, seed: int, n_features: int, max_depth: int,
          q: _Columns | None = None, paths: np.ndarray | None = None):
    """One tree in parts of (tree, node, feature, cut, path); adds the path of every row of ``q`` to ``paths``.

    ``drawn`` are the places of the sampled vectors in ascending order, ``n`` says for every vector how often. Large
    nodes are split one by one over single columns, so places keep their order; small ones are grown together, over
    the values of some ``NEAR_ROWS`` vectors.
    """
    width = len(x.columns)
    own = np.array([tree], np.int64)
    asked = np.flatnonzero(np.isfinite(_feature_order(seed, own, np.ones(1, np.int64), width, n_features)[0]))
    every = np.arange(0 if q is None else len(q), dtype=np.int32)
    open_, small = [(1, drawn, every)], []
    while open_:
        node = np.array([o[0] for o in open_], np.int64)
        trees = np.full(len(node), tree, np.int64)
        order = np.argsort(_feature_order(seed, trees, node, width, n_features), axis=1)[:, :len(asked)]
        share, depth = _cut_shares(seed, trees, node), _depth(node)
        feature, cut, path, below = np.full(len(node), -1, np.int64), np.zeros(len(node)), np.zeros(len(node)), []
        for i in range(len(node)):
            (_, rows, rows_q), open_[i] = open_[i], None
            size = n.take(rows).sum()
            if len(rows) <= NODE_VECTORS:
                small.append((node[i], rows, rows_q))
                feature[i] = -2
                continue
            for f in order[i] if depth[i] < max_depth else ():
                v = x.columns[f].take(rows)
                lo, hi = x.bounds(f, v)
                if hi > lo:
                    feature[i] = f
                    break
            if feature[i] < 0:
                path[i] = depth[i] + average_path(size)
                if q is not None:
                    paths[rows_q] += path[i]
                continue
            cut[i] = _cut(lo, hi, share[i])
            right = x.above(f, v, cut[i])
            right_q = q.above(f, q.columns[f].take(rows_q), cut[i]) if q is not None else np.zeros(0, bool)
            below += [(2 * node[i], rows[~right], rows_q[~right_q]), (2 * node[i] + 1, rows[right], rows_q[right_q])]
        done = feature > -2
        yield trees[done], node[done], feature[done], cut[done], path[done]
        open_ = below
    held, n_held = [], 0
    for k, s in enumerate(small):
        held, n_held = [*held, s], n_held + len(s[1])
        if n_held < NEAR_ROWS and k + 1 < len(small):
            continue
        node, rows = np.array([s[0] for s in held], np.int64), np.concatenate([s[1] for s in held])
        count = np.array([len(s[1]) for s in held])
        levels = list(_levels(x.some(rows, asked), np.arange(len(rows)), n.take(rows), np.cumsum(count) - count,
                              np.full(len(node), tree, np.int64), node, seed, n_features, max_depth))
        yield from levels
        if q is not None:
            rows_q, of = np.concatenate([s[2] for s in held]), np.repeat(np.arange(len(held)), [len(s[2]) for s in held])
            for a in range(0, len(rows_q), NEAR_ROWS):
                some = rows_q[a:a + NEAR_ROWS]
                paths[some] += _descend(levels, q.some(some, asked), of[a:a + NEAR_ROWS])
        held, n_held = [], 0


def _descend(levels: list[tuple], x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Path lengths of rows, columns ``x``, that begin at the ``of``-th nodes of the first level."""
    flat, m = x.ravel(), x.shape[1]
    out, live = np.zeros(m), np.arange(m)
    for _, _, feature, cut, path in levels:
        f = feature.take(of)
        inner = f >= 0
        if not inner.all():
            out[live[~inner]] = path.take(of[~inner])
            live, of, f = live[inner], of[inner], f[inner]
        if not len(live):
            break
        rank = np.cumsum(feature >= 0) - 1
        of = rank.take(of) + (rank[-1] + 1) * (flat.take(f * m + live) > cut.take(of))
    return out


def fit(train: DataFrame, features: list[str], trees: int = 600, max_samples: float | int = 0.5,
        max_features: float = 0.8, seed: int = 42, task_vectors: int = TASK_VECTORS) -> Forest:
    """Grow the forest; ``max_samples`` is a share (float) or a number of rows (int) per tree.

    With a share the model grows with the table (about one node per sampled row and tree); for very many rows give a
    number.
    """
    names = [f"f{i}" for i in range(len(features))]
    vectors = settle(distinct_vectors(train, features))
    total = vectors.agg(F.sum("w")).first()[0]
    if not total:
        raise ValueError("no training rows")
    sample = min(max_samples, total) if isinstance(max_samples, int) else max(1, int(max_samples * total))
    max_depth = math.ceil(math.log2(max(sample, 2)))
    n_features = max(1, int(max_features * len(names)))
    n_vectors = vectors.count()
    if n_vectors <= task_vectors:
        nodes = _whole_trees(vectors, names, trees, sample / total, seed, n_features, max_depth)
        return Forest(settle(nodes), features, trees, int(sample))
    keyed = settle(_keyed(vectors).select("key", "w", *names))
    if min(sample, n_vectors) <= TREE_VECTORS:
        grower = Grower(keyed, names, trees, sample / total, seed, n_features, max_depth, n_vectors > GROUP_VECTORS)
        return Forest(None, features, trees, int(sample), grower)
    tops = _tops(keyed, names, trees, sample / total, seed, n_features, max_depth, task_vectors) \
        if min(sample, n_vectors) > task_vectors else _NO_TOPS

    def grow(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(b).reshape(len(names), -1) for b in f["x"]], axis=1)
        n = np.concatenate([np.frombuffer(b, np.int64) for b in f["counts"]])
        return _grow(x, np.arange(len(n)), n, np.zeros(1, np.int64), np.array([key[0]], np.int64),
                     np.array([key[1]], np.int64), seed, n_features, max_depth)

    rows = _members(keyed, names, trees, sample / total, seed, tops)
    nodes = rows.groupBy("tree", "node").applyInPandas(grow, NODE_SCHEMA)
    if len(tops["code"]):
        nodes = nodes.unionByName(vectors.sparkSession.createDataFrame(pd.DataFrame({
            "tree": (tops["code"] >> 48).astype(np.int32), "node": tops["code"] & ((1 << 48) - 1),
            "feature": tops["feature"].astype(np.int32), "threshold": tops["threshold"], "path": tops["path"]}), NODE_SCHEMA))
    return Forest(settle(nodes), features, trees, int(sample))


def _tables(values: DataFrame, names: list[str]) -> list[np.ndarray | None]:
    """The values in order of every column that has at most ``TABLE_VALUES``."""
    def joined(held: np.ndarray | None, new: np.ndarray) -> np.ndarray | None:
        held = None if held is None else np.union1d(held, new)
        return held if held is not None and len(held) <= TABLE_VALUES else None

    def few(batches):
        held = [np.empty(0)] * len(names)
        for f in _held(batches):
            held = [h if h is None else joined(h, f[c].to_numpy()) for h, c in zip(held, names, strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(names)), pa.int32()),
            pa.array([None if h is None else h.tobytes() for h in held], pa.binary())], names=["column", "held"])

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        held = np.empty(0)
        for b in f["held"]:
            held = None if b is None else joined(held, np.frombuffer(b))
        return pd.DataFrame({"column": [key[0]], "held": [None if held is None else held.tobytes()]})

    made = "column int, held binary"
    found = values.select(*names).mapInArrow(few, made).groupBy("column").applyInPandas(merge, made).collect()
    tables = {r["column"]: r["held"] for r in found}
    return [None if tables.get(i) is None else np.frombuffer(tables[i]) for i in range(len(names))]


def _packed(rows: DataFrame, names: list[str], tables: list[np.ndarray | None], groups: int,
            draws: tuple[int, int, float] | None = None) -> DataFrame:
    """(group, key, w, x): blocks of rows, packed column by column, for each group of trees.

    With ``draws`` (seed, trees, share) a group gets the rows that its trees draw.
    """
    def pack(batches):
        for f in _held(batches):
            x = [f[c].to_numpy() for c in names]
            x = [v if t is None else np.searchsorted(t, v).astype(_code_type(t)) for v, t in zip(x, tables, strict=True)]
            key, w = f["key"].to_numpy(), f["w"].to_numpy()
            w = w.astype(np.min_scalar_type(w.max()))
            if draws is None:
                yield [*range(groups)], key, w, x
                continue
            seed, trees, share = draws
            h, rate = _vector_hashes(key, seed), w * share
            for group in range(groups):
                at = np.flatnonzero(sum(_draws(h, rate, tree) for tree in range(group, trees, groups)))
                if len(at):
                    yield [group], key[at], w[at], [v[at] for v in x]

    def packed(batches):
        for group, key, w, x in pack(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array([group], pa.list_(pa.int32())),
                *[pa.array([v], pa.binary()) for v in (key.tobytes(), w.tobytes(), b"".join(c.tobytes() for c in x))]],
                names=["group", "key", "w", "x"])

    return rows.select("key", "w", *names).mapInArrow(
        packed, "group array<int>, key binary, w binary, x binary").withColumn("group", F.explode("group"))


def _code_type(table: np.ndarray) -> np.dtype:
    return np.min_scalar_type(max(len(table) - 1, 0))


def _unpacked(blocks: list[tuple], tables: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, _Columns]:
    """Keys, counts and columns of packed blocks."""
    keys = [np.frombuffer(key, np.int64) for key, _, _ in blocks]
    w = [np.frombuffer(w, f"u{len(w) // len(k)}") for k, (_, w, _) in zip(keys, blocks, strict=True)]
    columns, at = [], [0] * len(blocks)
    for t in tables:
        kind = np.dtype(float if t is None else _code_type(t))
        columns.append(np.concatenate([np.empty(0, kind), *[
            np.frombuffer(x, kind, len(k), a) for k, (_, _, x), a in zip(keys, blocks, at, strict=True)]]))
        at = [a + kind.itemsize * len(k) for a, k in zip(at, keys, strict=True)]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *keys]), np.concatenate(w or [none]), _Columns(columns, tables)


def _by_groups(g: Grower, asked: DataFrame | None = None) -> DataFrame:
    """The nodes of all trees, or the sums of path lengths of the rows asked, group by group of trees.

    Sums are packed by blocks of rows: (block, group, rows, paths, grown); rows are named by the first group only.
    """
    both = g.vectors.select(*g.names)
    tables = _tables(both if asked is None else both.unionAll(asked.select(*g.names)), g.names)
    groups = g.trees if g.drawn_only else min(g.trees, 2 * g.vectors.sparkSession.sparkContext.defaultParallelism)
    sent = _packed(g.vectors, g.names, tables, groups, (g.seed, g.trees, g.share) if g.drawn_only else None).withColumn("asked", F.lit(False))
    if asked is not None:
        sent = sent.unionByName(_packed(asked, g.names, tables, groups).withColumn("asked", F.lit(True)))
    seed, share, trees, n_features, max_depth = g.seed, g.share, g.trees, g.n_features, g.max_depth
    scores = asked is not None

    def trees_of(batches):
        blocks, group = {False: [], True: []}, 0
        for batch in batches:
            for r in batch.to_pylist():
                blocks[r["asked"]].append((r["key"], r["w"], r["x"]))
                group = r["group"]
        key, w, x = _unpacked(blocks.pop(False), tables)
        sizes = [len(b[0]) // 8 for b in blocks[True]]
        rows, _, q = _unpacked(blocks.pop(True), tables)
        if not len(key) or (scores and not len(rows)):
            return
        h = _vector_hashes(key, seed)
        del key
        paths, grown = np.zeros(len(rows)), 0
        for tree in range(group, trees, groups):
            n = np.concatenate([_draws(h[a:a + NEAR_ROWS], w[a:a + NEAR_ROWS] * share, tree)
                                for a in range(0, len(h), NEAR_ROWS)])
            drawn = np.flatnonzero(n).astype(np.int32)
            if not len(drawn):
                continue
            grown += 1
            for of, node, feature, cut, path in _tree(x, drawn, n, tree, seed, n_features, max_depth,
                                                      q if len(rows) else None, paths):
                if not scores:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of.astype(np.int32)), pa.array(node), pa.array(feature.astype(np.int32)), pa.array(cut),
                         pa.array(path)], names=["tree", "node", "feature", "threshold", "path"])
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[a]]), pa.array([group], pa.int32()), pa.array([None if group else rows[a:b].tobytes()], pa.binary()),
                 pa.array([paths[a:b].tobytes()], pa.binary()), pa.array([grown], pa.int32())],
                names=["block", "group", "rows", "paths", "grown"])

    made = "block long, group int, rows binary, paths binary, grown int" if scores else NODE_SCHEMA
    return sent.repartitionById(groups, "group").mapInArrow(trees_of, made)


def _paths_while_growing(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows``, numbered, with ``_paths``, the mean of each row's path lengths, from trees that no table keeps."""
    asked = rows.select(F.col("_row").alias("key"), F.lit(1).cast("long").alias("w"), *matrix(rows, forest.features))

    def add(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("group")
        total = np.sum([np.frombuffer(b) for b in f["paths"]], axis=0)
        return pd.DataFrame({"_row": np.frombuffer(f["rows"].iloc[0], np.int64), "_paths": total / f["grown"].sum()})

    means = _by_groups(forest.grower, asked).groupBy("block").applyInPandas(add, "_row long, _paths double")
    return rows.join(means, "_row").drop("_row")


_NO_TOPS = {"code": np.empty(0, np.int64), "feature": np.empty(0, np.int64), "threshold": np.empty(0), "path": np.empty(0)}


def _tops(keyed: DataFrame, names: list[str], trees: int, share: float, seed: int, n_features: int, max_depth: int,
          task_vectors: int) -> dict[str, np.ndarray]:
    """Nodes with more vectors than a task should hold, split one level per round.

    Every round draws the samples anew where the vectors lie and shuffles the bounds of nodes only. What comes to the
    driver are the split nodes, some sampled rows / ``task_vectors`` a level.
    """
    low, high = ([f"{side}{i}" for i in range(len(names))] for side in ("lo", "hi"))

    def decide(frames):
        for f in frames:
            lo, hi = f[low].to_numpy(), f[high].to_numpy()
            tree, node = f["tree"].to_numpy().astype(np.int64), f["node"].to_numpy()
            keys = np.where(hi > lo, _feature_order(seed, tree, node, len(names), n_features), np.inf)
            pick, each = np.argmin(keys, axis=1), np.arange(len(f))
            splits = np.isfinite(keys[each, pick]) & (_depth(node) < max_depth)
            yield pd.DataFrame({
                "tree": tree, "node": node, "feature": np.where(splits, pick, -1),
                "threshold": np.where(splits, _cuts(seed, tree, node, lo[each, pick], hi[each, pick]), 0.0),
                "path": np.where(splits, 0.0, _depth(node) + average_path(f["size"].to_numpy()))})

    tops, open_ = _NO_TOPS, _code(np.arange(trees), np.ones(trees))
    while len(open_):
        def bound(batches, tops=tops, open_=open_):
            for x, code, row, n in _placed(batches, names, trees, share, seed, tops):
                asked = np.isin(code, open_)
                code, row, n = code[asked], row[asked], n[asked]
                heads = _heads(code)
                if not len(heads):
                    continue
                values = x[row]
                lo, hi = np.minimum.reduceat(values, heads, axis=0), np.maximum.reduceat(values, heads, axis=0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(code[heads] >> 48, pa.int32()), pa.array(code[heads] & ((1 << 48) - 1)),
                    pa.array(np.diff(np.append(heads, len(code)))), pa.array(np.add.reduceat(n, heads)),
                    *[pa.array(c) for c in lo.T], *[pa.array(c) for c in hi.T]],
                    names=["tree", "node", "vectors", "size", *low, *high])

        doubles = ", ".join(f"{c} double" for c in [*low, *high])
        large = keyed.mapInArrow(bound, f"tree int, node long, vectors long, size long, {doubles}").groupBy(
            "tree", "node").agg(F.sum("vectors").alias("vectors"), F.sum("size").alias("size"),
                                *[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high]).filter(
            F.col("vectors") > task_vectors)
        found = large.drop("vectors").mapInPandas(decide, NODE_SCHEMA).toArrow().to_pandas()
        code = _code(found["tree"].to_numpy(), found["node"].to_numpy())
        new = {"code": code, **{c: found[c].to_numpy() for c in ("feature", "threshold", "path")}}
        tops = {c: np.concatenate([tops[c], new[c]]) for c in new}
        order = np.argsort(tops["code"])
        tops = {c: v[order] for c, v in tops.items()}
        inner = found[found["feature"] >= 0]
        open_ = np.concatenate([_code(inner["tree"].to_numpy(), 2 * inner["node"].to_numpy() + k) for k in (0, 1)])
    return tops


def _linked(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Node arrays in heap order with the place of every left child and every root.

    The children of a tree's k-th inner node are its nodes 2k+1 and 2k+2 in heap order; leaves point to themselves.
    """
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    feature = nodes["feature"].to_numpy().astype(np.int16)
    root = np.flatnonzero(nodes["node"].to_numpy() == 1)
    inner = np.flatnonzero(feature >= 0)
    start = root[np.searchsorted(root, inner, "right") - 1]
    left = np.arange(len(nodes), dtype=np.int32)
    left[inner] = start + 1 + 2 * (np.arange(len(inner)) - np.searchsorted(inner, start))
    return {"feature": feature, "threshold": nodes["threshold"].to_numpy(), "path": nodes["path"].to_numpy(),
            "left": left, "root": root}


def _path_sum(x: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    total = np.zeros(len(x))
    for root in m["root"]:
        at = np.full(len(x), root)
        live, here = np.arange(len(x)), at.copy()
        while len(live):
            feature = m["feature"][here]
            inner = feature >= 0
            if not inner.all():
                at[live] = here
                live, here, feature = live[inner], here[inner], feature[inner]
            here = m["left"][here] + (x[live, feature] > m["threshold"][here])
        total += m["path"][at]
    return total


def score(df: DataFrame, forest: Forest, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Adds ``anomaly_score`` = 2^(-mean path / expected path), higher is more anomalous.

    A large forest without settled nodes is grown by tasks that walk up to
    ``GROUP_VECTORS`` rows down every tree at once. Otherwise a model within ``broadcast_nodes`` goes to every executor at once. Of a larger
    one, groups of whole trees of about that size and chunks of the rows meet in one
    task each, all pairs of them spread over the cluster; neither passes through the
    driver. Rows are numbered for that and get their own sums back by the number, so
    both ways give every row its own score whatever its id.
    """
    scale = float(average_path(forest.sample)) or 1.0
    rows = df.drop("anomaly_score")
    if forest.kept is None:
        rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()))
        if rows.count() <= GROUP_VECTORS:
            rows = _paths_while_growing(rows, forest)
            return rows.withColumn("anomaly_score", F.pow(F.lit(2.0), -F.col("_paths") / F.lit(scale))).drop("_paths")
        rows = rows.drop("_row")
    n_nodes = forest.nodes.count()
    grown = forest.nodes.filter("node = 1").count()
    groups = max(1, -(-n_nodes // broadcast_nodes))
    if groups == 1:
        model = df.sparkSession.sparkContext.broadcast(_linked(forest.nodes.toArrow().to_pandas()))
        total = _paths_udf(model)(F.struct(*matrix(rows, forest.features)))
    else:
        rows, total = _paths_by_groups(rows, forest, min(groups, forest.trees)), F.col("_paths")
    mean = total / F.lit(float(max(grown, 1)) * scale)
    return rows.withColumn("anomaly_score", F.pow(F.lit(2.0), -mean)).drop("_paths")


def _paths_by_groups(rows: DataFrame, forest: Forest, groups: int) -> DataFrame:
    """``rows`` with ``_paths``, the sum of each row's path lengths over all trees."""
    rows = settle(rows.withColumn("_row", F.monotonically_increasing_id()))
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    width = len(forest.features)

    def pack_rows(batches):
        for batch in batches:
            if batch.num_rows:
                row, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                chunk = int(_mixed(row[:1].astype(np.uint64))[0] % np.uint64(chunks))
                x = b"".join(c.astype(float).tobytes() for c in x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([row.tobytes()], pa.binary()), pa.array([x], pa.binary())],
                    names=["chunk", "rows", "x"])

    def pack_nodes(batches):
        for batch in batches:
            tree, *cols = (c.to_numpy() for c in batch.columns)
            order = np.argsort(tree, kind="stable")
            tree, cols = tree[order], [c[order] for c in cols]
            heads = _heads(tree)
            ends = np.append(heads[1:], len(tree))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree[heads], pa.int32()),
                 *[pa.array([c[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()) for c in cols]],
                names=["tree", "node", "feature", "threshold", "path"])

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = rows.select("_row", *matrix(rows, forest.features)).mapInArrow(
        pack_rows, "chunk int, rows binary, x binary").withColumn("part", each(groups))
    model = forest.nodes.select("tree", "node", "feature", "threshold", "path").mapInArrow(
        pack_nodes, "tree int, node binary, feature binary, threshold binary, path binary").withColumn(
        "part", F.pmod("tree", F.lit(groups))).withColumn("chunk", each(chunks))

    def walk(m: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(f):
            return pd.DataFrame({"_row": np.empty(0, np.int64), "_paths": np.empty(0)})
        types = {"node": np.int64, "feature": np.int32, "threshold": float, "path": float}
        nodes = {c: np.concatenate([np.frombuffer(b, t) for b in m[c]]) for c, t in types.items()}
        nodes["tree"] = np.repeat(m["tree"].to_numpy(), [len(b) // 8 for b in m["node"]])
        linked = _linked(pd.DataFrame(nodes))
        return pd.concat([pd.DataFrame({
            "_row": np.frombuffer(row, np.int64),
            "_paths": _path_sum(np.frombuffer(x).reshape(width, -1).T, linked)})
            for row, x in zip(f["rows"], f["x"], strict=True)], ignore_index=True)

    sums = model.groupBy("part", "chunk").cogroup(asked.groupBy("part", "chunk")).applyInPandas(
        walk, "_row long, _paths double").groupBy("_row").agg(F.sum("_paths").alias("_paths"))
    return rows.join(sums, "_row").drop("_row")


def _paths_udf(model):
    @F.pandas_udf(T.DoubleType())
    def paths(f: pd.DataFrame) -> pd.Series:
        return pd.Series(_path_sum(f.to_numpy(dtype=float), model.value))

    return paths
