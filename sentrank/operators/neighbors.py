"""Exact k-nearest-neighbour join (Euclidean) over shuffled, bounded blocks.

Both sides are folded to distinct vectors with counts, so copies cost nothing.
The training side is cut into cells by a small binary-split tree grown on a
bounded sample; every cell knows its exact bounding box and weight. Queries run
in two rounds:

1. each query meets the nearest block of its own cell: its k nearest there are kept, and
   bound its k-th distance;
2. each query goes to exactly those other blocks whose box comes closer than the bound,
   and the partial results are merged per query.

Inside a task neither all rows of a block nor all boxes meet each query: the rows lie in
small leaves with boxes of their own, the queries in small groups of near ones, and a group
looks only at what its own box and bounds can reach.

The boxes form a tree of three levels. A cell with more vectors than a task should hold is
cut into parts, by a split tree of its own from a bounded sample of the cell; a part is cut
by the task that owns it into blocks of ``block_rows`` vectors. Boxes of parts and blocks are
tables. Up to MAX_CELLS boxes of blocks are sent to every task; beyond that the boxes of the
cells are, whose number is bounded, and a query goes down from the cells near it to their
near parts and on to the near blocks of these by joins. Queries of a cell are salted, so one
task group is at most one block by one query chunk. Trees, samples and blocks only steer
efficiency: the result is exact for any of them.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .features import matrix

MAX_CELLS = 4096          # boxes: 4096 cells x 16 columns x 2 bounds = 1 MB
BLOCK_ROWS = 16_384       # vectors of a block, the training side of a task group
QUERY_ROWS = 16_384       # queries of a task group
LEAF_ROWS = 64            # vectors of a leaf inside a block
GROUP_QUERIES = 32        # near queries that look at leaves together
SAMPLE_ROWS = 40_000      # rows on the driver for the split tree
TASK_VECTORS = 65_536     # vectors of a cell or a part that one task cuts into blocks
PART_SAMPLE = 64          # sampled rows for each part of a cell
TREES_AT_ONCE = 100_000   # parts whose split trees are sent to the workers together (32 bytes each)


@dataclass
class Tree:
    """Binary splits; ``child < 0`` is leaf ``-child - 1``."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cells: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        if len(self.dim) == 0:
            return np.zeros(len(x), dtype=np.int32)
        node = np.zeros(len(x), dtype=np.int64)
        live = np.arange(len(x))
        while len(live):
            at = node[live]
            go = x[live, self.dim[at]] > self.cut[at]
            node[live] = np.where(go, self.right[at], self.left[at])
            live = live[node[live] >= 0]
        return (-node - 1).astype(np.int32)


def grow_tree(sample: np.ndarray, cells: int) -> Tree:
    """Median splits along the widest column, largest part first, up to ``cells`` leaves."""
    dim, cut, left, right = [], [], [], []
    parts = [(sample, None, None)]          # rows, parent node, side
    done = []
    while parts and len(parts) + len(done) < cells:
        parts.sort(key=lambda p: len(p[0]))
        rows, parent, side = parts.pop()
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(sample.shape[1])
        j = int(np.argmax(spread))
        if spread[j] <= 0:
            done.append((rows, parent, side))
            continue
        at = float(np.median(rows[:, j]))
        if at >= rows[:, j].max():
            at = float(rows[:, j][rows[:, j] < at].max())
        node = len(dim)
        dim.append(j), cut.append(at), left.append(0), right.append(0)
        if parent is not None:
            (left if side == 0 else right)[parent] = node
        low = rows[:, j] <= at
        parts += [(rows[low], node, 0), (rows[~low], node, 1)]
    leaves = done + parts
    for i, (_, parent, side) in enumerate(leaves):
        if parent is not None:
            (left if side == 0 else right)[parent] = -i - 1
    as_int = [np.array(v, dtype=np.int64) for v in (dim, left, right)]
    return Tree(as_int[0], np.array(cut, dtype=float), as_int[1], as_int[2], len(leaves))


@dataclass
class Index:
    """Distinct training vectors by cell, with the small facts about the cells."""

    rows: DataFrame           # f0.., id, w, cell, part, block
    columns: list[str]
    tree: Tree
    low: np.ndarray           # cells x columns
    high: np.ndarray
    weight: np.ndarray        # alerts per cell
    blocks: np.ndarray        # blocks per cell
    block_rows: int
    boxes: DataFrame | None   # cell, part, block, lo, hi; None if every cell is one block
    parts: DataFrame | None   # cell, part, lo, hi; None if every cell is one part
    units: "Units | None"     # all blocks, if their boxes are few enough for every task


@dataclass
class Units:
    """Keys, boxes and weights of blocks, by cell."""

    cell: np.ndarray
    part: np.ndarray
    block: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray


_BEHIND_ID = "\x01"         # sorts before every character of an id


def vector_key(columns: list[Column]) -> Column:
    """A text that is equal for equal vectors only (``matrix`` columns: no NULL, no NaN)."""
    return F.md5(F.concat_ws("|", *[(c + F.lit(0.0)).cast("string") for c in columns]))


def plain_id(neighbor: Column) -> Column:
    """The event id in a neighbour's name; empty if no row of the vector has one."""
    return F.split_part(neighbor, F.lit(_BEHIND_ID), F.lit(1))


def distinct_vectors(df: DataFrame, features: list[str], id_col: str = "event_id") -> DataFrame:
    """``f0…``, a unique name and the number of rows per distinct vector.

    The name is the smallest id and, behind it, the vector's key: unique also for
    repeated and missing ids, and in the order of the ids.
    """
    names = [f"f{i}" for i in range(len(features))]
    key = vector_key([F.col(c) for c in names])
    return df.select(F.col(id_col).cast("string").alias("id"), *matrix(df, features)).groupBy(*names).agg(
        F.min("id").alias("id"), F.count("*").alias("w")).withColumn(
        "id", F.concat(F.coalesce("id", F.lit("")), F.lit(_BEHIND_ID), key))


def _pick(n: np.ndarray, cell: Column) -> Column:
    """Per-cell whole number as an expression (the array has at most MAX_CELLS entries)."""
    return F.element_at(F.lit([int(v) for v in n]).cast("array<int>"), cell + 1)


def build_index(train: DataFrame, features: list[str], block_rows: int = BLOCK_ROWS,
                id_col: str = "event_id", task_vectors: int = TASK_VECTORS, numbered: bool = False) -> Index:
    """``numbered`` adds ``no`` to the index's rows: a unique whole number in the order of ``id``."""
    names = [f"f{i}" for i in range(len(features))]
    n = train.count()
    if n == 0:
        raise ValueError("no training rows")
    cells = max(1, min(MAX_CELLS, -(-n // block_rows)))
    share = max(1, n // SAMPLE_ROWS)
    sample = train.filter(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0).select(
        *matrix(train, features)).limit(2 * SAMPLE_ROWS)
    tree = grow_tree(sample.toPandas().to_numpy(dtype=float).reshape(-1, len(names)), cells)
    vectors = distinct_vectors(train, features, id_col)
    celled = settle(vectors.withColumn("cell", _cell_udf(tree)(F.struct(*names))))
    if numbered:
        celled = settle(celled.orderBy("id").withColumn("no", F.monotonically_increasing_id()))
    facts = {r["cell"]: r for r in celled.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"),
        F.array(*[F.min(c) for c in names]).alias("lo"), F.array(*[F.max(c) for c in names]).alias("hi"),
    ).collect()}
    low = np.full((tree.cells, len(names)), np.inf)
    high = np.full((tree.cells, len(names)), -np.inf)
    weight, blocks = np.zeros(tree.cells), np.ones(tree.cells, dtype=int)
    for c, r in facts.items():
        low[c], high[c], weight[c], blocks[c] = r["lo"], r["hi"], r["w"], -(-r["n"] // block_rows)
    celled, parts = celled.withColumn("part", F.lit(0)), None
    large = {c: r["n"] for c, r in facts.items() if r["n"] > task_vectors}
    if large:
        celled = _parted(celled, names, large, task_vectors)
        parts = settle(_boxes(celled, names, "cell", "part"))
    rows, boxes = celled.withColumn("block", F.lit(0)), None
    if blocks.max() > 1:
        schema = T.StructType([*celled.schema.fields, T.StructField("block", T.IntegerType())])

        def cut(f: pd.DataFrame) -> pd.DataFrame:
            return f.assign(block=_cut_cell(f[names].to_numpy(dtype=float), block_rows))

        rows = settle(celled.groupBy("cell", "part").applyInPandas(cut, schema))
        boxes = settle(_boxes(rows, names, "cell", "part", "block"))
        for r in boxes.groupBy("cell").agg(F.count("*").alias("n")).collect():
            blocks[r["cell"]] = r["n"]
    units = None
    if boxes is None:
        zero = np.zeros(tree.cells, dtype=int)
        units = Units(np.arange(tree.cells), zero, zero, low, high, weight)
    elif boxes.count() <= MAX_CELLS:
        held = sorted(boxes.collect(), key=lambda r: (r["cell"], r["part"], r["block"]))
        units = Units(*(np.array([r[c] for r in held]) for c in ("cell", "part", "block")),
                      np.array([r["lo"] for r in held]), np.array([r["hi"] for r in held]), np.array([float(r["w"]) for r in held]))
    return Index(rows, names, tree, low, high, weight, blocks, block_rows, boxes, parts, units)


def _boxes(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.array(*[F.min(c) for c in names]).alias("lo"), F.array(*[F.max(c) for c in names]).alias("hi"), F.sum("w").alias("w"))


def _parted(celled: DataFrame, names: list[str], large: dict[int, int], task_vectors: int) -> DataFrame:
    """The table with the ``part`` of each vector of a ``large`` cell (cell to vectors), about ``task_vectors`` in each.

    A cell's split tree grows in a task from some sampled rows for each of its parts. Trees go to the workers in groups
    of bounded size, with one pass over their cells for each.
    """
    spark = celled.sparkSession
    wanted = spark.createDataFrame(
        [(c, max(2, -(-2 * n // task_vectors)), max(1, n // (PART_SAMPLE * max(2, -(-2 * n // task_vectors))))) for c, n in large.items()],
        "_cell int, _parts int, _step int")
    sample = celled.join(F.broadcast(wanted), F.col("cell") == F.col("_cell")).where(     # at most MAX_CELLS rows
        F.pmod(F.xxhash64("id", F.lit(5)), F.col("_step")) == 0)

    def grow(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        t = grow_tree(f[names].to_numpy(dtype=float), int(f["_parts"].iloc[0]))
        return pd.DataFrame({"cell": [key[0]], "dim": [t.dim], "cut": [t.cut], "left": [t.left], "right": [t.right], "cells": [t.cells]})

    trees = settle(sample.groupBy("cell").applyInPandas(
        grow, "cell int, dim array<long>, cut array<double>, left array<long>, right array<long>, cells int"))
    seen = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)                # at most MAX_CELLS rows
    groups = trees.select("cell", F.floor(F.coalesce(F.sum("cells").over(seen), F.lit(0)) / TREES_AT_ONCE).cast("int").alias("g"))
    of_group: dict[int, list[int]] = {}
    for r in groups.collect():
        of_group.setdefault(r["g"], []).append(r["cell"])
    out = celled.where(~F.col("cell").isin(list(large)))
    for cells in of_group.values():
        sent = {r["cell"]: Tree(*(np.array(r[c]) for c in ("dim", "cut", "left", "right")), r["cells"])
                for r in trees.where(F.col("cell").isin(cells)).collect()}
        held = spark.sparkContext.broadcast(sent)
        mine = celled.where(F.col("cell").isin(cells)).withColumn("part", _part_udf(held)("cell", F.struct(*names)))
        out = out.unionByName(mine)
    return settle(out)


def _part_udf(held):
    @F.pandas_udf(T.IntegerType())
    def part(cell: pd.Series, f: pd.DataFrame) -> pd.Series:
        x, out = f.to_numpy(dtype=float), np.zeros(len(f), dtype=np.int32)
        for c in np.unique(cell.to_numpy()):
            mine = cell.to_numpy() == c
            out[mine] = held.value[int(c)].assign(x[mine])
        return pd.Series(out)

    return part


def _cut_cell(x: np.ndarray, block_rows: int) -> np.ndarray:
    """Block of each vector: median splits along the widest column down to ``block_rows``."""
    block, todo, n = np.zeros(len(x), dtype=np.int32), [np.arange(len(x))], 0
    while todo:
        rows = todo.pop()
        part = x[rows]
        spread = part.max(axis=0) - part.min(axis=0)
        if len(rows) <= block_rows or not spread.max() > 0:
            block[rows] = n
            n += 1
            continue
        j = int(np.argmax(spread))
        low = part[:, j] <= np.median(part[:, j])
        if low.all():
            low = part[:, j] < part[:, j].max()
        todo += [rows[low], rows[~low]]
    return block


def _box_gap(names: list[str]) -> Column:
    """Squared distance of a query to the nearest point of a block's box."""
    total = F.lit(0.0)
    for j, c in enumerate(names):
        gap = F.greatest(F.col("lo")[j] - F.col(c), F.col(c) - F.col("hi")[j], F.lit(0.0))
        total = total + gap * gap
    return total


def _nearest_box(queries: DataFrame, boxes: DataFrame, keys: list[str], name: str, names: list[str]) -> DataFrame:
    """Queries (qid, keys, vector) with the nearest of the boxes that have their keys, 0 if there is none."""
    return queries.join(boxes, keys, "left").groupBy("qid", *keys, *names).agg(
        F.coalesce(F.min_by(name, _box_gap(names)), F.lit(0)).alias(name))


def _cell_udf(tree: Tree):
    @F.pandas_udf(T.IntegerType())
    def cell(f: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.assign(f.to_numpy(dtype=float)))

    return cell


def _home_udf(tree: Tree, units: Units):
    """The unit in the own cell whose box is nearest."""
    first, last = (np.searchsorted(units.cell, np.arange(tree.cells), side) for side in ("left", "right"))

    @F.pandas_udf(T.IntegerType())
    def home(f: pd.DataFrame) -> pd.Series:
        x = f.to_numpy(dtype=float)
        cell = tree.assign(x)
        out = first[cell].astype(np.int32)
        for c in np.unique(cell[(last - first)[cell] > 1]):
            mine = np.flatnonzero(cell == c)
            for s in range(0, len(mine), 512):
                rows = mine[s:s + 512]
                near = _box_gaps(x[rows], units.low[first[c]:last[c]], units.high[first[c]:last[c]])
                out[rows] += np.argmin(near, axis=1).astype(np.int32)
        return pd.Series(out)

    return home


def _slack(qn: np.ndarray, tn: np.ndarray) -> np.ndarray:
    """Bound on the rounding error of |q|²-2qt+|t|²."""
    return 1e-12 * (qn + (tn.max() if len(tn) else 0.0)) + 1e-12


class Leaves:
    """The vectors of a block in small leaves with exact boxes, for searches by groups of near queries."""

    def __init__(self, t: np.ndarray, w: np.ndarray, ids: np.ndarray):
        leaf = _cut_cell(t, LEAF_ROWS)
        order = np.argsort(leaf, kind="stable")
        self.t, self.w, self.ids = t[order], w[order], ids[order]
        self.place = np.empty(len(t), np.int64)
        self.place[np.argsort(self.ids, kind="stable")] = np.arange(len(t))       # order of the ids
        first = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        self.size = np.diff(np.append(first, len(t)))
        self.low, self.high = np.minimum.reduceat(self.t, first), np.maximum.reduceat(self.t, first)
        self.center = t.mean(axis=0)
        self.tc = self.t - self.center
        self.tn = (self.tc * self.tc).sum(axis=1)
        self.heavy = bool((w > 1).any())

    def _squares(self, qc: np.ndarray, qn: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of some leaves (a mask) and the expanded squares of their distances."""
        rows = np.flatnonzero(np.repeat(leaves, self.size))
        return rows, qn[:, None] - 2.0 * qc @ self.tc[rows].T + self.tn[rows]

    def nearest(self, q: np.ndarray, ub2: np.ndarray, k: int, groups: list[np.ndarray]):
        """For every group of queries its places and, per query, distances and ids of the nearest ``k`` within its bound.

        The expanded square only preselects; kept distances are exact differences. Copies are repeated.
        """
        for g in groups:
            x = q[g]
            qc = x - self.center
            qn = (qc * qc).sum(axis=1)
            slack = _slack(qn, self.tn)
            gap = _group_gaps(x, self.low, self.high)
            bound = np.where(np.isnan(ub2[g]), np.inf, ub2[g])
            if np.isinf(bound).any():
                by_gap = np.argsort(gap, kind="stable")
                enough = int(np.searchsorted(np.cumsum(self.size[by_gap]), max(4 * k, 256))) + 1
                near = np.zeros(len(gap), dtype=bool)
                near[by_gap[:enough]] = True
                rows, d2 = self._squares(qc, qn, near)
                if len(rows) > k:
                    bound = np.fmin(bound, np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1], 0.0) + 2 * slack)
            rows, d2 = self._squares(qc, qn, gap <= bound.max() * (1 + 1e-9) + 1e-9)
            limit = bound + slack
            if len(rows) > k:
                limit = np.fmin(limit, np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * slack)
            qi, ti = np.nonzero(d2 <= limit[:, None])
            ti = rows[ti]
            exact = np.zeros(len(qi))
            for j in range(x.shape[1]):
                diff = x[qi, j] - self.t[ti, j]
                exact += diff * diff
            order = np.lexsort((self.place[ti], exact, qi))
            qi, ti, exact = qi[order], ti[order], np.sqrt(exact[order])
            edges = np.searchsorted(qi, np.arange(len(x) + 1))
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                b = min(b, a + k)
                d, n = exact[a:b], self.ids[ti[a:b]]
                if self.heavy:
                    copies = np.minimum(self.w[ti[a:b]], k)
                    d, n = np.repeat(d, copies)[:k], np.repeat(n, copies)[:k]
                found.append((d, n))
            yield g, found


def _grouped(q: np.ndarray) -> list[np.ndarray]:
    """Places of the queries in small groups of near ones."""
    group = _cut_cell(q, GROUP_QUERIES)
    order = np.argsort(group, kind="stable")
    ends = np.flatnonzero(np.diff(group[order])) + 1
    parts = np.split(order, ends)
    return [p[s:s + GROUP_QUERIES] for p in parts for s in range(0, len(p), GROUP_QUERIES)]


def _group_gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of the box of some points to every box."""
    gap = np.maximum(np.maximum(low - x.max(axis=0), x.min(axis=0) - high), 0.0)
    return (gap * gap).sum(axis=1)


def _box_gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from points to every box."""
    near = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0.0)
        near += gap * gap
    return near


def _visits(x: np.ndarray, ub2: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray, k: int):
    """Bounds of a group of near queries, and for each of them the boxes closer than its bound."""
    ub2 = np.where(np.isnan(ub2), np.inf, ub2)
    open_ = np.isinf(ub2)
    if open_.any():
        ub2[open_] = _box_bound(_box_distances(x[open_], low, high)[1], weight, k)
    some = np.flatnonzero(_group_gaps(x, low, high) <= ub2.max() * (1 + 1e-9) + 1e-9)
    hit = _box_gaps(x, low[some], high[some]) <= (ub2 * (1 + 1e-9) + 1e-9)[:, None]
    return ub2, [some[h].astype(np.int32) for h in hit]


_SEARCH = ["cell", "part", "block", "chunk"]


def _meet(queries: DataFrame, index: Index, chunks: np.ndarray, fn, out: str, label: str | None) -> DataFrame:
    """Cogroup query chunks with training blocks by (cell, part, block, chunk)."""
    copies = F.explode(F.sequence(F.lit(0), _pick(chunks, F.col("cell")) - 1))
    wanted = [*index.columns, "w", "cell", "part", "block", *([label] if label else [])]
    train = index.rows.select(*wanted).withColumn("chunk", copies)
    q = queries.withColumn("chunk", F.pmod(F.xxhash64("qid", F.lit(11)), _pick(chunks, F.col("cell"))).cast("int"))
    return q.groupBy(*_SEARCH).cogroup(train.groupBy(*_SEARCH)).applyInPandas(fn, out)


def _chunks(visits: DataFrame, index: Index, query_rows: int) -> np.ndarray:
    """Query chunks per cell, from the most queries that one of its blocks meets."""
    out = np.ones(index.tree.cells, dtype=int)
    met = visits.groupBy("cell", "part", "block").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("n"))
    for r in met.collect():
        out[r["cell"]] = max(1, -(-r["n"] // query_rows))
    return out


def knn_join(queries: DataFrame, index: Index, features: list[str], k: int, id_col: str = "event_id",
             query_block_rows: int = QUERY_ROWS, label: str | None = "id") -> DataFrame:
    """For every query row its ``id_col``, ``dists`` (k ascending distances) and ``neighbors`` (their names).

    ``neighbors`` names each distinct training vector (``plain_id`` gives its smallest
    event id), repeated per copy. One row comes back per query row, whether ids are
    missing, repeated or not. ``label`` is as in ``vector_join``.
    """
    found = vector_join(queries, index, features, k, query_block_rows, label)
    if label is None:
        return add_by_vector(queries, features, found).select(id_col, "dists")
    return add_by_vector(queries, features, found).select(id_col, "dists", "neighbors")


def add_by_vector(df: DataFrame, features: list[str], values: DataFrame) -> DataFrame:
    """``df`` with the columns of ``values`` (one row per vector key ``qid``): no row is lost or repeated."""
    return df.withColumn("_key", vector_key(matrix(df, features))).join(
        values.withColumnRenamed("qid", "_qid"), F.col("_key") == F.col("_qid")).drop("_key", "_qid")


def vector_join(queries: DataFrame, index: Index, features: list[str], k: int,
                query_block_rows: int = QUERY_ROWS, label: str | None = "id") -> DataFrame:
    """``dists`` and ``neighbors`` for every distinct query vector, named by its key ``qid``.

    ``label`` is the column of the index that names neighbours, in whose order equal distances come; without one
    there are ``dists`` only, and no names are shuffled.
    """
    total = int(index.weight.sum())
    if k < 1 or k > total:
        raise ValueError(f"k={k} but {total} training rows")
    names, units = index.columns, index.units
    distinct = queries.select(*matrix(queries, features)).distinct()
    keyed = distinct.withColumn("qid", vector_key([F.col(c) for c in names]))
    if units is not None:
        vectors = settle(keyed.withColumn("unit", _home_udf(index.tree, units)(F.struct(*names))))
        home = _of_unit(vectors, units)
        low, high, weight = units.low, units.high, units.weight
    else:
        vectors = settle(keyed.withColumn("cell", _cell_udf(index.tree)(F.struct(*names))))
        home = vectors.withColumn("part", F.lit(0)) if index.parts is None else _nearest_box(vectors, index.parts, ["cell"], "part", names)
        home = settle(_nearest_box(home, index.boxes, ["cell", "part"], "block", names))
        low, high, weight = index.low, index.high, index.weight

    # round 1: the k nearest in the nearest block of the own cell, and the boxes closer than the last of them
    def empty(columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame(columns=columns, dtype=object)

    def leaves(t: pd.DataFrame) -> Leaves:
        return Leaves(t[names].to_numpy(dtype=float), t["w"].to_numpy(), t[label].to_numpy() if label else np.zeros(len(t)))

    def first(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return empty(["qid", "ub2", "visits", "d", "n", *kept])
        x = q[names].to_numpy(dtype=float)
        ub2 = np.full(len(q), np.inf)
        d, n, visits = ([[]] * len(q) for _ in range(3))
        groups = _grouped(x)
        if len(t):
            for g, found in leaves(t).nearest(x, ub2, k, groups):
                for i, (di, ni) in zip(g, found):
                    d[i], n[i] = di, ni if label else []
                    if len(di) >= k:
                        ub2[i] = di[-1] * di[-1] * (1 + 1e-12) + 1e-300
        for g in groups:
            ub2[g], boxes = _visits(x[g], ub2[g], low, high, weight, k)
            for i, v in zip(g, boxes):
                visits[i] = v
        return pd.DataFrame({"qid": q["qid"].to_numpy(), "ub2": ub2, "visits": visits, "d": d, "n": n,
                             **{c: q[c].to_numpy() for c in kept}})

    kept = [*names, "cell", "part", "block"]
    floats = ", ".join(f"{c} double" for c in names)
    kind = dict(index.rows.dtypes)[label] if label else "int"
    chunks = _chunks(home, index, query_block_rows)
    begun = settle(_meet(home, index, chunks, first, f"qid string, ub2 double, visits array<int>, d array<double>, n array<{kind}>, "
                         f"{floats}, cell int, part int, block int", label))

    # round 2: the other blocks whose box is closer than the bound
    there = begun.select("qid", "ub2", *names, *[F.col(c).alias(f"_{c}") for c in ("cell", "part", "block")], F.explode("visits").alias("unit"))
    if units is not None:
        there = _of_unit(there, units)
    else:
        near = _box_gap(names) <= F.col("ub2") * (1 + 1e-9) + 1e-9
        there = there.withColumnRenamed("unit", "cell")
        there = there.withColumn("part", F.lit(0)) if index.parts is None else there.join(index.parts.drop("w"), "cell").filter(near).drop("lo", "hi")
        there = there.join(index.boxes.drop("w"), ["cell", "part"]).filter(near).drop("lo", "hi")
    there = there.where("cell <> _cell OR part <> _part OR block <> _block").drop("_cell", "_part", "_block")
    chunks2 = _chunks(there, index, query_block_rows)

    # a far query may visit very many blocks: merge their results in two steps
    visited = int(index.blocks.sum())
    salts = math.isqrt(visited) if visited > 64 else 1

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"qid": [], "salt": [], "d": [], "n": []}
        if len(q) and len(t):
            x = q[names].to_numpy(dtype=float)
            qids, salt = q["qid"].to_numpy(), ((int(t["cell"].iloc[0]) * 31 + int(t["part"].iloc[0])) * 31 + int(t["block"].iloc[0])) % salts
            for g, found in leaves(t).nearest(x, q["ub2"].to_numpy(dtype=float), k, _grouped(x)):
                for i, (d, n) in zip(g, found):
                    if len(d):
                        out["qid"].append(qids[i]), out["salt"].append(salt), out["d"].append(d), out["n"].append(n if label else [])
        return pd.DataFrame(out) if out["qid"] else empty(list(out))

    partial = _meet(there, index, chunks2, search, f"qid string, salt int, d array<double>, n array<{kind}>", label)
    best = F.arrays_zip("d", "n") if label else F.col("d")
    partial = partial.select("qid", "salt", best.alias("best"))
    if salts > 1:
        partial = _best_k(partial, ["qid", "salt"], k)
    merged = _best_k(partial.select("qid", "best").unionByName(begun.select("qid", best.alias("best"))), ["qid"], k)
    if label is None:
        return merged.select("qid", F.col("best").alias("dists"))
    return merged.select("qid", F.col("best.d").alias("dists"), F.col("best.n").alias("neighbors"))


def _of_unit(df: DataFrame, units: Units) -> DataFrame:
    """Rows with the cell, part and block of their ``unit``."""
    at = F.col("unit")
    return df.withColumns({"cell": _pick(units.cell, at), "part": _pick(units.part, at), "block": _pick(units.block, at)}).drop("unit")


def _best_k(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest of the lists that meet in a group; a list has at most k entries."""
    return partial.groupBy(*keys).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def _box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance from points to the nearest and the farthest point of every box."""
    near = np.zeros((len(x), len(low)))
    far = np.zeros_like(near)
    for j in range(x.shape[1]):
        below, above = low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]
        gap = np.maximum(np.maximum(below, above), 0.0)
        near += gap * gap
        reach = np.maximum(np.abs(below), np.abs(above))
        far += reach * reach
    empty = ~np.isfinite(low[:, 0])
    near[:, empty] = np.inf
    far[:, empty] = np.inf
    return near, far


def _box_bound(far: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Smallest far distance below which whole boxes already hold ``k`` rows."""
    order = np.argsort(far, axis=1)
    enough = np.argmax(np.cumsum(weight[order], axis=1) >= k, axis=1)
    return np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]


# --- scores on the join -----------------------------------------------------------

def standardised(df: DataFrame, train: DataFrame, features: list[str]) -> list[DataFrame]:
    """Both frames' features scaled by training mean and deviation; the original row is kept as ``_row``."""
    stats = train.agg(*[F.struct(F.avg(F.col(f).cast("double")).alias("m"),
                                 F.stddev_pop(F.col(f).cast("double")).alias("s")).alias(f)
                        for f in features]).first()
    scaled = {
        f: (F.col(f).cast("double") - F.lit(stats[f]["m"] or 0.0)) / F.lit(stats[f]["s"] or 1.0) for f in features
    }
    return [with_row(f, scaled) for f in (df, train)]


def with_row(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """The given features beside the whole row, which scoring gives back unchanged."""
    return df.select(F.struct("*").alias("_row"), F.col("event_id"), *[c.alias(n) for n, c in features.items()])


def mean_distance(near: DataFrame, k: int) -> DataFrame:
    """The k-NN score of every vector of a ``vector_join``."""
    mean = F.aggregate("dists", F.lit(0.0), lambda a, x: a + x) / F.lit(float(k))
    return near.select("qid", mean.alias("anomaly_score"))


def _both(df: DataFrame, train: DataFrame, features: list[str], scale: bool) -> list[DataFrame]:
    df = df.drop("anomaly_score")
    if scale:
        return standardised(df, train, features)
    return [with_row(f, {n: F.col(f"`{n}`") for n in features}) for f in (df, train)]


def knn_score(df: DataFrame, train: DataFrame, features: list[str], k: int = 35, scale: bool = False,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``anomaly_score``: the mean distance to the ``k`` nearest training rows."""
    q, t = _both(df, train, features, scale)
    near = vector_join(q, build_index(t, features, block_rows), features, k, label=None)
    return add_by_vector(q, features, mean_distance(near, k)).select("_row.*", "anomaly_score")


def lof_score(df: DataFrame, train: DataFrame, features: list[str], k: int = 20, scale: bool = False,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``anomaly_score``: local outlier factor against the training window (novelty form).

    Training vectors look for ``k`` others (one own copy is left out); densities
    live per distinct vector and are joined by its number.
    """
    q, t = _both(df, train, features, scale)
    index = build_index(t, features, block_rows, numbered=True)
    vectors = index.rows.select(F.col("no").alias("id"), *[F.col(c).alias(f) for c, f in zip(index.columns, features)])
    own = knn_join(vectors, index, features, k + 1, id_col="id", label="no").select(
        "id", F.slice("dists", 2, k).alias("dists"), F.expr(f"slice(array_remove(neighbors, id), 1, {k})").alias("others"),
        F.expr("filter(neighbors, n -> n = id)").alias("selves"))
    own = settle(own.select("id", "dists", F.concat(F.slice("selves", 2, k), "others").alias("neighbors"))
                 .withColumn("kdist", F.element_at("dists", -1)))

    def density(near: DataFrame, key: str, facts: DataFrame) -> DataFrame:
        """Rows (key, mean reach → lrd) from exploded neighbours."""
        links = near.select(key, F.inline(F.arrays_zip(F.col("dists").alias("d"), F.col("neighbors").alias("o"))))
        reach = links.join(facts.select(F.col("id").alias("o"), "kdist"), "o").groupBy(key).agg(
            (F.lit(1.0) / (F.avg(F.greatest("d", "kdist")) + F.lit(1e-10))).alias("lrd"))
        return reach

    lrd_train = settle(density(own, "id", own))
    near = settle(vector_join(q, index, features, k, label="no"))
    lrd_query = density(near, "qid", own)
    links = near.select("qid", F.explode("neighbors").alias("o"))
    around = links.join(lrd_train.select(F.col("id").alias("o"), F.col("lrd").alias("lrd_o")), "o").groupBy(
        "qid").agg(F.avg("lrd_o").alias("lrd_o"))
    scores = around.join(lrd_query, "qid").select("qid", (F.col("lrd_o") / F.col("lrd")).alias("anomaly_score"))
    return add_by_vector(q, features, scores).select("_row.*", "anomaly_score")
