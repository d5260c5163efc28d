"""Suffix-array and Lempel-Ziv deduplication against plain versions."""

import random

import numpy as np
import pytest

from sentrank.llm import rlz_dedup, slabs, suffix_dedup

from . import brute
from .conftest import rows_of


def passages(seed, n, unit):
    rng = random.Random(seed)
    pool = [unit(rng, rng.randint(1, 120)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else unit(rng, rng.randint(1, 60)) for _ in range(rng.randint(0, 5))]
        text = " ".join(parts)
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "é" + text[at + 1:]
        rows.append((i, text))
    rng.shuffle(rows)
    return rows


def letters(rng, n):
    return "".join(rng.choice("ab cé\n") for _ in range(n))


def small_words(rng, n):
    return " ".join(rng.choice(["a", "b", "cc", "É", "x."]) for _ in range(n))


EDGE = [(900, None), (901, ""), (902, "a" * 400), (903, "a" * 49), (904, "a" * 50), (905, "ab" * 300), (906, " \n ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(docs, seed):
    rows = passages(seed, 80, letters) + EDGE
    got = suffix_dedup.remove_repeats(docs(rows, 4))
    want = sorted(((k, *v) for k, v in brute.suffix_dedup(rows).items()), key=repr)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("seed", [3, 4])
def test_words_match_brute_force(docs, seed):
    rows = passages(seed, 80, small_words) + EDGE + [(907, "w " * 500), (908, "v w " * 300), (909, "w " * 19)]
    got = rlz_dedup.remove_repeats(docs(rows, 4))
    want = sorted(((k, *v) for k, v in brute.substring_dedup(rows).items()), key=repr)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    for r in got.collect():
        assert len(r.kept.split()) == r.n_words - r.n_removed


def test_several_chunks_and_slabs(docs, monkeypatch, spark):
    """Bounds of the tasks do not change results."""
    rows = passages(5, 60, letters)
    want = sorted(((k, *v) for k, v in brute.suffix_dedup(rows).items()), key=repr)
    table = slabs.to_slabs(docs(rows, 3), slab_bytes=500)
    assert table.count() > 8
    monkeypatch.setattr(slabs, "to_slabs", lambda docs, slab_bytes=500, make=slabs.to_slabs: make(docs, 500))
    got = suffix_dedup.remove_repeats(docs(rows, 3))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("bucket_bytes", [300, 1 << 24])
def test_buckets_follow_the_text(docs, monkeypatch, bucket_bytes):
    """However many buckets a partition has, runs are found; with more text come more buckets, not larger ones."""
    rows = passages(6, 60, small_words)
    monkeypatch.setattr(slabs, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(slabs, "to_slabs", lambda docs, make=slabs.to_slabs: make(docs, 500))
    table = slabs.to_slabs(docs(rows, 3))
    text = sum(len((t or "").encode()) for _, t in rows)
    n = slabs.bucket_count(table, 4)
    assert n % 4 == 0 and (n - 4) * bucket_bytes < text <= n * bucket_bytes
    want = sorted(((k, *v) for k, v in brute.suffix_dedup(rows).items()), key=repr)
    got = suffix_dedup.remove_repeats(docs(rows, 3))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    want = sorted(((k, *v) for k, v in brute.substring_dedup(rows).items()), key=repr)
    got = rlz_dedup.remove_repeats(docs(rows, 3), heavy=200)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_partitions_get_equally_many_buckets(spark):
    sent = spark.range(3000).selectExpr("cast(id % 60 as int) as bucket", "id")

    def seen(group):
        from pyspark import TaskContext
        import pyarrow as pa
        return pa.table({"part": [TaskContext.get().partitionId()], "n": [group.num_rows]})

    got = slabs.by_bucket(sent, seen, "part bigint, n bigint", 12).collect()
    assert sorted(r.part for r in got) == sorted(list(range(12)) * 5) and all(r.n == 50 for r in got)


def test_chunks_hold_whole_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2, 3000).astype(np.uint8)
    starts = np.arange(0, 2900, 60)
    anchor = rng.integers(0, 6, len(starts)).astype(np.uint64)
    anchor.sort()
    value = slabs.squeeze(anchor, np.arange(len(starts)), np.zeros(len(starts), bool), np.arange(len(starts), dtype=np.int32),
                          np.zeros(len(starts), np.int64), np.full(len(starts), 60, np.int32), text[:60 * len(starts)])
    import pyarrow as pa
    group = pa.table({"bucket": [0], "slab": [7], "pieces": [value], "known": pa.array([None], pa.binary())})
    seen = []

    def find(pieces, spec):
        seen.append(set(pieces.doc.tolist()))
        return np.zeros(len(pieces.text), bool)

    monkeypatch.setattr(slabs, "CHUNK_SYMBOLS", 300)
    slabs.resolve(group, slabs.Spec(4, 8, None, np.uint8, True, find))
    assert sorted(sum(map(sorted, seen), [])) == list(range(len(starts)))
    for value in range(6):
        mine = set(np.flatnonzero(anchor == value).tolist())
        assert sum(bool(mine & s) for s in seen) <= 1


@pytest.mark.parametrize("module", [suffix_dedup, rlz_dedup])
def test_rows_without_or_with_shared_id(docs, module):
    text = " ".join(f"word{i}" for i in range(40))
    got = module.remove_repeats(docs([(None, text), (None, text), (4, text), (4, text), (5, text)]))
    gone = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in got.collect())
    if module is suffix_dedup:
        assert gone == [(False, 4, False), (False, 4, False), (False, 5, True), (True, 0, False), (True, 0, False)]
    else:
        assert gone == [(False, 4, False), (False, 4, True), (False, 5, True), (True, 0, True), (True, 0, True)]


@pytest.mark.parametrize("module", [suffix_dedup, rlz_dedup])
def test_empty_table(docs, module):
    assert module.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("module", [suffix_dedup, rlz_dedup])
def test_hot_passage(docs, module):
    text = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"start{i} {text} end{i}") for i in range(2000)]
    got = {r.doc_id: r.n_removed for r in module.remove_repeats(docs(rows, 8, extra=False)).collect()}
    assert got[0] == 0 and all(got[i] > 0 for i in range(1, 2000))


def test_smaller_neighbours():
    key = np.random.default_rng(0).integers(0, 9, 500)
    before, after = slabs.smaller_neighbours(key)
    for i in range(500):
        assert before[i] == max((j for j in range(i) if key[j] < key[i]), default=-1)
        assert after[i] == min((j for j in range(i + 1, 500) if key[j] < key[i]), default=500)


def greedy_ends(pieces):
    """Ends of factors, piece by piece in order: longest matches that begin at an earlier place."""
    places = [(p, i) for p, words in enumerate(pieces) for i in range(len(words))]
    out = []
    for p, words in enumerate(pieces):
        at, ends = 0, []
        while at < len(words):
            longest = 0
            for q, i in places:
                if (q, i) < (p, at):
                    n = 0
                    while at + n < len(words) and i + n < len(pieces[q]) and words[at + n] == pieces[q][i + n]:
                        n += 1
                    longest = max(longest, n)
            step = max(1, longest)
            ends += [at + step] * step
            at += step
        out.append(ends)
    return out


def test_pieces_are_factored_greedily():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pieces = [rng.integers(1, 4, int(rng.integers(1, 25))).tolist() for _ in range(int(rng.integers(1, 8)))]
        words = np.array(sum(([*p, 0] for p in pieces), []))
        size = np.array([len(p) for p in pieces])
        first = np.cumsum(size + 1) - size - 1
        ends = rlz_dedup.parse(words, np.arange(len(words)), first, size)
        for f, n, want in zip(first, size, greedy_ends(pieces), strict=True):
            assert (ends[f:f + n] - f).tolist() == want


def test_factors_decide(docs, monkeypatch):
    """Runs inside long factors are found by the factors alone: without factoring they are missed."""
    rows = passages(3, 40, small_words)
    want = sorted(((k, *v) for k, v in brute.substring_dedup(rows).items()), key=repr)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(rlz_dedup.remove_repeats(docs(rows, 2)), *columns) == want
    real = rlz_dedup.parse
    text = np.array([*range(1, 31), 0, 0, *range(1, 31), 0])      # a piece of thirty words, twice
    ends = real(text, np.arange(len(text)), np.array([0, 32]), np.array([30, 30]))
    assert set(ends[32:62].tolist()) == {62} and ends[:30].tolist() == list(range(1, 31))
    spec = slabs.Spec(6, 20, None, np.uint64, False, None)
    near = np.concatenate([np.arange(1, 35), np.arange(1, 34), [99]]).astype(np.uint64)
    pieces = slabs.Pieces(np.array([1, 2]), np.zeros(2, bool), np.zeros(2, np.int64), np.arange(2, dtype=np.int32),
                          np.zeros(2, np.int64), np.array([0, 34]), np.array([34, 34]), near)
    assert rlz_dedup.find(pieces, spec).sum() == 14
    monkeypatch.setattr(rlz_dedup, "looked_up", lambda words, place, runs, asked, length: np.zeros(len(asked), bool))
    assert rlz_dedup.find(pieces, spec).sum() == 14
    monkeypatch.setattr(rlz_dedup, "parse", lambda words, place, first, size: np.arange(len(words)) + 1)
    assert rlz_dedup.find(pieces, spec).sum() == 0
