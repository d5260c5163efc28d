"""Periodic runs against all lags of every document."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrank.llm import periodic, queries

from . import brute
from .conftest import rows_of


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:len(w) - q])


def brute_runs(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        at = 0
        while at < len(w) - q:
            end = at
            while end < len(w) - q and w[end] == w[end + q]:
                end += 1
            if end - at + q >= max(least, 2 * q) and smallest_period(w[at:end + q]) == q:
                out.add((at, end - at + q, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(w):
    runs = periodic.find_runs(np.unique(w, return_inverse=True)[1])
    return [(int(s), int(e - s), int(p)) for s, e, p in runs]


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def structured(rng):
    """Text with runs inside runs, and runs that touch."""
    w = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(rng.randint(1, rng.choice([3, 20, 60, 130])))]
        if rng.random() < 0.5:
            unit = unit[:3] * rng.randint(1, 12) + unit
        w += unit * rng.randint(1, 4) + unit[:rng.randint(0, len(unit))]
    return w[:700]


@pytest.mark.parametrize("seed", range(16))
def test_runs_of_structured_texts(seed):
    rng = random.Random(seed)
    for _ in range(4):
        w = structured(rng)
        assert found(w) == brute_runs(w)


@pytest.mark.parametrize("w", [
    ["a"] * 300, fibonacci(600), ["ab"[bin(i).count("1") % 2] for i in range(1024)], (["a"] * 50 + ["b"]) * 6, ["a"] * 11,
    ["a"] * 12, list("abcdef") * 2, list("abcdefg") * 2, [], ["a"], (list("ab") * 20 + ["c"]) * 3, ["a"] * 99 + ["b"] + ["a"] * 99,
    [str(i) for i in range(64)] * 2, [str(i) for i in range(63)] * 2 + ["0"], [str(i) for i in range(257)] * 2],
    ids=lambda w: f"{len(w)}")
def test_runs_of_special_words(w):
    assert found(w) == brute_runs(w)


def test_many_equal_words_take_bounded_work():
    n = 200_000
    assert found(["a"] * n) == [(0, n, 1)]
    w = (["a"] * (n // 4) + ["b"]) * 4
    got = found(w)
    assert (0, len(w), n // 4 + 1) in got and len(got) == 5


def test_a_chance_meeting_of_hashes_is_undone(monkeypatch):
    rng = random.Random(9)
    real = periodic.Stretches.after
    monkeypatch.setattr(periodic.Stretches, "after", lambda self, x, y: np.minimum(real(self, x, y) + 3, self.n - y))
    for _ in range(20):
        w = structured(rng)
        assert found(w) == brute_runs(w)


def cases(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        w = structured(rng) if i % 3 else [rng.choice(["le", "un", "é", "x,"]) for _ in range(rng.randint(0, 80))]
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\t"]) for x in w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, "a " * 30_000), (1004, "x" * 50_000), (None, "a b " * 9),
                   (1005, "a b c"), (1005, "a b c")]


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 4)])
def test_collapse_matches_brute_force(docs, seed, parts):
    rows = cases(seed)
    got = periodic.collapse(docs(rows, parts)).select("doc_id", "n_words", "collapsed", F.col("runs").cast("string").alias("runs"))
    want = []
    for doc, text in rows:
        w = brute.words(text)
        runs = brute_runs(w) if len(w) < 2000 else [(0, len(w), 1)]
        want.append((doc, len(w), brute_collapse(w, runs), "[" + ", ".join("{%d, %d, %d}" % r for r in runs) + "]"))
    assert rows_of(got, *got.columns) == sorted(want, key=repr)


def test_other_columns_stay(docs):
    table = docs([(1, "a " * 12)])
    again = periodic.collapse(periodic.collapse(table))
    assert again.columns == [c for c in table.columns if c not in periodic.RESULT] + list(periodic.RESULT)
    assert again.first()["collapsed"] == "a"
    assert periodic.collapse(docs([])).count() == 0


def test_query_plants_and_digests(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "cé", "d"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    rows += [(500 + i, None) for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc, text in rows:
        w = brute.words(text)
        n, h = len(w), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapse(w, runs).encode()).hexdigest()
    assert planted > 5
