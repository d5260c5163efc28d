"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from sentrank.llm import common, ngram_join

from . import brute
from .conftest import rows_of


def near(seed, n=120):
    rng = random.Random(seed)
    rows, i = [], 0
    while len(rows) < n:
        base = [rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(1000))
            rows.append((i, " ".join(copy)))
            i += 1
    rng.shuffle(rows)
    return rows


EDGE = [(900, None), (901, ""), (902, "  \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE two"), (907, "x " * 9000)]


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (1, 50), (2, 100)])
def test_components_match_all_pairs(docs, words, percent):
    rows = near(words) + EDGE
    got = ngram_join.link(docs(rows, 3), words, percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(rows, words, percent), key=repr)


def test_blocks_do_not_change_results(docs):
    rows = near(9)
    want = sorted(brute.components(rows, 4, 85), key=repr)
    got = ngram_join.link(docs(rows), 4, 85, unit_shingles=150)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want


def test_ids_missing_or_shared(docs):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text + " x"), (3, text + " y"), (3, text), (3, text), (None, "quite another text of words"), (None, None)]
    got = ngram_join.link(docs(rows))
    assert rows_of(got, "doc_id", "component_id") == sorted(
        [(None, 3), (None, 3), (3, 3), (3, 3), (3, 3), (None, None), (None, None)], key=repr)
    left = ngram_join.keep_first(docs(rows))
    assert left.columns == docs(rows).columns
    assert sorted(r.text or "" for r in left.collect() if r.doc_id is None) == ["", "quite another text of words"]
    assert {r.doc_id for r in left.collect()} == {3, None}


def test_keep_first_keeps_one_of_each(docs):
    rows = near(11) + EDGE
    stay = {c for d, _, c in brute.components(rows, 5, 80)}
    assert sorted(r.doc_id for r in ngram_join.keep_first(docs(rows)).collect()) == sorted(stay)


def test_empty_table(docs):
    assert ngram_join.link(docs([])).count() == 0
    assert ngram_join.keep_first(docs([])).count() == 0


def test_hot_group_of_near_copies(docs):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    got = ngram_join.link(docs(rows, 6, extra=False))
    assert got.where("component_id = 0").count() == 1500


def sent_sets(monkeypatch):
    """How many sets each search was sent, and to how many units."""
    sent, real = [], ngram_join._searched

    def counted(slabs, members, *rest):
        sent.append((members.count(), members.select("unit").distinct().count()))
        return real(slabs, members, *rest)

    monkeypatch.setattr(ngram_join, "_searched", counted)
    return sent


def test_a_large_component_sends_each_set_once(docs, monkeypatch):
    """Near copies over very many blocks: every set goes to one of them, and a few leads to all."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"n{i}" if k == at else w for k, w in enumerate(base))) for i in range(600) for at in [rng.randrange(120)]]
    sent = sent_sets(monkeypatch)
    got = ngram_join.link(docs(rows, 4, extra=False), unit_shingles=2000)
    assert got.where("component_id = 0").count() == 600
    (n_sets, n_units), = sent
    assert n_units > 40 and n_sets <= 600 + ngram_join.LEADS * n_units


def test_sets_that_leads_do_not_reach_meet_every_block(docs, monkeypatch):
    """A chain of small changes: its ends are far from any lead, and all of it is one component."""
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(150):
        base = base[1:] + [f"x{i}"]
        rows.append((i, " ".join(base)))
    rows += [(500 + i, " ".join(f"y{i}.{k}" for k in range(60))) for i in range(3)]
    sent = sent_sets(monkeypatch)
    got = ngram_join.link(docs(rows, 4), 4, 85, unit_shingles=1500)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(rows, 4, 85), key=repr)
    assert len(sent) == 2


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(6, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        out = rng.integers(0, 1 + int(0.17 * n))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[int(out * rng.random()):]],
                                      rng.integers(0, 2**63, int(out * rng.random())).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same < 85 * (len(a) + len(b) - same) or np.array_equal(a, b):
            continue
        values, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        signs, of, spare = ngram_join.signatures(values, doc, np.array([0, len(a), len(values)]), np.ones(2, bool), 85)
        common = max(((np.intersect1d(signs[of == x], signs[of == 2 + y]).size, x, y) for x in (0, 1) for y in (0, 1)))
        assert common[0] > max(spare[common[1]], spare[2 + common[2]])


def test_components_of_edges(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.v: r.root for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {x: root(x) for x in list(parent)}
    assert got == {x: r for x, r in want.items() if sum(v == r for v in want.values()) > 1}
