"""Exact and line deduplication against plain versions."""

import random

import pytest

from sentrank.llm import exact_dedup, line_dedup

from . import brute
from .conftest import rows_of

TEXTS = ["a b c", "abc", " a\tb\nc ", "A b c", "", " \n", None, "é x", "é x", "x" * 5000, "x" * 4999 + " x"]


def test_exact_matches_brute_force(docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(TEXTS)) for i in range(200)]
    got = exact_dedup.mark(docs(rows, 5))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(rows), key=repr)
    assert len(got.columns) == len(set(got.columns))


def test_exact_keeps_one_row_of_each_group_whatever_the_ids(docs):
    rows = [(None, "a b"), (None, "a b"), (3, "ab"), (3, "ab"), (3, "a b"), (None, None), (None, ""), (7, "z"), (7, "z")]
    got = exact_dedup.mark(docs(rows, 3))
    assert got.count() == len(rows)
    kept = sorted((r.doc_id, r.text) for r in got.where("kept").collect() if r.text)
    assert kept == [(3, "a b"), (7, "z")]
    assert got.where("kept").count() == 3
    assert exact_dedup.deduplicate(docs(rows)).count() == 3


def test_exact_null_id_loses(docs):
    got = exact_dedup.mark(docs([(None, "ab"), (9, "ab"), (None, "a b c"), (1, "abc")])).where("kept").collect()
    assert {r.text: r.doc_id for r in got} == {"ab": 9, "a b c": None}


def test_exact_hot_group(docs, spark):
    rows = [(i, "same text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 3100)]
    got = exact_dedup.mark(docs(rows, 16, extra=False), ["doc_id"])
    assert got.where("kept").count() == 101
    assert got.where("group_size = 3000 AND keep_id = 0").count() == 3000


def lines_case():
    rng = random.Random(2)
    pool = ["one", "two", "three", "", "four " * 30, "é"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "a\nb"), (103, "a\n" * 4000), (104, rows[0][1])]


def test_lines_match_brute_force(docs):
    rows = lines_case()
    got = line_dedup.remove_repeats(docs(rows, 4))
    want = sorted(((k, *v) for k, v in brute.line_dedup(rows).items()), key=repr)
    assert rows_of(got, "doc_id", "kept_text", "n_lines", "n_removed", "n_spans") == want


def test_lines_without_id_come_last(docs):
    got = line_dedup.remove_repeats(docs([(None, "a\nb\nc"), (5, "a\nb\nc"), (None, "a\nb\nc")]))
    assert rows_of(got, "doc_id", "n_removed") == sorted([(5, 0), (None, 3), (None, 3)], key=repr)


@pytest.mark.parametrize("run", [exact_dedup.mark, line_dedup.remove_repeats, exact_dedup.deduplicate])
def test_empty_table(docs, run):
    assert run(docs([])).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.mark, line_dedup.remove_repeats])
def test_no_python_on_executors(docs, run):
    plan = run(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
