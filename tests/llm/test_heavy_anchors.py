"""Anchors with more pieces than a task should hold: their runs are dealt one by one, with the same results."""

import random
from collections import Counter

import numpy as np
import pytest

from sentrank.llm import rlz_dedup, slabs, suffix_dedup

from . import brute
from .conftest import rows_of
from .test_repeats import EDGE, letters, passages, small_words


@pytest.mark.parametrize("heavy", [0, 400, 3000])
def test_bytes_by_run(docs, monkeypatch, heavy):
    rows = passages(11, 60, letters) + EDGE
    want = sorted(((k, *v) for k, v in brute.suffix_dedup(rows).items()), key=repr)
    monkeypatch.setattr(slabs, "to_slabs", lambda docs, make=slabs.to_slabs: make(docs, 500))
    got = suffix_dedup.remove_repeats(docs(rows, 3), heavy=heavy)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("heavy", [0, 150, 1000])
def test_words_by_run(docs, monkeypatch, heavy):
    rows = passages(12, 60, small_words) + EDGE + [(907, "w " * 500), (908, "v w " * 300)]
    want = sorted(((k, *v) for k, v in brute.substring_dedup(rows).items()), key=repr)
    monkeypatch.setattr(slabs, "to_slabs", lambda docs, make=slabs.to_slabs: make(docs, 500))
    got = rlz_dedup.remove_repeats(docs(rows, 3), heavy=heavy)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("op", [suffix_dedup, rlz_dedup])
def test_ids_missing_or_repeated(docs, op):
    rows = passages(13, 40, small_words)
    rows = [(None if i % 7 == 0 else i // 3, t) for i, t in rows]
    names = ("doc_id", "n_removed", "kept_sha256")
    source = docs(rows, 3)
    assert rows_of(op.remove_repeats(source, heavy=0), *names) == rows_of(op.remove_repeats(source, heavy=1 << 40), *names)


def test_no_task_holds_a_heavy_anchor(docs):
    """A passage between surroundings that differ: what is sent around one anchor stays bounded."""
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh") for _ in range(120))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(90)) + passage + "".join(rng.choice("qrstuvwx") for _ in range(90)))
            for i in range(300)]
    spec = slabs.Spec(suffix_dedup.ANCHOR, 50, suffix_dedup._symbols, np.uint8, True, suffix_dedup.find, 2000)
    table = slabs.to_slabs(docs(rows, 3), 4000)
    bits = slabs.shared_bits(table, spec, 5, 5).toArrow().to_pylist()
    weight, runs = Counter(), Counter()
    for row in table.toArrow().to_pylist():
        mine = [b for b in bits if b["slab"] == row["slab"]]
        for sent in slabs.pieces_of(slabs.Slab.read(row), mine, spec, 5).to_pylist():
            if sent["pieces"]:
                anchor, *_, size, _ = slabs.unsqueeze(sent["pieces"], np.uint64, np.int64, bool, np.int32, np.int64, np.int32, np.uint8)
                for a, n in zip(anchor.tolist(), size.tolist()):
                    weight[a] += n
            if sent["runs"]:
                runs.update(slabs.unsqueeze(sent["runs"], np.uint64, np.int64, bool)[0].tolist())
    assert max(weight.values(), default=0) <= 2000
    assert max(runs.values()) <= table.count()
