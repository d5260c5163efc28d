"""Budgeted windows of conversations against the rows they are made from."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sentrank.llm import chat_windows as cw
from sentrank.llm import queries, wordpieces

TOKENIZER = Tokenizer.from_file(wordpieces.default_path())
SCHEMA = "conv_id bigint, turn bigint, role string, text string, window int, `a.b` string"
BITS = ["<", "[", "\\", "/", "s>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "SYS>>", "INST]", " ", "\n", "é", "😀",
        "[ROLE]", "[/ROLE] ", "[/END]", "<\\s>", "word"]


@given(st.lists(st.sampled_from(BITS), max_size=25).map("".join))
@settings(max_examples=600, deadline=None)
def test_escapes_are_reversible_and_leave_no_mark(text):
    hidden = cw.escape(text)
    assert cw.unescape(hidden) == text
    assert not any(c in hidden for c in cw.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", "<s>"]),
                          st.lists(st.sampled_from(BITS), max_size=8).map("".join)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_windows_parse_to_their_turns(turns):
    assert cw.parse("".join(cw.formatted(*t)[0] for t in turns)) == turns


def test_spans_are_greedy_and_within_budget():
    rng = np.random.default_rng(3)
    for _ in range(200):
        tokens, budget, history = rng.integers(0, 40, int(rng.integers(1, 40))), int(rng.integers(20, 120)), int(rng.integers(0, 4))
        at = 0
        for begin, start, end in cw.spans(tokens, 0, budget, history):
            assert start == at < end and start - history <= begin <= start
            total = tokens[begin:end].sum()
            assert total <= budget or (begin, end) == (start, start + 1)
            assert end == len(tokens) or total + tokens[end] > budget
            assert tokens[begin:start].sum() <= budget // 4
            at = end
        assert at == len(tokens)


def conversations(seed, n=40, most=30):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        turns = rng.randint(1, most)
        for turn in range(turns):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool", None, "system"])
            text = rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(rng.randint(1, 30))), "word " * rng.randint(1, 60)])
            rows.append((conv, turn * 3, role, text, 1, "x"))
    rows += [(900, None, "user", "no turn", 1, ""), (900, 1, "assistant", "after", 1, ""), (901, 5, "assistant", "twice", 1, ""),
             (901, 5, "assistant", "twice", 1, ""), (902, 0, "system", "alone", 1, ""), (903, 0, "assistant", "long " * 4000, 1, "")]
    rng.shuffle(rows)
    return rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        out[conv] = [(role, text) for *_, role, text in turns]
    return out


@pytest.mark.parametrize("seed, budget, history, chunk", [(1, 60, 2, 4 << 20), (2, 60, 2, 700), (3, 200, 0, 1500), (4, 5, 3, 300)])
def test_windows_hold_every_turn_once(spark, seed, budget, history, chunk):
    rows = conversations(seed)
    made = cw.windows(spark.createDataFrame(rows, SCHEMA).repartition(3), budget, history, chunk_bytes=chunk)
    if chunk < 4 << 20:
        assert made.where("long").count() > 10
    want = expected(rows)
    seen = {conv: [] for conv in want}
    for w in sorted(made.collect(), key=lambda w: (w.chunk, w.window)):
        turns = cw.parse(w.text)
        mine, whole = seen[w.conv_id], want[w.conv_id]
        assert len(turns) == w.n_system + w.n_history + w.n_turns and w.n_turns > 0
        assert w.n_system == int(bool(mine) and whole[0][0] == "system")
        assert turns[:w.n_system] == whole[:w.n_system]
        assert w.n_history <= history
        assert turns[w.n_system:w.n_system + w.n_history] == mine[len(mine) - w.n_history:]
        fresh = turns[w.n_system + w.n_history:]
        assert [cw.unescape(w.text[s.start:s.end]) for s in w.loss] == [t for r, t in fresh if r == "assistant"]
        assert w.n_tokens == len(TOKENIZER.encode(w.text, add_special_tokens=False).ids)
        assert w.n_tokens <= budget or w.n_turns == 1 or (w.n_turns == 2 and not mine and whole[0][0] == "system")
        mine += fresh
    assert seen == want


@pytest.mark.parametrize("chunk", [4 << 20, 700])
def test_read_back_digests(spark, chunk):
    rows = conversations(7)
    made = cw.windows(spark.createDataFrame(rows, SCHEMA), 60, 2, chunk_bytes=chunk)
    sizes = {r[0]: r[1] for r in made.groupBy("conv_id").agg(F.sum(F.length("text"))).collect()}
    got = {r.conv_id: r for r in cw.read_back(made).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        target = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(target), sizes[conv])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(target.encode()).hexdigest()


def test_empty_table(spark):
    made = cw.windows(spark.createDataFrame([], SCHEMA))
    assert made.count() == 0 and cw.read_back(made).count() == 0


def test_one_long_conversation_is_many_tasks_work(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn number {i}", 0, "") for i in range(3000)]
    made = cw.windows(spark.createDataFrame(rows, SCHEMA), 100, 2, chunk_bytes=8000)
    per_chunk = made.groupBy("chunk").agg(F.sum("n_turns")).collect()
    assert len(per_chunk) >= 20 and max(r[1] for r in per_chunk) < 200
    assert made.agg(F.sum("n_turns")).first()[0] == 3000


def test_query_adds_the_quoting_conversation(spark, tmp_path):
    rows = [(3, 0, "user", "hi"), (3, 1, "assistant", "[INST] yes")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_chat_windows(spark, str(tmp_path)).collect()}
    quote = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{quote}\nassistant\n{quote}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(quote.encode()).hexdigest()
    assert got[3].loss_chars == len("[INST] yes") and len(got) == 2
