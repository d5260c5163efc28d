"""Alignment of two tokenizers against token ranges laid out one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sentrank.llm import alignment, queries

from .conftest import rows_of

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
# The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def entry_bytes(i):
    return bytes(BYTE_OF[c] for c in A.id_to_token(i))


def piece_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def laid_out(ids, spell):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spell(i)), i))
        at = out[-1][1]
    return out


def brute(rows):
    links, shown = [], []
    for _, text in rows:
        a = laid_out(A.encode(" " + (text or ""), add_special_tokens=False).ids, entry_bytes)
        b = laid_out(B.encode(text or ""), piece_bytes)
        spelled = [b"".join(f(i) for *_, i in x) for x, f in ((a, entry_bytes), (b, piece_bytes))]
        if not text or any(s != (" " + text).encode() for s in spelled):
            a = b = []
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(i) for _, e, i in a if low < e <= end) + "|" + ",".join(
                str(i) for _, e, i in b if low < e <= end))
            low = end
        links.append([(i, j) for s, e, i in a for t, f, j in b if s < f and t < e])
        shown.append((len(a), len(b), ";".join(groups), len(groups)))
    held = Counter(p for doc in links for p in set(doc))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(doc, n_a, n_b, n_groups, len(mine), sum(held[p] == best[p[0]] for p in mine), sum(held[p] for p in mine), groups)
            for (doc, _), (n_a, n_b, groups, n_groups), mine in zip(rows, shown, links, strict=True)]


ODD = ["", None, " ", "  a  b ", "▁x", "a▁", "<s>a</s><unk><0x0A>", "<|endoftext|> x", "é́ É日本😀\n\n\tx\r\n", "\x00a\x01", "'s 'll don't",
       "   " * 40, "x" * 700, "12345 67,89", " 　a", "\x85 \x1c", "a b c d e f g " * 30, "�", "ﬁ ½ ²"]


def cases(seed):
    rng = random.Random(seed)
    words = ["the", " of", "tion", "é", " ", "  ", "\n", "ing", "'s", "日", "12", ".", "house", "<s>", "😀", " a"]
    rows = list(enumerate(ODD))
    rows += [(100 + i, "".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    return rows + [(None, "the house"), (None, "the house"), (7000, "the house of the house")]


@pytest.mark.parametrize("broadcast", [0, 10**6])
@pytest.mark.parametrize("block_docs, parts", [(4096, 1), (7, 3)])
def test_alignment_matches_brute_force(docs, monkeypatch, broadcast, block_docs, parts):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(alignment.tb, "SLICE_BYTES", 900)
    rows = cases(block_docs)
    got = alignment.align(docs(rows, parts), broadcast_pairs=broadcast)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert rows_of(got, *columns) == sorted(brute(rows), key=repr)


def test_counts_and_multiplicity_planes(docs):
    rows = cases(3)
    counts = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(alignment.postings(docs(rows, 2))).collect()}
    mine = Counter()
    held = Counter()
    for _, text in rows:
        row = [(0, text)]
        if not brute(row)[0][1]:
            continue
        a = laid_out(A.encode(" " + text, add_special_tokens=False).ids, entry_bytes)
        b = laid_out(B.encode(text), piece_bytes)
        links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
        mine.update(links)
        held.update(set(links))
    assert counts == {p: (held[p], n) for p, n in mine.items()}


def test_planes_of_a_block():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 40, 4000) << 12 | rng.integers(0, 300, 4000))
    keys = np.concatenate([keys, np.arange(9) + (77 << 12)])
    times = rng.integers(1, 40, len(keys))
    times[-9:] = 1 << np.arange(9)
    sums = Counter()
    for pairs, plane, sizes, data, lengths in alignment.bitmaps(keys, times, 300):
        ends = np.cumsum(lengths)
        bits = [data[e - n:e] for e, n in zip(ends, lengths, strict=True)]
        rows, found = alignment.set_places(sizes, bits)
        for r, d in zip(rows.tolist(), found.tolist(), strict=True):
            sums[int(pairs[r]) << 12 | d] += 1 << max(0, plane - 1)
    assert sums == Counter(dict(zip(keys.tolist(), times.tolist(), strict=True)))


def test_long_texts_are_cut_where_no_token_spans(monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    rng = random.Random(2)
    text = "".join(rng.choice(["the", "house", "é", " ", " ", "  ", "\n", "'s", ".", "日本"]) for _ in range(5000))
    parts = alignment.parts_of(text)
    assert len(parts) > 50 and " ".join(parts) == text
    a, b = alignment.tokenizers(alignment.default_paths())
    assert np.concatenate(a.encode(parts)).tolist() == A.encode(" " + text, add_special_tokens=False).ids
    assert np.concatenate(b.encode(parts)).tolist() == B.encode(text)


def test_odd_tables(docs, spark):
    assert alignment.align(docs([])).count() == 0
    only = alignment.align(docs([(1, None), (None, "")])).select("n_a", "n_links", "count_sum", "groups")
    assert [tuple(r) for r in only.collect()] == [(0, 0, 0, "")] * 2
    clash = spark.createDataFrame([(1, "the house", 5, "x", 2)], "doc_id bigint, text string, block int, pair string, n_best int")
    got = alignment.align(clash)
    assert got.columns == ["doc_id", "text", "block", "pair", *alignment.RESULT]
    assert got.first()["block"] == 5 and got.first()["n_links"] > 0


def test_long_blank_runs_and_letters(docs):
    rows = [(1, " " * 50_000), (2, "x" * 50_000), (3, "\n" * 20_000 + "a")]
    got = {r.doc_id: r for r in alignment.align(docs(rows)).collect()}
    assert all(got[i].n_a > 0 and got[i].n_links >= got[i].n_a for i in (1, 2, 3))
    assert got[2].n_b == len(B.encode("x" * 50_000))


def test_query_digests_groups(spark, tmp_path):
    rows = cases(5)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_tokenizer_alignment(spark, str(tmp_path))
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)]
    assert rows_of(got, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == sorted(want, key=repr)
