"""Token ids of whole texts from a word-level cache in front of a public tokenizer."""

import os

import numpy as np
import pyarrow as pa

from . import textbytes as tb

_ALNUM = tb.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARKS = tb.byte_class(set(range(0x21, 0x7F)) - set(np.flatnonzero(_ALNUM).tolist()))
_LETTERS = tb.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
MOST_WORDS = 1 << 20


class WordEncoder:
    """Ids by a tokenizer that lower-cases and drops white space, so words between blanks are encoded on their own.

    A text is cut at ASCII blanks, and a word's closing ASCII punctuation from the letter or digit before it; both are
    borders of the tokenizer too. Parts are looked up by a 64-bit hash of their lower-cased bytes; new ones go through
    the tokenizer once. At ``most`` words the cache starts anew. Texts in which a special token could be written out
    go through the tokenizer whole.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.most = most
        vocabulary = self.tokenizer.get_vocab(True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self):
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _encode(self, words: list[str]) -> list:
        """Ids of each word; words of letters only are joined, as each ends with a closing id."""
        if len(words) > 1 and all(w.isascii() and w.isalpha() for w in words):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return np.split(ids, ends[:-1])
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray):
        if len(self.keys) + len(keys) > self.most:
            self._empty()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids: list = [None] * len(texts)
        for group in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for at in range(0, len(group), 1000):
                some = group[at:at + 1000]
                for i, got in zip(some.tolist(), self._encode([texts[i] for i in some.tolist()]), strict=True):
                    ids[i] = got
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, *ids]).astype(np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.length = (
            np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.length, at, length))

    def parts(self, data: np.ndarray, offsets: np.ndarray):
        """Starts and ends of the parts and the first part of each document."""
        starts, ends, _ = tb.tokens(data, offsets, tb.NOT_BLANK)
        if not len(starts):
            return starts, ends, np.zeros(len(offsets), np.int64)
        at = np.arange(len(data))
        core = np.maximum.accumulate(np.where(_MARKS[data], -1, at))[ends - 1]
        split = (core >= starts) & (core + 1 < ends) & _ALNUM[data[np.maximum(core, 0)]]
        cuts = core[split] + 1
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return starts, ends, np.searchsorted(starts, offsets)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Place in the pool and number of ids of each part."""
        low = tb.LOWER[data]
        hashes = tb.token_hashes(low, starts, ends)
        keys, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                known[:] = False
            new = lead[~known]
            plain = np.diff(np.concatenate([[0], np.cumsum(_LETTERS[data])])[np.stack([starts[new], ends[new]], 1)],
                            axis=1).ravel() == ends[new] - starts[new]
            self._learn(keys[~known], data.tobytes(), starts[new], ends[new], plain)
            slot = np.searchsorted(self.keys, keys)
        return self.first[slot][which], self.length[slot][which]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of documents, and where each document's begin."""
        starts, ends, doc_first = self.parts(data, offsets)
        if len(starts):
            first, length = self.lookup(data, starts, ends)
        else:
            first = length = np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(first - total[:-1], length) + np.arange(total[-1])] if total[-1] \
            else np.empty(0, np.int32)
        bounds = total[doc_first]
        raw = data.tobytes()
        if b"<|" not in raw:
            return ids, bounds
        pieces = []
        for k in range(len(offsets) - 1):
            text = raw[offsets[k]:offsets[k + 1]]
            pieces.append(np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
                          if b"<|" in text else ids[bounds[k]:bounds[k + 1]])
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def count(self, text: bytes) -> int:
        """Number of ids of one text."""
        data = np.frombuffer(text, np.uint8)
        return len(self.encode(data, np.array([0, len(data)], np.int64))[0])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file, so that its cache serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_column(batch: pa.RecordBatch):
    return batch.column(batch.schema.get_field_index("text"))
