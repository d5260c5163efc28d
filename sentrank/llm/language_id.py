"""Language identification by unigram pieces, summed over all segmentations of a word."""

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import map_batches, settle

#: Words of up to so many bytes are summed as plain probabilities, which cannot vanish there; longer ones as logarithms.
PLAIN_BYTES = 16
#: Bytes after which a run of letters is cut, at a character's start, when words are counted to fit a model.
FIT_BYTES = 256
MOST_WORDS = 1 << 20
_LETTERS = tb.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_SLOTS = 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def word_pieces(path: str) -> list[bytes]:
    """The vocabulary's byte strings that can occur in a lower-cased word with the blank before it."""
    table = bytes(range(256))
    inner = bytes(b for b in table if b >= 0x80 or 0x61 <= b <= 0x7A)
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines]
    keep = {p for p in pieces if not p.removeprefix(b" ").strip(inner)}
    return sorted(keep | {bytes([b]) for b in inner} | {b" "})


class Lattice:
    """All pieces of a vocabulary at all places of a set of words."""

    def __init__(self, pieces: list[bytes]):
        data, offsets = tb.flat(pa.array(pieces, pa.binary()))
        self.longest = int(np.diff(offsets).max())
        hashes = tb.token_hashes(data, offsets[:-1], offsets[1:])
        place = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        # One column for each piece of a crowded slot.
        self.ids = np.full((int(nth.max()) + 1, 1 << _SLOTS), -1, np.int32)
        self.ids[nth, place[order]] = order
        self.hashes = hashes
        self.sizes = np.diff(offsets)

    def edges(self, data: np.ndarray, first: np.ndarray, size: np.ndarray):
        """Word, start, end and piece of every piece in every word, in order of the end."""
        sums = tb.prefix_sums(tb.BYTE_CODES[data])
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(data))
        room = np.repeat(first + size, size) - at
        out = []
        for length in np.unique(self.sizes).tolist():
            start = np.flatnonzero(room >= length)
            if not len(start):
                break
            h = tb.stretch_hashes(sums, start, start + length)
            slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
            for column in self.ids:
                piece = column[slot]
                hit = piece >= 0
                hit[hit] = (self.hashes[piece[hit]] == h[hit]) & (self.sizes[piece[hit]] == length)
                s = start[hit]
                out.append((of[s], s - first[of[s]], s - first[of[s]] + length, piece[hit]))
        word, start, end, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((word, end))
        return word[order], start[order], end[order], piece[order]

    @staticmethod
    def _steps(end: np.ndarray):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1, [len(end)]])
        return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(end) else []

    def forward(self, edges, n_words: int, longest: int, chances: np.ndarray) -> np.ndarray:
        """Sum over all segmentations of the first j bytes of each word, for each language (last axis)."""
        word, start, end, piece = edges
        alpha = np.zeros((n_words, longest + 1, chances.shape[1]))
        alpha[:, 0] = 1
        for a, b in self._steps(end):
            w = word[a:b]
            heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            alpha[w[heads], end[a]] = np.add.reduceat(alpha[w, start[a:b]] * chances[piece[a:b]], heads)
        return alpha

    @staticmethod
    def _log_step(w: np.ndarray, terms: np.ndarray):
        """The words of one step and the logarithms of their sums of terms; rows of a word lie together."""
        heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        top = np.maximum.reduceat(terms, heads)
        each = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(w))))
        return w[heads], top + np.log(np.add.reduceat(np.exp(terms - top[each]), heads))

    def log_totals(self, edges, size: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all segmentations of each word, of any length.

        Only the sums of the last places that a piece can reach are kept, in a ring.
        """
        word, start, end, piece = edges
        width = self.longest + 1
        ring = np.full((len(size), width, logs.shape[1]), -np.inf)
        ring[:, 0] = 0
        out = np.zeros((len(size), logs.shape[1]))
        for a, b in self._steps(end):
            w, value = self._log_step(word[a:b], ring[word[a:b], start[a:b] % width] + logs[piece[a:b]])
            ring[w, end[a] % width] = value
            last = size[w] == end[a]
            out[w[last]] = value[last]
        return out

    def expected(self, data, first, size, weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece for each language, words counting ``weights`` times."""
        word, start, end, piece = self.edges(data, first, size)
        logs = np.log(chances)
        alpha = np.full((len(size), int(size.max()) + 1, chances.shape[1]), -np.inf)
        beta = np.full_like(alpha, -np.inf)
        alpha[:, 0] = 0
        beta[np.arange(len(size)), size] = 0
        for a, b in self._steps(end):
            w, value = self._log_step(word[a:b], alpha[word[a:b], start[a:b]] + logs[piece[a:b]])
            alpha[w, end[a]] = value
        total = alpha[np.arange(len(size)), size]
        out = np.zeros_like(chances)
        back = np.lexsort((word, -start))
        word, start, end, piece = word[back], start[back], end[back], piece[back]
        for a, b in self._steps(start):
            w, value = self._log_step(word[a:b], beta[word[a:b], end[a:b]] + logs[piece[a:b]])
            beta[w, start[a]] = value
        for a in range(0, len(word), 1 << 18):
            w, p = word[a:a + (1 << 18)], piece[a:a + (1 << 18)]
            use = np.exp(alpha[w, start[a:a + (1 << 18)]] + logs[p] + beta[w, end[a:a + (1 << 18)]] - total[w]) * weights[w]
            np.add.at(out, p, use)
        return out

    def scores(self, data, first, size, chances: np.ndarray) -> np.ndarray:
        """Log-probability of each word for each language."""
        edges = self.edges(data, first, size)
        if int(size.max()) > PLAIN_BYTES:
            return self.log_totals(edges, size, np.log(chances))
        alpha = self.forward(edges, len(size), int(size.max()), chances)
        return np.log(alpha[np.arange(len(size)), size])


def batches_of(size: np.ndarray, langs: int, whole: bool = False):
    """Groups of words of like length whose sums take some 64 MB; plain words and longer ones apart."""
    order = np.argsort(size, kind="stable")
    cut, at = int(np.searchsorted(size[order], PLAIN_BYTES, "right")), 0
    while at < len(order):
        stop = cut if at < cut else len(order)
        places = int(size[order[stop - 1]]) + 1 if whole or at < cut else 64
        step = max(1, (8 << 20) // (places * langs))
        yield order[at:min(stop, at + step)]
        at = min(stop, at + step)


def letter_runs(data: np.ndarray, offsets: np.ndarray, most: int | None = None):
    """Lower-cased bytes, starts and ends of words and the first word of each document.

    With ``most``, longer words are cut into parts of that many bytes, less what belongs to a character begun before.
    """
    low = tb.LOWER[data]
    starts, ends, _ = tb.tokens(low, offsets, _LETTERS)
    long_ = np.flatnonzero(ends - starts > most) if most else ()
    if len(long_):
        cuts = []
        for i in long_:
            at = np.arange(starts[i] + most, ends[i], most)
            for _ in range(3):
                at = at - ((low[at] & 0xC0) == 0x80)
            cuts.append(at[at > starts[i]])
        cuts = np.unique(np.concatenate(cuts))
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return low, starts, ends, np.searchsorted(starts, offsets)


def with_blank(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words in a row, each behind a blank; first byte and size of each."""
    size = ends - starts + 1
    first = np.cumsum(size) - size
    at = np.repeat(starts - first - 1, size) + np.arange(size.sum())
    data = low[np.maximum(at, 0)]
    data[first] = 0x20
    return data, first, size


def _sample(docs: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language, chosen by a hash of the row."""
    steps = 1 << 30
    below = docs.sparkSession.createDataFrame(
        [(k, min(steps, per_language * steps // n)) for k, n in counts.items()], "lang string, __below bigint")
    return docs.join(F.broadcast(below), "lang").where(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < F.col("__below")).select("lang", "text")


def _word_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of each word in each language."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = tb.flat(batch.column(1))
            for i, j in tb.slices(offsets):
                part, ends = tb.cut(data, offsets, i, j)
                low, a, b, first = letter_runs(part, ends, FIT_BYTES)
                hashes = tb.token_hashes(low, a, b)
                lang = np.repeat(langs[i:j], np.diff(first))
                for name in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == name)
                    _, lead, n = np.unique(hashes[mine], return_index=True, return_counts=True)
                    words = [low[a[k]:b[k]].tobytes() for k in mine[lead].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.binary()),
                                                      pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Probabilities of the pieces (rows) in each language (columns)."""

    def __init__(self, langs: list[str], pieces: list[bytes], chances: np.ndarray):
        self.langs, self.pieces, self.chances = langs, pieces, chances
        self.key = uuid.uuid4().hex


def fit(docs: DataFrame, path: str | None = None, per_language: int = 1000, rounds: int = 3, prior: float = 0.05) -> Model:
    """Piece probabilities of each language in ``docs`` (doc_id, text, lang) by expectation maximisation.

    The vocabulary is fixed: the pieces of the public file at ``path`` that can occur in a word. The model is fitted on
    parts of words of at most ``FIT_BYTES`` bytes in a bounded sample of about ``per_language`` documents of each language; their words are counted once, and
    each round sums the expected uses of every piece over all segmentations, in tasks over the distinct words. What
    comes to the driver is the model, which is bounded by the vocabulary times the number of languages. Rows
    without lang or text do not count; without any row the model knows no language.
    """
    pieces = word_pieces(path or default_path())
    counts = docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if langs:
        words = settle(_word_counts(_sample(docs, {r["lang"]: r["count"] for r in counts}, per_language)), "words")
    model = Model(langs, pieces, np.full((len(pieces), max(1, len(langs))), 1 / len(pieces)))
    context = docs.sparkSession.sparkContext
    for _ in range(rounds if langs else 0):
        sent = context.broadcast(model)

        def run(batches):
            lattice = Lattice(sent.value.pieces)
            total = np.zeros_like(sent.value.chances)
            columns = {name: k for k, name in enumerate(sent.value.langs)}
            for batch in batches:
                lang = np.array([columns[x] for x in batch.column(0).to_pylist()], np.int64)
                data, offsets = tb.flat(batch.column(1))
                count = batch.column(2).to_numpy()
                for some in batches_of(np.diff(offsets), total.shape[1], whole=True):
                    weights = np.zeros((len(some), total.shape[1]))
                    weights[np.arange(len(some)), lang[some]] = count[some]
                    row, first, size = with_blank(data, offsets[some], offsets[some + 1])
                    total += lattice.expected(row, first, size, weights, sent.value.chances)
            at = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].tolist(), pa.list_(pa.float64()))],
                                             names=["piece", "uses"])

        sums = words.mapInArrow(run, "piece bigint, uses array<double>").select(
            "piece", F.posexplode("uses").alias("lang", "n")).groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        uses = np.full(model.chances.shape, prior)
        for r in sums.collect():
            uses[r.piece, r.lang] += r.n
        model = Model(langs, pieces, uses / uses.sum(0))
        sent.unpersist()
    return model


class Scorer:
    """Scores words once per process; at ``MOST_WORDS`` words the cache starts anew."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self._empty()

    def _empty(self):
        self.keys, self.rows = np.empty(0, np.uint64), np.empty((0, self.model.chances.shape[1]))

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-probability of each document's words for each language."""
        low, a, b, first = letter_runs(data, offsets)
        out = np.zeros((len(offsets) - 1, self.rows.shape[1]))
        if not len(a):
            return out
        keys, lead, which = np.unique(tb.token_hashes(low, a, b), return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + int(new.sum()) > MOST_WORDS:
            self._empty()
            new[:] = True
        found, fresh = keys[new], lead[new]
        if len(found):
            rows = np.empty((len(found), self.rows.shape[1]))
            for some in batches_of((b - a)[fresh] + 1, rows.shape[1]):
                rows[some] = self.lattice.scores(*with_blank(low, a[fresh[some]], b[fresh[some]]), self.model.chances)
            at = np.searchsorted(self.keys, found)
            self.keys, self.rows = np.insert(self.keys, at, found), np.insert(self.rows, at, rows, axis=0)
        value = self.rows[np.searchsorted(self.keys, keys)][which]
        full = np.flatnonzero(np.diff(first) > 0)
        out[full] = np.add.reduceat(value, first[:-1][full])
        return out


_SCORERS: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """One scorer per worker process for the model at hand, so that its cache serves later tasks."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, ...) with ``lang_pred`` and ``score``; columns with these names are replaced.

    A text's words are its runs of letters (ASCII letters and all bytes beyond ASCII), lower-cased in A-Z, each with a
    blank before it. A word's probability in a language is the sum over all its segmentations into pieces, however
    long it is, a text's the product over its words. ``score`` is the probability of the best language
    if all are equally likely beforehand; at ties the first in order of name. A text that is null or has no letter, or
    a model without languages, gives ``und`` with score 0. Every row is scored, repeated ones too; doc_id, lang and
    source are not read.
    """
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")],
                       F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("__letters"))
    schema = keep.limit(0).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = scorer_of(sent.value)
        for batch in batches:
            data, offsets = tb.flat(batch.column(batch.schema.get_field_index("text")))
            letters = batch.column("__letters").to_numpy(zero_copy_only=False)
            logs = [scorer.documents(*tb.cut(data, offsets, i, j)) for i, j in tb.slices(offsets)]
            logs = np.concatenate(logs) if logs else np.empty((0, scorer.rows.shape[1]))
            best = logs.argmax(1) if len(logs) else np.empty(0, np.int64)
            top = 1 / np.exp(np.maximum(logs - logs.max(1, keepdims=True), -700)).sum(1) if len(logs) else np.empty(0)
            known = letters & bool(scorer.model.langs)
            names = np.array(scorer.model.langs or ["und"], object)[best]
            names[~known] = "und"
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names.tolist(), pa.string()), pa.array(np.where(known, top, 0.0))],
                names=[*batch.schema.names, "lang_pred", "score"])

    return map_batches(keep, run, schema).drop("__letters")


def held_out():
    """Documents that are never learned from: a quarter by the checksum of their number."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "text", "lang")


def accept(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised: it has letters and one language is likelier than all others.

    A null text has no letters. Repeated rows and rows without doc_id are judged like any other; if no row can be learned
    from, none stays.
    """
    model = fit(learnable(docs))
    return predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
