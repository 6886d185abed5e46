"""Language identification by segmentation-marginalised unigram models.

Each language is a unigram distribution over the pieces of a fixed public
vocabulary (word starts marked).  A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product
over its words.  The distributions come from expectation-maximisation: first
rounds over the word counts of a bounded sample of labelled rows, the last over
those of all labelled texts.  Spark counts the words and, each round, sums the
expected counts of pieces, so only those reach the driver.

All languages and many words go through the same numpy recursion; a worker keeps
the scores of words it has seen.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .op4_toxicity import held_out
from .session import bounded_batches, checkpoint

#: Rounds of expectation-maximisation; all but the last on about ``SAMPLE`` labelled rows, chosen by hash.
ROUNDS, SAMPLE = 3, 4000
SMOOTH = 0.05
CACHE = 600_000
MARK = "▁"
#: Runs of letters and of numbers that are no digits, such as ½ and ².
_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[str, ...]:
    """Lower-case letter pieces of a vocabulary in order; single marks and letters included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return tuple(sorted(p for p in out if p and (p == MARK or p.lstrip(MARK).isalpha() and MARK not in p[1:])))


def words_of(text: str | None) -> list[str]:
    """The maximal runs of letters of a text, in lower case."""
    found = _WORDS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


#: Letters of a batch of words, padded.
GRID = 65_536


def batches_of(words: list[str]):
    """Places of words in batches of like length, within a bounded grid."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(words[order[end]]) <= GRID:
            end += 1
        yield order[at:end]
        at = end


#: Bits of a hash that name a slot.
SLOT_BITS = 20


def slots_of(hashes: np.ndarray) -> np.ndarray:
    """Places of ordered hashes by their first bits: -1 for a free slot, -2 where several hashes share one."""
    first = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    out = np.full(1 << SLOT_BITS, -1, np.int32)
    out[first] = np.arange(len(hashes))
    out[np.flatnonzero(np.bincount(first, minlength=1) > 1)] = -2
    return out


class Lattice:
    """The pieces at every span of a batch of marked words.

    Alphas and betas are rescaled as they shrink, with the logarithm of the
    scale kept for each word and language, so words may be of any length.
    """

    def __init__(self, words: list[str], hashes: np.ndarray, numbers: np.ndarray, longest: int = 16, slots: np.ndarray | None = None):
        self.n, self.width = len(words), max(map(len, words), default=0)
        self.lengths = np.array([len(w) for w in words])
        self.hashes, self.numbers, self.longest = hashes, numbers, longest
        flat = np.frombuffer("".join(w.ljust(self.width + 1, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = flat.reshape(self.n, self.width + 1).astype(np.uint64)
        self.total = np.zeros((self.width + 1, self.n), np.uint64)
        for j in range(self.width):
            self.total[j + 1] = self.total[j] * _BASE + H.mix(codes[:, j] + np.uint64(1))
        self.slots, self.seen = slots_of(hashes) if slots is None else slots, {}
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(longest + 1)], np.uint64)

    def _numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of spans (length - 1, word): unknown single characters are the last number, other unknown spans -1."""
        k = self.slots[h >> np.uint64(64 - SLOT_BITS)]
        out = np.where(self.hashes[k] == h, self.numbers[k], -1)  # a free slot's -1 is the last piece, which h then isn't
        several = np.nonzero(k == -2)
        if len(several[0]):
            k = np.searchsorted(self.hashes, h[several])
            k[k == len(self.hashes)] = 0
            out[several] = np.where(self.hashes[k] == h[several], self.numbers[k], -1)
        out[0][out[0] < 0] = len(self.hashes)
        return out

    def ending(self, j: int) -> np.ndarray:
        if j not in self.seen:
            most = min(self.longest, j)
            self.seen[j] = self._numbers(self.total[j] - self.total[j - most : j][::-1] * self.powers[1 : most + 1, None])
        return self.seen[j]

    def starting(self, i: int) -> np.ndarray:
        return np.stack([self.ending(i + n)[n - 1] for n in range(1, min(self.longest, self.width - i) + 1)])

    def _rescaled(self, window: np.ndarray, scale: np.ndarray, now: np.ndarray) -> None:
        top = window.max(0)
        top[top == 0] = 1
        window /= top
        scale += np.log(top)
        now += np.log(top)

    def forward(self, of, width: int):
        """alpha[place, word, column] and its log scales; ``of`` gives the probabilities of pieces, a column per language."""
        shape = (self.width + 1, self.n, width)
        alpha, scale, now = np.zeros(shape), np.zeros(shape), np.zeros(shape[1:])
        alpha[0] = 1
        for j in range(1, self.width + 1):
            ids = self.ending(j)
            alpha[j] = np.einsum("knl,knl->nl", alpha[j - len(ids) : j][::-1], of(ids))
            scale[j] = now
            if j % 8 == 0:
                low = max(0, j - self.longest)
                self._rescaled(alpha[low : j + 1], scale[low : j + 1], now)
        return alpha, scale

    def score(self, probability: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``probability`` has a row of zeros at -1."""
        alpha, scale = self.forward(probability.__getitem__, probability.shape[1])
        at = self.lengths, np.arange(self.n)
        return np.log(alpha[at]) + scale[at]

    def expected(self, probability: np.ndarray, counts: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Expected piece counts by language, for words of one language each and their counts."""
        of = lambda ids: probability[ids, langs][:, :, None]
        alpha, scale = self.forward(of, 1)
        at = self.lengths, np.arange(self.n)
        whole = np.log(alpha[at]) + scale[at]
        beta, back, now = np.zeros_like(alpha), np.zeros_like(scale), np.zeros_like(whole)
        beta[at] = 1
        n_langs = probability.shape[1]
        out = np.zeros((len(probability) - 1) * n_langs)
        for i in range(self.width - 1, -1, -1):
            ids = self.starting(i)
            after = slice(i + 1, i + 1 + len(ids))
            step = of(ids) * beta[after]
            beta[i] += step.sum(0)
            back[i] = now
            got = (alpha[i] * step * np.exp(np.minimum(scale[i] + back[after] - whole, 600)))[:, :, 0] * counts
            some = got > 0
            out += np.bincount((ids * n_langs + langs)[some], got[some], len(out))
            if i % 8 == 0:
                self._rescaled(beta[i : i + self.longest], back[i : i + self.longest], now)
        return out.reshape(-1, n_langs)


def _keys(vocabulary: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of pieces in order, and their numbers."""
    out = np.zeros(len(vocabulary), np.uint64)
    for k, p in enumerate(vocabulary):
        h = np.zeros(1, np.uint64)
        for c in p:
            h = h * _BASE + H.mix(np.array([ord(c) + 1], np.uint64))
        out[k] = h[0]
    order = np.argsort(out)
    return out[order], order


class _Scores:
    """Scores of the words that a worker has seen, for one model; tasks of a worker share them."""

    def __init__(self, width: int):
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, width))

    def add(self, words: list[str], scores: np.ndarray) -> None:
        start, end = len(self.known), len(self.known) + len(words)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[start:end] = scores
        self.known.update(zip(words, range(start, end)))


_SEEN: dict[int, _Scores] = {}


class Model:
    def __init__(self, langs: list[str], vocabulary: tuple[str, ...], probability: np.ndarray):
        self.langs, self.probability = langs, probability  # a row per piece, one for unknown characters, one of zeros
        self.hashes, self.numbers = _keys(vocabulary)
        self.longest, self.slots = max(map(len, vocabulary), default=1), slots_of(self.hashes)

    def __getstate__(self):
        return {"langs": self.langs, "probability": self.probability, "hashes": self.hashes, "numbers": self.numbers, "longest": self.longest, "slots": None}

    def seen(self) -> _Scores:
        """The worker's scores for this model; those of another one go."""
        key = zlib.crc32(self.probability.tobytes())
        if key not in _SEEN:
            _SEEN.clear()
            _SEEN[key] = _Scores(len(self.langs))
        return _SEEN[key]

    def lattice(self, words: list[str]) -> Lattice:
        if self.slots is None:  # it is made again in each worker rather than sent
            self.slots = slots_of(self.hashes)
        return Lattice(words, self.hashes, self.numbers, self.longest, self.slots)

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        marked = [MARK + w for w in words]
        for own in batches_of(marked):
            out[own] = self.lattice([marked[k] for k in own]).score(self.probability)
        return out

    def text_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of texts and their numbers of words."""
        words = [words_of(t) for t in texts]
        seen = self.seen()
        every = {w for ws in words for w in ws}
        if len(seen.known) + len(every) > CACHE:
            seen.__init__(len(self.langs))
        new = list(every.difference(seen.known))
        if new:
            seen.add(new, self.word_scores(new))
        get = seen.known.__getitem__
        count = np.array([len(ws) for ws in words])
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(count)
        if len(some):
            at = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(count.sum()))
            out[some] = np.add.reduceat(seen.table[at], np.r_[0, np.cumsum(count[some])[:-1]])
        return out, count


def _count_words(batches):
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)


def _expect(model: Model):
    """Expected piece counts of a partition's words: a row for each piece that any has."""

    def expect(batches):
        column = {x: k for k, x in enumerate(model.langs)}
        got = np.zeros((len(model.probability) - 1, len(model.langs)))
        for batch in batches:
            marked = [MARK + w for w in batch.column("word").to_pylist()]
            langs, counts = np.array([column[x] for x in batch.column("lang").to_pylist()]), batch.column("n").to_numpy()
            for own in batches_of(marked):
                got += model.lattice([marked[k] for k in own]).expected(model.probability, counts[own], langs[own])
        some = np.flatnonzero(got.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, got.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(got.shape[1], dtype=np.int32), len(some))), pa.array(got[some].ravel())], ["piece", "lang", "n"])

    return expect


def fit(labelled: DataFrame, vocabulary: str, sample: int = SAMPLE) -> Model:
    """A model from rows ``_k_id, _k_text, lang``."""
    langs = [r["lang"] for r in labelled.select("lang").distinct().orderBy("lang").collect()]
    vocab = pieces(vocabulary)
    probability = np.zeros((len(vocab) + 2, len(langs)))
    model = Model(langs, vocab, probability)
    if not langs:
        return model
    probability[:-1] = 1 / (len(vocab) + 1)
    probability[-2] = 1e-6

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select("lang", "_k_text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))

    def again(words: DataFrame) -> None:
        got = np.full((len(vocab) + 1, len(langs)), SMOOTH)
        for r in words.mapInArrow(_expect(model), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():  # a row per piece and language
            got[r["piece"], r["lang"]] += r["n"]
        probability[:-1] = got / got.sum(0)

    # the first rounds find their way on a sample of rows, the last one counts all labelled texts
    if ROUNDS > 1:
        share = min(1.0, sample / max(1, labelled.count()))
        some = labelled if share == 1 else labelled.where(F.pmod(F.xxhash64("_k_id", "_k_text"), F.lit(1 << 30)) < int(share * (1 << 30)))
        some = checkpoint(counted(some))
        for _ in range(ROUNDS - 1):
            again(some)
    again(counted(labelled))
    return model


def _predict(model: Model):
    def predict(batches):
        for batch in batches:
            texts = batch.column("_k_text")
            preds, scores = [], []
            for a in range(0, batch.num_rows, 500):
                part = texts.slice(a, 500).to_pylist()
                if not model.langs:
                    preds += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                logs, count = model.text_scores(part)
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1)[:, None]).sum(1)
                preds += [model.langs[k] if n else "und" for k, n in zip(best.tolist(), count.tolist())]
                scores += np.where(count > 0, share, 0.0).tolist()
            names = [n for n in batch.schema.names if n != "_k_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``_k_id, held_out, lang_pred, score`` for every row of ``docs``.

    Learns from rows that are not held out and whose language is not null;
    predictions see the text alone.  ``score`` is the share of the predicted
    language in the texts' probabilities under all languages.  Texts that are
    null or have no letter are ``und`` with score 0, as are all without any
    labelled row; ties go to the first language in order.  Texts are read whole
    whatever their length; repeated rows are learnt from and scored each; a null
    id is never held out; an empty table gives no rows; other columns are not
    read, so that their names don't matter.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("_k_id"), F.col(f"`{text_col}`").alias("_k_text"), F.col(f"`{lang_col}`").alias("lang"))
    out = held_out("_k_id", 4, 2)
    model = fit(own.where(~out & F.col("lang").isNotNull() & F.col("_k_text").isNotNull()), vocabulary)
    own = own.select("_k_id", "_k_text")
    scored = own.mapInArrow(_predict(model), own.drop("_k_text").schema.add("lang_pred", "string").add("score", "double"))
    return scored.withColumn("held_out", held_out("_k_id", 4, 2)).select("_k_id", "held_out", "lang_pred", "score")
