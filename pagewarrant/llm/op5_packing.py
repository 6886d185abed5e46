"""Packing documents into fixed-length training sequences, shortest pack first.

1. Tasks tokenize documents and cut them into pieces of at most ``size`` ids.
2. The histogram of piece lengths (``size`` numbers, whatever the corpus) goes
   to the driver.  Lengths are placed longest first; all pieces of a length at
   once go to the packs with the most room left (the shortest), so that a pack
   is a pattern of lengths with a count.
3. Pieces are numbered within their length by salted counts, and a join on
   length and rank gives each its sequence and offset.
"""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bounded_batches, checkpoint, partitions, releasing_batches

SIZE = 2048
END = 1
#: Words whose ids a Python worker keeps.
CACHE = 500_000
#: Punctuation that may follow a word of letters, and white space to Python that is none to the tokenizer.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")


@lru_cache(maxsize=4)
def _tokenizer(path: str, words: bool = False):
    """The tokenizer; for single words, one that reads the special strings as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = words
    return t


class WordIds:
    """Ids of texts, word by word.

    The tokenizer drops white space and never joins words over it, so a text's
    ids are those of its words; each distinct word is encoded once.  A text that
    holds one of the special strings, which have ids of their own, goes to the
    tokenizer as it is.
    """

    def __init__(self, path: str):
        self.tokenizer, self.whole = _tokenizer(path, True), _tokenizer(path)
        self.as_is = (*_CONTROL, *(t.content for t in self.whole.get_added_tokens_decoder().values()))
        self.known: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.word_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def forget(self) -> None:
        """Drop the words seen; a task's texts fill the cache anyway, and the worker goes on to other stages."""
        self.known = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, many to a call: each ends with its one word-ending id."""
        out: list[bytes] = []
        for k in range(0, len(words), 500):
            part = words[k : k + 500]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):
                out += self._encode(part)
                continue
            body, at = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            out += [body[x:y] for x, y in zip(at, at[1:])]
        return out

    def _learn(self, new: set[str], simple: bool) -> None:
        """Ids of new words; in Latin-1 text, a word of letters and a tail of punctuation is those two."""
        known, split, plain = self.known, {}, set()
        for w in new:
            base = w.rstrip(_TAIL) if simple else w
            if not simple or not base or not base.isalpha():
                plain.add(w)
            else:
                split[w] = base
        letters = list({b for b in split.values() if b not in known})
        known.update(zip(letters, self._encode_letters(letters)))
        tails = {w[len(b) :] for w, b in split.items()}
        rest = list(plain.union(tails).difference(known))
        for k in range(0, len(rest), 10_000):
            known.update(zip(rest[k : k + 10_000], self._encode(rest[k : k + 10_000])))
        known.update({w: known[b] + known[w[len(b) :]] if len(w) > len(b) else known[b] for w, b in split.items()})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words: list = []
        seen: dict[bool, set[str]] = {True: set(), False: set()}
        for t in texts:
            if any(c in t for c in self.as_is):
                words.append(None)
                continue
            try:
                t.encode("latin-1")
                simple, own = True, t.lower().split()  # lower case is the tokenizer's own; in Latin-1 it is by character
            except UnicodeEncodeError:
                simple, own = False, t.split()
            words.append(own)
            seen[simple].update(own)
        if len(self.known) + len(seen[True]) + len(seen[False]) > CACHE:
            self.known = {"": b""}
        for simple, ws in seen.items():
            self._learn(ws.difference(self.known), simple)
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) if ws is not None else np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for ws, t in zip(words, texts)]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer for a file, with the words it has seen."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _pieces(path: str, size: int, end: int):
    schema = pa.schema([("_k_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    stop = int(end).to_bytes(4, "little")

    def pieces(batches):
        encode = word_ids(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids), 256):
                rows = []
                for i, body in zip(ids[a : a + 256], encode([t or "" for t in texts.slice(a, 256).to_pylist()])):
                    body += stop
                    n = len(body) // 4
                    rows += [(i, s, min(size, n - s), zlib.crc32(memoryview(body)[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        encode.forget()

    return pieces


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold ``histogram[length]`` pieces of each length."""
    room: dict[int, list] = {}  # room left: [count, lengths] of open patterns
    rooms: list[int] = []  # its keys, ascending
    done: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], left: int) -> None:
        if not left:
            done.append((count, lengths))
        else:
            if left not in room:
                bisect.insort(rooms, left)
                room[left] = []
            room[left].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        n, placed = histogram[length], []
        while n and rooms and rooms[-1] >= length:
            left = rooms[-1]
            count, lengths = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop()
            take = min(n, count)
            if count > take:
                put(count - take, lengths, left)
            placed.append((take, [*lengths, length], left - length))
            n -= take
            if take < count:
                break
            # packs that got one of these may take another only after all others
            if not rooms or rooms[-1] < length:
                for p in placed:
                    put(*p)
                placed = []
        for p in placed:
            put(*p)
        if n:
            per = size // length
            full, rest = divmod(n, per)
            if full:
                put(full, [length] * per, size - per * length)
            if rest:
                put(1, [length] * rest, size - rest * length)
    return done + [p for r in rooms for p in room[r]]


def _places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for each slot of each pattern."""
    used: dict[int, int] = {}
    out, base = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            out.append((length, rank, rank + count, base, offset))
            used[length] = rank + count
            offset += length
        base += count
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: ``_k_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its text and then ``end``; null text is empty, so
    each document has a piece at least.  Pieces are cut every ``size`` ids.
    Offsets of a sequence are gapless from 0 and no sequence is longer than
    ``size``.  Repeated rows are packed each; a null id stays null; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_k_id"), F.col(f"`{text_col}`").alias("_k_text"))
    salts = partitions(spark)
    pieces = checkpoint(own.mapInArrow(releasing_batches(_pieces(tokenizer, size, end)), "_k_id long, start long, length int, ids_crc32 long, doc_tokens long").withColumn("salt", F.pmod(F.xxhash64("_k_id", "start"), F.lit(salts)).cast("int")))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    places = spark.createDataFrame(_places(shortest_pack_first(histogram, size)), "at_length int, first_rank long, end_rank long, base long, offset long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = (
        pieces.withColumn("row", F.row_number().over(Window.partitionBy("length", "salt").orderBy("_k_id", "start", "ids_crc32")))
        .join(ahead, ["length", "salt"])
        .withColumn("rank", F.col("ahead") + F.col("row") - 1)
    )
    # patterns are bounded by the number of lengths, not by the corpus
    at = F.broadcast(places)
    return ranked.join(at, (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))).select(
        "_k_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("offset")
    )
