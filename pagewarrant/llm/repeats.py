"""Repeated windows of documents, exactly, without a row per window.

``remove_repeats`` removes from each document the units (bytes or words) covered
by a window of fixed size that also starts in a document with a smaller id:

1. Texts are dealt into batches by id.  Each batch sends the distinct names of
   its windows (a window's least k-gram hash, see ``hashing``) to name buckets,
   packed as arrays; a bucket answers every batch with the names that other
   documents have too.  A name costs a batch 4 bytes however often it occurs.
   Whole texts are compared in the same exchange, so that an exact copy needs
   no further work.
2. A *run* is a stretch of windows of one document with one shared name.  Each
   batch sends its distinct runs, with the smallest and largest id that have
   them, to the name's bucket.  There an operator's own method (suffix sorting,
   graph compaction) finds the windows that distinct runs of a name share, and
   so which of them occur under a smaller id.
3. Answers (a bit for each window of a run) go back to the batches, which cut
   the texts.

Every exchange carries what a batch has combined, so a passage costs each batch
one entry.  Names with more than ``HOT_RUNS`` runs, equal ones counted once a
batch (common lines with ever other text around them), are dealt by single
windows instead of by name, so that no bucket gathers all contexts of a common
line.  That bound is a skew split: it depends neither on the number of batches
nor on the size of the corpus, and results are the same either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .session import bounded_batches, partitions, releasing, releasing_two

_NAME = np.dtype([("code", "<u4"), ("runs", "<u4")])
_COPY = np.dtype([("a", "<u8"), ("b", "<u8"), ("least", "<i8"), ("n", "<i8")])
_RUN = np.dtype([("name", "<u8"), ("least", "<i8"), ("most", "<i8"), ("length", "<u4")])
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("least", "<i8"), ("most", "<i8")])
_VERDICT = np.dtype([("a", "<u8"), ("b", "<u8"), ("least", "<i8"), ("mask", "<u8")])
_MESSAGE = pa.schema([("_k_bucket", pa.int32()), ("_k_batch", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
_MESSAGE_DDL = "_k_bucket int, _k_batch int, kind int, body binary"
_SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
#: Kinds of messages: names of one document, of several (with their number of distinct runs), of very many runs; whole texts; runs and single windows.
_ONE, _SEVERAL, _HOT, _TEXTS, _RUNS, _WINDOWS = range(6)
#: Runs that a name may have before its windows are dealt singly.
HOT_RUNS = 1024
#: Windows of a run at most (bits of a mask); longer runs (periodic text) are cut.
RUN = 64
#: Bytes of text that a task hashes at a time: the arrays of a few such pieces stay in a core's cache.
CHUNK = 100_000
_NO_ID = np.iinfo(np.int64).min
_FULL = (1 << 64) - 1
_CONTENT = 0xC2B2AE3D27D4EB4F


def _text_key(spec, raw: bytes) -> bytes:
    return hashlib.md5(raw if isinstance(spec, H.ByteWindows) else b" ".join(raw.split())).digest()


def _ids(table: pa.Table) -> np.ndarray:
    """Ids, with the least integer for null; a null id takes no part in comparisons."""
    return table["_k_id"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _codes(names: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A name's bucket, and 32 further bits; together they select candidates."""
    return ((names & H.U(0xFFFFFFFF)) % H.U(n_buckets)).astype(np.int32), (H.mix(names) >> H.U(32)).astype(np.uint32)


class _Outbox:
    """Messages of one task, packed by receiver."""

    def __init__(self):
        self.rows = {f.name: [] for f in _MESSAGE}

    def one(self, bucket: int, batch: int, kind: int, body: bytes) -> None:
        for column, x in zip(self.rows.values(), (bucket, batch, kind, body)):
            column.append(x)

    def send(self, by: np.ndarray, kind: int, rows: np.ndarray, bucket: int | None = None, batch: int | None = None) -> None:
        """Rows to the buckets (or batches) that ``by`` names."""
        order = np.argsort(by, kind="stable")
        edges = np.r_[0, np.flatnonzero(np.diff(by[order])) + 1, len(order)] if len(by) else np.zeros(1, int)
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            to = int(by[order[x]])
            self.one(to if bucket is None else bucket, to if batch is None else batch, kind, rows[order[x:y]].tobytes())

    def table(self) -> pa.Table:
        return pa.table([pa.array(self.rows[f.name], f.type) for f in _MESSAGE], schema=_MESSAGE)


def deal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts in batches, with their other columns in one struct so that no names clash.

    Rows go by id and text, so the texts of a repeated id are spread (ids travel
    with all that is compared); rows without an id, which are compared with
    nothing, stay about where they are read.
    """
    n = partitions(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    key = F.col(f"`{id_col}`").cast("long")
    return docs.select(
        F.pmod(F.xxhash64(key, F.col(f"`{text_col}`"), F.when(key.isNull(), F.spark_partition_id())), F.lit(n)).cast("int").alias("_k_batch"),
        key.alias("_k_id"),
        F.col(f"`{text_col}`").alias("_k_text"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_k_row"),
    ).repartition(n, "_k_batch")


def _announce(spec, n_buckets: int):
    def announce(table: pa.Table) -> pa.Table:
        batch, ids, out = table["_k_batch"][0].as_py(), _ids(table), _Outbox()
        buf, off = H.column_bytes(table["_k_text"])
        keys, key_ids, names, name_ids, contents = [], [], [], [], []
        for a, b in H.chunks(off, CHUNK):
            part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            values, units, _ = spec.units(part, at)
            starts, ends, found = H.window_runs(spec, values, units)
            owner = ids[a + np.searchsorted(units, starts, "right") - 1]
            known = owner != _NO_ID
            names.append(found[known])
            name_ids.append(owner[known])
            if len(starts):
                first, last = np.split(H.gram_hashes(values, spec.size, _CONTENT, np.r_[starts, ends - 1]), 2)
                contents.append(H.mix(first * H.U(3) + last + (ends - starts).astype(np.uint64))[known])
            long = np.flatnonzero((np.diff(units) >= spec.size) & (ids[a:b] != _NO_ID))
            raw = part.tobytes()
            keys += [_text_key(spec, raw[at[i] : at[i + 1]]) for i in long.tolist()]
            key_ids.append(ids[a:b][long])
        if names and sum(map(len, names)):
            found, owner, content = np.concatenate(names), np.concatenate(name_ids), np.concatenate(contents)
            order = np.argsort(found)
            found, owner, content = found[order], owner[order], content[order]
            new = np.r_[True, found[1:] != found[:-1]]
            first = np.flatnonzero(new)
            again = np.flatnonzero(~(new & np.r_[new[1:], True]))  # of names that occur more than once
            content[again] = content[again[np.lexsort((content[again], found[again]))]]
            runs = np.add.reduceat((new | np.r_[True, content[1:] != content[:-1]]).astype(np.int64), first)
            several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            bucket, rest = _codes(found[first], n_buckets)
            out.send(bucket[~several], _ONE, rest[~several], batch=batch)
            packed = np.zeros(int(several.sum()), _NAME)
            packed["code"], packed["runs"] = rest[several], np.minimum(runs[several], 0xFFFFFFFF)
            out.send(bucket[several], _SEVERAL, packed, batch=batch)
        if keys:
            texts, which = np.unique(np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2), axis=0, return_inverse=True)
            owner, which = np.concatenate(key_ids), which.ravel()
            rows = np.zeros(len(texts), _COPY)
            rows["a"], rows["b"], rows["least"] = texts[:, 0], texts[:, 1], np.iinfo(np.int64).max
            np.minimum.at(rows["least"], which, owner)
            np.add.at(rows["n"], which, 1)
            out.send((rows["a"] % H.U(n_buckets)).astype(np.int32), _TEXTS, rows, batch=batch)
        return out.table()

    return announce


def _gather(table: pa.Table, kind: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows of one kind, and the batch that each comes from."""
    kinds, batches, bodies = table["kind"].to_numpy(), table["_k_batch"].to_numpy(), table["body"].combine_chunks()
    at = np.flatnonzero(kinds == kind).tolist()
    arrays = [np.frombuffer(bodies[i].as_py(), dtype) for i in at]
    if not arrays:
        return np.empty(0, dtype), np.empty(0, np.int32)
    return np.concatenate(arrays), np.repeat(batches[at], [len(x) for x in arrays])


def _answer(hot_runs: int):
    def answer(table: pa.Table) -> pa.Table:
        """What a bucket tells the batches: names that several documents have, texts that occur more than once."""
        bucket, out = table["_k_bucket"][0].as_py(), _Outbox()
        (one, from_one), (several, from_several) = _gather(table, _ONE, np.uint32), _gather(table, _SEVERAL, _NAME)
        names, owner = np.concatenate([one, several["code"]]), np.concatenate([from_one, from_several])
        if len(names):
            weight = np.r_[np.ones(len(one), np.int64), np.full(len(several), 2)]
            runs = np.r_[np.ones(len(one), np.int64), several["runs"].astype(np.int64)]
            order = np.argsort(names, kind="stable")
            names, owner, weight, runs = names[order], owner[order], weight[order], runs[order]
            new = np.r_[True, names[1:] != names[:-1]]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            shared = (np.add.reduceat(weight, first) > 1)[group]
            hot = shared & (np.add.reduceat(runs, first) > hot_runs)[group]
            out.send(owner[shared & ~hot], _ONE, names[shared & ~hot], bucket=bucket)
            out.send(owner[hot], _HOT, names[hot], bucket=bucket)
        texts, owner = _gather(table, _TEXTS, _COPY)
        if len(texts):
            order = np.lexsort((texts["b"], texts["a"]))
            texts, owner = texts[order].copy(), owner[order]
            new = np.r_[True, (texts["a"][1:] != texts["a"][:-1]) | (texts["b"][1:] != texts["b"][:-1])]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            many = (np.add.reduceat(texts["n"], first) > 1)[group]
            texts["least"] = np.minimum.reduceat(texts["least"], first)[group]
            out.send(owner[many], _TEXTS, texts[many], bucket=bucket)
        return out.table()

    return answer


class _Replies:
    """What a batch has been told."""

    def __init__(self, table: pa.Table):
        names: dict[int, list] = {_ONE: [], _HOT: []}
        self.copies: dict[bytes, int] = {}
        self.runs: dict[bytes, tuple[int, int]] = {}
        self.windows: dict[bytes, int] = {}
        for bucket, kind, body in zip(table["_k_bucket"].to_pylist(), table["kind"].to_pylist(), table["body"].to_pylist()):
            if kind in names:
                names[kind].append((bucket << 32) + np.frombuffer(body, np.uint32).astype(np.uint64))
            elif kind == _TEXTS:
                self.copies.update((body[k : k + 16], int.from_bytes(body[k + 16 : k + 24], "little", signed=True)) for k in range(0, len(body), _COPY.itemsize))
            elif kind == _RUNS:
                rows = np.frombuffer(body, _VERDICT)
                self.runs.update((body[k : k + 16], x) for k, x in zip(range(0, len(body), _VERDICT.itemsize), zip(rows["least"].tolist(), rows["mask"].tolist())))
            else:
                rows = np.frombuffer(body, _WINDOW)
                self.windows.update((body[k : k + 16], x) for k, x in zip(range(0, len(body), _WINDOW.itemsize), rows["least"].tolist()))
        self.shared, self.hot = (np.sort(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in names.values())


class _Runs:
    """The shared runs of a chunk of documents: owner (row), start and end (windows), name, content."""

    def __init__(self, spec, n_buckets: int, part: np.ndarray, at: np.ndarray, ids: np.ndarray, replies: _Replies):
        self.spec, self.part, self.at = spec, part, at
        self.raw = part.tobytes()
        self.values, self.units, self.places = spec.units(part, at)
        starts, ends, names = H.window_runs(spec, self.values, self.units)
        owner = np.searchsorted(self.units, starts, "right") - 1
        bucket, rest = _codes(names, n_buckets)
        code = (bucket.astype(np.uint64) << H.U(32)) + rest
        self.whole = set()  # rows that are copies of a text with a smaller id
        for i in np.flatnonzero((np.diff(self.units) >= spec.size) & (ids != _NO_ID)).tolist() if replies.copies else ():
            if replies.copies.get(_text_key(spec, self.raw[at[i] : at[i + 1]]), ids[i]) < ids[i]:
                self.whole.add(i)
        skip = ids == _NO_ID
        skip[list(self.whole)] = True
        hit, hot = H.member(code, replies.shared) & ~skip[owner], H.member(code, replies.hot) & ~skip[owner]
        self.hot = owner[hot], starts[hot], ends[hot]
        starts, ends, names, owner = starts[hit], ends[hit], names[hit], owner[hit]
        pieces = (ends - starts + RUN - 1) // RUN
        which = np.repeat(np.arange(len(pieces)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.starts = starts[which] + k * RUN
        self.ends = np.minimum(ends[which], self.starts + RUN)
        self.names, self.owner = names[which], owner[which]

    def contents(self):
        size, raw, places = self.spec.size, self.raw, self.places
        if places is None:
            return [raw[a : b + size - 1] for a, b in zip(self.starts.tolist(), self.ends.tolist())]
        first, last = places[0][self.starts], places[1][self.ends + size - 2]
        return [b" ".join(raw[a:b].split()) for a, b in zip(first.tolist(), last.tolist())]

    def hot_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and 128-bit hash of each window with a hot name."""
        owner, starts, ends = self.hot
        count = ends - starts
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
        hashes = np.empty((len(at), 2), np.uint64)
        if len(at):
            for k, base in enumerate((0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)):
                hashes[:, k] = H.gram_hashes(self.values, self.spec.size, base, at)
        return np.repeat(owner, count), at, hashes


def _tell_runs(spec, n_buckets: int):
    def tell_runs(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = _Outbox()
        if not len(texts) or not len(answers):
            return out.table()
        batch, ids, replies = texts["_k_batch"][0].as_py(), _ids(texts), _Replies(answers)
        buf, off = H.column_bytes(texts["_k_text"])
        place: dict[bytes, int] = {}
        rows: list[list] = []
        hot: list[np.ndarray] = []
        for x, y in H.chunks(off, CHUNK):
            runs = _Runs(spec, n_buckets, buf[off[x] : off[y]], off[x : y + 1] - off[x], ids[x:y], replies)
            own = ids[x + runs.owner].tolist()
            for content, name, i in zip(runs.contents(), runs.names.tolist(), own):
                k = place.setdefault(content, len(rows))
                if k == len(rows):
                    rows.append([name, i, i])
                else:
                    row = rows[k]
                    row[1], row[2] = min(row[1], i), max(row[2], i)
            owner, _, hashes = runs.hot_windows()
            if len(owner):
                w = np.zeros(len(owner), _WINDOW)
                w["a"], w["b"], w["least"] = hashes[:, 0], hashes[:, 1], ids[x + owner]
                hot.append(w)
        if rows:
            packed = np.zeros(len(rows), _RUN)
            packed["name"], packed["least"], packed["most"] = (np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
            contents = list(place)
            packed["length"] = [len(c) for c in contents]
            bucket, _ = _codes(packed["name"], n_buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = order[a:b]
                out.one(int(bucket[own[0]]), batch, _RUNS, b"".join([len(own).to_bytes(8, "little"), packed[own].tobytes(), *[contents[i] for i in own.tolist()]]))
        if hot:
            w = np.sort(np.concatenate(hot), order=["a", "b", "least"])
            new = np.r_[True, (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])]
            first = np.flatnonzero(new)
            most = w["least"][np.r_[first[1:] - 1, len(w) - 1]]
            w = w[first].copy()
            w["most"] = most
            out.send((w["a"] % H.U(n_buckets)).astype(np.int32), _WINDOWS, w, batch=batch)
        return out.table()

    return tell_runs


def _resolve(spec, classes):
    """In a name's bucket: which windows of which runs occur under a smaller id."""

    def resolve(table: pa.Table) -> pa.Table:
        bucket, out = table["_k_bucket"][0].as_py(), _Outbox()
        w, owner = _gather(table, _WINDOWS, _WINDOW)
        if len(w):
            order = np.lexsort((w["least"], w["b"], w["a"]))
            w, owner = w[order].copy(), owner[order]
            new = np.r_[True, (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])]
            w["least"] = w["least"][np.flatnonzero(new)][np.cumsum(new) - 1]
            cut = w["most"] > w["least"]
            out.send(owner[cut], _WINDOWS, w[cut], bucket=bucket)
        place: dict[bytes, int] = {}
        heads, batches, which = [], [], []
        for batch, kind, body in zip(table["_k_batch"].to_pylist(), table["kind"].to_pylist(), table["body"].to_pylist()):
            if kind != _RUNS:
                continue
            n = int.from_bytes(body[:8], "little")
            head = np.frombuffer(body, _RUN, n, 8)
            at = 8 + n * _RUN.itemsize
            for end in (at + np.cumsum(head["length"].astype(np.int64))).tolist():
                which.append(place.setdefault(body[at:end], len(place)))
                at = end
            heads.append(head)
            batches.append(np.full(n, batch, np.int32))
        if not heads:
            return out.table()
        head, batches, which = np.concatenate(heads), np.concatenate(batches), np.array(which)
        contents = list(place)
        name, least = np.zeros(len(contents), np.uint64), np.full(len(contents), np.iinfo(np.int64).max)
        name[which] = head["name"]
        np.minimum.at(least, which, head["least"])
        mask = np.zeros(len(contents), np.uint64)
        # names whose runs differ in content and in least id
        order = np.argsort(name, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(name[order]) != 0])
        size = np.diff(np.r_[first, len(order)])
        differ = np.minimum.reduceat(least[order], first) != np.maximum.reduceat(least[order], first)
        own = order[np.repeat((size > 1) & differ, size)]
        if len(own):
            found = classes([contents[i] for i in own.tolist()], name[own])  # class numbers of all windows, run by run
            count = np.array([len(x) for x in found])
            flat = np.unique(np.concatenate(found), return_inverse=True)[1]
            run = np.repeat(np.arange(len(own)), count)
            smallest = np.full(int(flat.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, flat, least[own][run])
            bit = (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
            gone = smallest[flat] < least[own][run]
            np.bitwise_or.at(mask, own[run[gone]], H.U(1) << bit[gone])
        tell = np.flatnonzero((head["most"] > least[which]) | ((mask[which] > 0) & (head["least"] == least[which])))
        keys = {k: hashlib.md5(contents[k]).digest() for k in set(which[tell].tolist())}
        rows = np.zeros(len(tell), _VERDICT)
        if len(tell):
            key = np.frombuffer(b"".join([keys[k] for k in which[tell].tolist()]), "<u8").reshape(-1, 2)
            rows["a"], rows["b"], rows["least"], rows["mask"] = key[:, 0], key[:, 1], least[which[tell]], mask[which[tell]]
            out.send(batches[tell], _RUNS, rows, bucket=bucket)
        return out.table()

    return resolve


def _finish(spec, n_buckets: int, with_text: bool):
    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        ids, replies = _ids(texts), _Replies(told)
        buf, off = H.column_bytes(texts["_k_text"])
        n_units, kept, span_rows, span_starts, span_ends = [], [], [], [], []
        for x, y in H.chunks(off, CHUNK):
            runs = _Runs(spec, n_buckets, buf[off[x] : off[y]], off[x : y + 1] - off[x], ids[x:y], replies)
            units, places, raw, at = runs.units, runs.places, runs.raw, runs.at
            a, b = [], []  # covered units
            for i, s, e, content in zip(ids[x + runs.owner].tolist(), runs.starts.tolist(), runs.ends.tolist(), runs.contents() if replies.runs else ()):
                least, mask = replies.runs.get(hashlib.md5(content).digest(), (i, 0))
                if i > least:
                    a.append(s)
                    b.append(e + spec.size - 1)
                elif mask and i == least:
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        length = (~(mask >> low) & (mask >> low) + 1).bit_length() - 1
                        a.append(s + low)
                        b.append(s + low + length + spec.size - 1)
                        mask &= _FULL ^ (((1 << length) - 1) << low)
            if replies.windows:
                owner, start, hashes = runs.hot_windows()
                body = hashes.tobytes()
                for k, (i, s) in enumerate(zip(ids[x + owner].tolist(), start.tolist())):
                    if replies.windows.get(body[16 * k : 16 * k + 16], i) < i:
                        a.append(s)
                        b.append(s + spec.size)
            for i in runs.whole:
                a.append(int(units[i]))
                b.append(int(units[i + 1]))
            change = np.zeros(int(units[-1]) + 1, np.int64)
            np.add.at(change, np.array(a, np.int64), 1)
            np.add.at(change, np.array(b, np.int64), -1)
            gone = np.cumsum(change)[:-1] > 0
            edge = np.zeros(len(gone) + 1, bool)
            edge[1:-1] = gone[1:] != gone[:-1]
            edge[units[:-1]] = edge[-1] = True  # spans end with their document
            cut = np.flatnonzero(edge[:-1] if len(gone) else edge[:0])
            starts = cut[gone[cut]] if len(cut) else cut
            ends = np.r_[cut[1:], len(gone)][gone[cut]] if len(cut) else cut
            row = np.searchsorted(units, starts, "right") - 1
            span_rows.append(x + row)
            span_starts.append(starts - units[row])
            span_ends.append(ends - units[row])
            n_units.append(np.diff(units))
            pieces: list[list[bytes]] = [[] for _ in range(y - x)]
            touched = set(row.tolist())
            at_list = at.tolist()
            keeps = cut[~gone[cut]] if len(cut) else cut
            keep_ends = np.r_[cut[1:], len(gone)][~gone[cut]] if len(cut) else cut
            keep_row = np.searchsorted(units, keeps, "right") - 1
            if places is None:
                for i, s, e in zip(keep_row.tolist(), keeps.tolist(), keep_ends.tolist()):
                    pieces[i].append(raw[s:e])
                kept += [b"".join(p) for p in pieces]
            else:
                for i, s, e in zip(keep_row.tolist(), places[0][keeps].tolist(), places[1][keep_ends - 1].tolist()):
                    pieces[i].append(raw[s:e])
                kept += [b" ".join(b" ".join(p).split()) for p in pieces]
        none = [np.empty(0, np.int64)]
        row = np.concatenate(span_rows or none)
        offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(
            pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.concatenate(span_starts or none).astype(np.int64)), pa.array(np.concatenate(span_ends or none).astype(np.int64))], ["start", "end"])
        )
        columns = {"_k_id": texts["_k_id"], "_k_row": texts["_k_row"]}
        if with_text:  # characters that lost a byte go whole
            columns["kept_text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table(columns | {"n_units": pa.array(np.concatenate(n_units or none).astype(np.int64)), "removed": spans, "kept": pa.array(kept, pa.binary())})

    return finish


def remove_repeats(docs: DataFrame, spec, classes: Callable, id_col: str, text_col: str, with_text: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per row of ``docs``: ``_k_id``, ``_k_row`` (its other columns), ``n_units``, ``removed`` spans, ``kept`` bytes,
    and with ``with_text`` also ``kept_text``.

    ``classes(contents, names)`` gets distinct runs ordered by name and returns
    an array of class numbers for each: windows of one name are equal exactly
    if their numbers are.

    Null text is an empty document.  A row with a null id is kept whole and
    compared with nothing.  Rows with one id count as one document.
    """
    bounded_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    dealt = deal(docs, id_col, text_col)
    told = dealt.groupBy("_k_batch").applyInArrow(releasing(_announce(spec, n)), _MESSAGE_DDL)
    answers = told.groupBy("_k_bucket").applyInArrow(releasing(_answer(hot_runs)), _MESSAGE_DDL)
    runs = dealt.groupBy("_k_batch").cogroup(answers.groupBy("_k_batch")).applyInArrow(releasing_two(_tell_runs(spec, n)), _MESSAGE_DDL)
    verdicts = runs.groupBy("_k_bucket").applyInArrow(releasing(_resolve(spec, classes)), _MESSAGE_DDL)
    kinds = {f.name: f.dataType for f in dealt.schema}
    schema = T.StructType([T.StructField("_k_id", T.LongType()), T.StructField("_k_row", kinds["_k_row"])])
    if with_text:
        schema = schema.add("kept_text", "string")
    schema = schema.add("n_units", "long").add("removed", _SPANS).add("kept", "binary")
    return dealt.groupBy("_k_batch").cogroup(answers.union(verdicts).groupBy("_k_batch")).applyInArrow(releasing_two(_finish(spec, n, with_text)), schema)
