"""Suffix-array deduplication of byte strings, suffixes sorted by grouping.

The sorter groups suffixes by their Lyndon prefix.  Groups are processed from
the highest to the lowest: each suffix of a group points to the previous
smaller suffix before it, and the suffixes pointed at move to new groups behind
their old ones, ordered by how many pointers they got.  Then the order inside
all groups is emitted in one ascending pass, each placed suffix placing the
suffixes before it along their pointers.  No recursion and no renaming.

Many texts of like length are sorted at once: every array has a row per text, and
each step handles the current group of all texts.  Where fewer than ``TOGETHER``
are alike, each is sorted alone, group by group in plain lists.

Spark brings equal windows together (``repeats``): the distinct runs of windows
with one name are one text for the sorter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import hashing as H
from .repeats import HOT_RUNS, remove_repeats

SIZE = 50
#: Texts of like length that are sorted together, at least (fewer are sorted one by one), and bytes of such texts, with their fill, at most.
TOGETHER, CELLS = 24, 400_000


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges, and the range that each element comes from."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def _edges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    head = new.nonzero()[0]
    lengths = np.empty(len(head), np.int64)
    np.subtract(head[1:], head[:-1], out=lengths[:-1])
    lengths[-1:] = len(values) - head[-1:]
    return head, lengths


def suffix_arrays(texts: np.ndarray) -> np.ndarray:
    """Suffix arrays of equally long rows of positive integers (a terminator below all is implied)."""
    rows, n = texts.shape
    wide = n + 2  # column 0 stands before the text, column n + 1 is the terminator
    size = rows * wide
    row_at = np.arange(rows, dtype=np.int64) * wide
    small = not texts.size or texts.max() < 1 << 15
    symbols = np.zeros((rows, wide), np.int16 if small else np.int64)  # numpy sorts short integers by digits
    symbols[:, 0] = -1
    symbols[:, 1 : n + 1] = texts
    order = np.argsort(symbols, axis=1, kind="stable")
    sorted_symbols = np.take_along_axis(symbols, order, 1)
    new = np.ones((rows, wide), bool)
    new[:, 1:] = sorted_symbols[:, 1:] != sorted_symbols[:, :-1]
    order += row_at[:, None]
    places = order.ravel()  # suffixes by rank
    head = np.flatnonzero(new)
    lengths = np.diff(head, append=size)
    group = np.empty(size, np.int64)  # by suffix: the first rank of its group
    group[places] = np.repeat(head, lengths)
    group[row_at] = -1
    rank = np.empty(size, np.int64)
    rank[places] = np.arange(size)
    final = np.zeros(size, np.int64)  # by first rank of a group: its last rank
    final[head] = head + lengths - 1
    previous = np.zeros(size, np.int64)
    least, last = row_at + 1, row_at + wide - 1  # last: last rank of the group that each text is at
    while True:
        live = last > least
        if not live.all():
            least, last = least[live], last[live]
            if not len(last):
                break
        first = group[places[last]]
        sizes = last - first + 1
        members, which = _spread(first, sizes)
        members, mine = places[members], first[which]
        last = first - 1
        # previous smaller suffixes: jump over higher groups by their pointers, over own members by theirs
        at = members - 1
        previous[members] = at
        old = group[at]
        open_ = (old >= mine).nonzero()[0]
        while len(open_):
            to = previous[at[open_]]
            at[open_] = to
            previous[members[open_]] = to
            old[open_] = group[to]
            open_ = open_[old[open_] >= mine[open_]]
        # a group of one stays as it is, and column 0 has none
        at = at[(final[old] > old) & (old >= 0)]
        if not len(at):
            continue
        at.sort()
        head, times = _edges(at)
        targets = at[head]
        old = group[targets]
        by = np.argsort(old * wide + times)
        targets, times, old = targets[by], times[by], old[by]
        head, moved = _edges(old)
        begin = old[head]
        bound = final[begin] - moved + 1  # those pointed at go to the last ranks of their old group, from here
        shift = np.repeat(bound - head, moved)
        slots = np.arange(len(targets)) + shift
        # trade places with those in the way; both lists are ordered by group, so they pair up group by group
        freed = rank[targets]
        out = freed < np.repeat(bound, moved)
        if out.any():
            in_the_way = np.ones(len(targets), bool)
            in_the_way[(freed - shift)[~out]] = False
            away, freed = places[slots[in_the_way]], freed[out]
            places[freed] = away
            rank[away] = freed
        places[slots] = targets
        rank[targets] = slots
        # new groups: one for each number of pointers
        final[begin] = bound - 1
        fresh, lengths = _edges(old * wide + times)
        starts = slots[fresh]
        group[targets] = np.repeat(starts, lengths)
        final[starts] = starts + lengths - 1
    return _emit(rows, wide, row_at, group, previous)


def _emit(rows, wide, row_at, group, previous) -> np.ndarray:
    """The ascending pass: each text, at each step, goes to the next rank if it must and places one suffix if it can."""
    size = rows * wide
    out = np.full(size, -1, np.int64)
    front = np.arange(size)  # by first rank of a group: where its next suffix goes
    placed = np.zeros(size, bool)
    placed[row_at] = placed[row_at + wide - 1] = True  # column 0, so that chains end there, and the terminator
    at, end = row_at + 1, row_at + wide - 1
    out[at] = end
    now = end - 1
    while True:
        up = placed[now].nonzero()[0]
        if len(up):
            at[up] += 1
            over = at[up] > end[up]
            if over.any():
                keep = np.ones(len(at), bool)
                keep[up[over]] = False
                at, end, now = at[keep], end[keep], now[keep]
                if not len(at):
                    return out.reshape(rows, wide)[:, 2:] - row_at[:, None] - 1
                up = placed[now].nonzero()[0]
            now[up] = out[at[up]] - 1
        go = (~placed[now]).nonzero()[0]
        j = now[go]
        g = group[j]
        to = front[g]
        out[to] = j
        front[g] = to + 1
        placed[j] = True
        now[go] = previous[j]


def sort_alone(text: list[int]) -> list[int]:
    """Suffix array of one list of positive integers, in time that grows with its length (but for sorting within groups)."""
    n = len(text)
    if not n:
        return []
    symbols = [-1, *text, 0]  # place 0 stands before the text, the last one is the terminator
    places = sorted(range(n + 2), key=symbols.__getitem__)
    rank, group, end = [0] * (n + 2), [0] * (n + 2), [0] * (n + 2)  # end: by first rank of a group, its last
    first = 0
    for r, s in enumerate(places):
        if symbols[s] != symbols[places[first]]:
            first = r
        rank[s], group[s], end[first] = r, first, r
    previous = [0] * (n + 2)
    last, m = n + 1, n + 2
    while last > 1:
        first = group[places[last]]
        if first == last:  # one suffix points to one
            at = places[last] - 1
            while group[at] >= first:
                at = previous[at]
            previous[places[last]] = at
            old = group[at]
            to = end[old]
            if to > old:
                r, t = rank[at], places[to]
                places[r], places[to], rank[t], rank[at] = t, at, r, to
                group[at], end[to], end[old] = to, to, to - 1
            last = first - 1
            continue
        times: dict[int, int] = {}
        for s in sorted(places[first : last + 1]):
            at = s - 1
            while group[at] >= first:  # higher groups, and members before it, by their own pointers
                at = previous[at]
            previous[s] = at
            if end[group[at]] > group[at]:  # a group of one stays as it is, and that of place 0 is one
                times[at] = times.get(at, 0) + 1
        # those pointed at go to the end of their groups, by how many pointers they got
        order = sorted([(group[s] * m + count) * m + s for s, count in times.items()], reverse=True)
        at = 0
        while at < len(order):
            alike, stop = order[at] // m, at + 1
            while stop < len(order) and order[stop] // m == alike:
                stop += 1
            old = alike // m
            to = end[old]
            new = to - (stop - at) + 1
            end[old], end[new] = new - 1, to
            for key in order[at:stop]:
                s = key % m
                r, t = rank[s], places[to]
                places[r], places[to], rank[t], rank[s] = t, s, r, to
                group[s] = new
                to -= 1
            at = stop
        last = first - 1
    # the ascending pass
    out, filled, placed = [-1] * (n + 2), [0] * (n + 2), [False] * (n + 2)
    out[1] = n + 1
    for at in range(1, n + 2):
        now = out[at] - 1
        while now > 0 and not placed[now]:
            g = group[now]
            out[g + filled[g]] = now
            filled[g] += 1
            placed[now] = True
            now = previous[now]
    return [s - 1 for s in out[2:]]


def suffix_array(text: bytes) -> np.ndarray:
    """Suffix array of one byte string."""
    if not text:
        return np.empty(0, np.int64)
    return np.array(sort_alone([byte + 1 for byte in text]))


def equal_windows(size: int):
    """Class numbers of windows, for ``repeats.remove_repeats``: the distinct runs of a name are sorted as one text."""

    def classes(contents: list[bytes], names: np.ndarray) -> list[np.ndarray]:
        lengths = np.array([len(c) for c in contents])
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        n_runs = np.diff(np.r_[first, len(names)])
        total = np.add.reduceat(lengths, first)
        out: list[np.ndarray] = [None] * len(contents)
        base = 0
        by_length = np.argsort(total, kind="stable")
        at = 0
        while at < len(by_length):
            most = max(192, int(total[by_length[at]] * 1.4))
            end = min(int(np.searchsorted(total[by_length], most, "right")), at + max(1, CELLS // most))
            if end - at < TOGETHER:
                end = at + 1
            groups = by_length[at:end]
            runs, row = _spread(first[groups], n_runs[groups])
            n = int(total[groups].max())
            own = lengths[runs]
            within = np.cumsum(own) - own - np.repeat((np.cumsum(total[groups]) - total[groups]), n_runs[groups])
            column, which = _spread(within, own)
            grid = np.full((len(groups), n), 1, np.int16)  # the fill is below all bytes
            letters = np.frombuffer(b"".join([contents[i] for i in runs.tolist()]), np.uint8)
            at_letter = row[which] * n + column
            grid.ravel()[at_letter] = letters.astype(np.int16) + 2
            windows = own - size + 1
            column, which = _spread(within, windows)
            place = np.full(grid.size, -1, np.int64)  # which window of the call, for usable starts
            place[row[which] * n + column] = np.arange(len(which))
            order = suffix_arrays(grid) if len(groups) > 1 else np.array(sort_alone(grid[0].tolist()))[None, :]
            order = (order + (np.arange(len(groups)) * n)[:, None]).ravel()
            order = order[place[order] >= 0]
            same = np.zeros(len(order), bool)
            pair = np.flatnonzero(order[1:] // n == order[:-1] // n) + 1
            # windows are compared eight bytes at a time, the ends first, which settle most neighbours
            step = 8 if size >= 8 else 1
            block = np.zeros(grid.size + 7, np.uint8)
            block[at_letter] = letters
            eights = np.ndarray(grid.size, "<u8", block, strides=(1,)).copy() if step == 8 else block
            for probe in [size - step, *range(0, size - step, step)]:
                pair = pair[eights[order[pair] + probe] == eights[order[pair - 1] + probe]]
            same[pair] = True
            number = np.empty(len(order), np.int64)
            number[place[order]] = base + np.cumsum(~same)
            base += len(order) + 1
            for i, part in zip(runs.tolist(), np.split(number, np.cumsum(windows)[:-1])):
                out[i] = part
            at = end
        return out

    return classes


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_text: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Cut every byte that a ``size``-byte string covers which also starts in a document with a smaller id.

    Returns one row per row of ``docs`` with ``_k_id`` (its id), ``_k_row``
    (struct of its other columns), ``n_units`` (bytes), ``removed`` (spans
    [start, end) in bytes, ascending and apart) and ``kept`` (the remaining
    bytes).  Matches never cross documents and are judged on the input.

    Null text counts as empty; texts shorter than ``size`` are kept whole; a
    null id is kept whole and compared with nothing; rows with the same id are
    one document and do not cut each other; an empty table gives no rows.
    """
    spec = H.ByteWindows(size, max(1, min(24, size - 1)))
    return remove_repeats(docs, spec, equal_windows(size), id_col, text_col, with_text, hot_runs)
