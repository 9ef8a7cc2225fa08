"""Removal of repeated passages by suffix arrays, built by linear grouping and partitioned by anchors.

A window is a string of ``length`` bytes. Its anchor is the leftmost of its ``k``-byte strings whose hash is smallest, so equal windows have equal
anchors at equal places. Windows that follow each other and share an anchor travel together as one piece, to the place where all pieces of that
anchor meet; there a suffix array of the distinct pieces brings equal windows next to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._base import bounded_batches, forget_shuffles, hot_split, nested, text_or_empty, unnested, written

_NO_ID = -(1 << 63)  # stands for a null doc_id, below every other
_BLOCK = 1 << 20  # windows whose anchors are looked for at once
#: An anchor of over this share of all pieces is heavy, so at most 1 / share are; their windows travel one by one.
HEAVY_SHARE = 1 / 2000
#: Distinct pieces of one anchor that are sorted together; beyond that its windows travel one by one, too.
LANE = 128
_CHUNK = 16_000  # rows that are sorted side by side
_ODD = -7046029254386353131
_ALONE, _KNOWN, _TELLS, _MANY = range(4)


# ---- the suffix array --------------------------------------------------------------------------------------------------------------------


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def suffix_order(text: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, lane by lane.

    Lanes are stretches of ``text``, each sorted by itself, all side by side. A lane begins and ends with a 0, and 0 stands at other places only as the
    end of a string; zeros differ, an earlier one is the smaller. Two passes, without renaming and recursion:

    1. Suffixes are in groups by a prefix, at first by their symbol. Groups are taken from the largest to the smallest. When one is taken its prefix u is
       final, a Lyndon word. Each member points to the nearest position before it in a smaller group; a position that c members point to
       has its prefix extended by c times u and moves behind the rest of its group, in the order of c.
    2. Groups are taken from the smallest on. Members differ in what follows their prefix, which is a smaller suffix that has its place already, or
       one more copy of the prefix: they are put in order by the number of copies, then by the place of what follows.
    """
    n = len(text)
    # Stable, so zeros stay in order; numbers of 16 bits are sorted in time that grows with n alone.
    sa = np.argsort(text, kind="stable")
    lane = np.cumsum(np.append(0, lane[1:] != lane[:-1]))
    sa = sa[np.argsort(lane[sa].astype(np.uint16 if lane[-1] < 1 << 16 else np.int64), kind="stable")].astype(np.int32)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    first = np.ones(n, bool)
    s, t = text[sa], lane[sa]
    first[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1]) | (s[1:] == 0)
    starts = np.flatnonzero(first)
    group = np.empty(n, np.int32)
    group[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.zeros(n, np.int32)
    size[starts] = np.diff(np.append(starts, n))
    smaller, span = np.arange(-1, n - 1, dtype=np.int32), np.ones(n, np.int32)
    hit = np.zeros(n, bool)

    top = np.flatnonzero(np.append(lane[1:] != lane[:-1], True)) + 1  # lanes are contiguous in sa as in text
    while len(top):
        last = sa[top - 1]
        going = text[last] != 0
        top, last = top[going], last[going]
        if not len(top):
            break
        low = group[last]
        member = sa[_ragged(low, top - low)]
        top = low
        open_ = member
        while len(open_):
            at = smaller[open_]
            far = group[at] >= group[open_]
            open_ = open_[far]
            smaller[open_] = smaller[at[far]]
        to = smaller[member]
        inner = text[to] != 0
        to, by = to[inner], span[member[inner]]
        if not len(to):
            continue
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        times = np.diff(np.append(new, len(to)))
        to, by = to[new], by[new]
        span[to] += times * by
        order = np.lexsort((times, group[to]))
        to, times = to[order], times[order]
        old = group[to]
        new = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        moved = np.diff(np.append(new, len(to)))
        goal = _ragged(old[new] + size[old[new]] - moved, moved)
        # Who stands in the way changes places with those that move.
        held = isa[to]
        hit[held] = True
        way = goal[~hit[goal]]
        hit[held] = False
        hit[goal] = True
        left = np.sort(held[~hit[held]])
        hit[goal] = False
        other = sa[way]
        sa[left], isa[other] = other, left
        sa[goal], isa[to] = to, goal
        size[old[new]] -= moved
        part = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
        sizes = np.diff(np.append(part, len(to)))
        group[to] = np.repeat(goal[part], sizes)
        size[goal[part]] = sizes

    after = np.minimum(np.arange(n, dtype=np.int32) + span, n - 1)
    copies = np.ones(n, np.int32)
    while True:
        same = (group[after] == group) & (text != 0)
        if not same.any():
            break
        copies = copies + np.where(same, copies[after], 0)
        after = np.where(same, after[after], after)
    rank = np.where(size[group] == 1, group, -1)
    open_ = sa[rank[sa] < 0]
    needs = after[open_]
    new = np.flatnonzero(np.append(True, group[open_[1:]] != group[open_[:-1]])[: len(open_)])
    sizes = np.diff(np.append(new, len(open_)))
    while len(open_):
        whole = np.minimum.reduceat(rank[needs], np.cumsum(sizes) - sizes) >= 0
        ready = np.repeat(whole, sizes)
        now = open_[ready]
        place = rank[needs[ready]]
        if copies[now].max(initial=1) == 1:  # one number says both
            now = now[np.argsort((group[now].astype(np.int64) << 32) | place)]
        else:
            now = now[np.lexsort((place, copies[now], group[now]))]
        done = sizes[whole]
        rank[now] = _ragged(group[now[np.cumsum(done) - done]], done)
        open_, needs, sizes = open_[~ready], needs[~ready], sizes[~whole]
    sa[rank] = np.arange(n)
    return sa


def window_owners(pieces: pa.Array, at: np.ndarray, lane: np.ndarray, docs: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset of each piece's first window, smallest document of each window): ``pieces`` are distinct within a lane and sorted by it, each has the
    lane's anchor at byte ``at``. The anchor is one symbol in the text that is sorted, so all windows are ``length - k + 1`` symbols."""
    w = length - k + 1
    raw, stops = _buffer(pieces)
    sizes = np.diff(stops, prepend=0)
    inner = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes + at, sizes)
    keep = (inner <= 0) | (inner >= k)
    small = raw.max(initial=0) < 254  # so it is in UTF-8
    symbols = np.where(inner == 0, 255, raw + np.uint8(1))[keep] if small else np.where(inner == 0, 257, raw.astype(np.int16) + 1)[keep]
    short = sizes - k + 1
    ends = np.append(lane[1:] != lane[:-1], True)  # a zero stands before each piece, and at the end of a lane
    starts = np.cumsum(short + 1 + ends) - short - ends
    text = np.zeros(int((short + 1 + ends).sum()), np.uint8 if small else np.int16)
    text[_ragged(starts, short)] = symbols
    of = np.repeat(np.arange(len(pieces)), short + 1 + ends)
    order = suffix_order(text, lane[of])
    windows = short - w + 1
    is_start = np.zeros(len(text), bool)
    is_start[_ragged(starts, windows)] = True
    order = order[is_start[order]]
    seen = np.lib.stride_tricks.sliding_window_view(text, w)[order].view(np.dtype((np.void, w * text.itemsize))).ravel()
    new = np.append(True, (seen[1:] != seen[:-1]) | (lane[of[order]][1:] != lane[of[order]][:-1]))
    new = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[of[order]], new)
    owner = np.empty(len(text), np.int64)
    owner[order] = np.repeat(least, np.diff(np.append(new, len(order))))
    first = np.cumsum(windows) - windows
    return first, owner[_ragged(starts, windows)]


# ---- anchors -----------------------------------------------------------------------------------------------------------------------------


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte string: a polynomial, put together from powers of two, then mixed."""
    with np.errstate(over="ignore"):
        whole, power, size, done, out = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1, 0, None
        while size <= k:
            if k & size:
                out = whole[: len(data) - k + 1] if out is None else out[: len(data) - k + 1] + whole[done : done + len(data) - k + 1] * scale
                scale = power if done == 0 else scale * power
                done += size
            if 2 * size > k:
                break
            whole = whole[:-size] * power + whole[size:] if len(whole) > size else whole[:0]
            power, size = power * power, size * 2
        out = out ^ (out >> np.uint64(29))
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, place of the anchor, its hash, mark) of each piece; ``ends``: where each text ends in ``data``. Pieces of one anchor
    with different marks differ."""
    parts = []
    total, w, low = len(data), length - k + 1, np.uint64(_BLOCK * 2 - 1)
    sizes = np.diff(ends, prepend=0)
    texts, limits = np.repeat(np.arange(len(ends), dtype=np.int32), sizes), np.repeat(ends - length, sizes)
    for begin in range(0, max(total - length + 1, 0), _BLOCK):
        n = min(_BLOCK, total - length + 1 - begin)
        hashes = _hashes(data[begin : begin + n + length - 1], k)
        best, got = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
        while got < w:
            step = min(got, w - got)
            best = np.minimum(best[:-step], best[step:])
            got += step
        start = np.flatnonzero(np.arange(begin, begin + n) <= limits[begin : begin + n])
        if not len(start):
            continue
        text, place = texts[begin : begin + n][start].astype(np.int64), (best[start] & low).astype(np.int64)
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        first, last, place, h = start[new], start[np.append(new[1:], len(start)) - 1], place[new], hashes.view(np.int64)
        mark = h[first] * _ODD ^ (h[last + length - k] + (place - first) * length + last)
        parts.append((text[new], first + begin, last + begin, place + begin, h[place], mark - first))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's bytes, and where each value ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _distinct(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many different x each h has; both are sorted."""
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    return np.add.reduceat((new | np.append(True, x[1:] != x[:-1])[: len(x)]).astype(np.int64), np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64)


_SAID = "h long, doc long, kind int, n long"


def _say(length: int, k: int):
    """Anchors of each document, and the pieces that they stand for. What two documents of a batch share is known here; one row tells the others, and how
    many pieces it stands for where they are many."""

    def run(batches):
        for b in batches:
            docs = b.column(0).to_numpy()
            text, _, _, _, h, mark = anchors(*_buffer(b.column(1)), length, k)
            doc = docs[text]
            order = np.lexsort((doc, h))
            h, doc, mark = h[order], doc[order], mark[order]
            one = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            h, doc, mark = h[one], doc[one], mark[one]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n = np.diff(np.append(new, len(h)))
            many = np.repeat(n > 1, n)
            tells = new[n > 1]
            kinds = np.where(many, _KNOWN, _ALONE)
            order = np.lexsort((mark[many], h[many]))
            pieces = _distinct(h[many][order], mark[many][order])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, h[tells])), pa.array(np.append(doc, doc[tells])), pa.array(np.append(kinds, np.full(len(tells), _TELLS)), pa.int32()), pa.array(np.append(np.ones(len(h), np.int64), pieces))], ["h", "doc", "kind", "n"])

    return run


def _shared(tasks: int):
    """Rows in order of h, of one task of ``tasks`` that have about as many: those of anchors of two documents or more stay, and the heavy anchors are
    told."""
    names = ["h", "doc", "kind", "n"]

    def rows(h, doc, kind, n):
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(np.full(len(h), kind), pa.int32()), pa.array(n, pa.int64())], names)

    def run(batches):
        total, held, many = 0, None, []

        def settled(h, doc, kind, n):
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            sizes = np.diff(np.append(new, len(h)))
            both = np.repeat(np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new), sizes) & (kind == _ALONE)
            weight = np.add.reduceat(n, new)
            many.append((h[new[weight > 256]], weight[weight > 256]))
            return rows(h[both], doc[both], _KNOWN, n[both])

        for b in batches:
            known = pc.equal(b.column(2), _KNOWN)
            yield b.filter(known)
            cols = [c.to_numpy() for c in b.filter(pc.invert(known)).columns]
            total += int(cols[3].sum())
            if held is not None:
                cols = [np.append(x, y) for x, y in zip(held, cols, strict=True)]
            if len(cols[0]):
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last anchor may go on
                if cut:
                    yield settled(*(c[:cut] for c in cols))
                held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield settled(*held)
        for h, weight in many:
            pick = weight > total * tasks * HEAVY_SHARE
            yield rows(h[pick], [None] * int(pick.sum()), _MANY, weight[pick])

    return run


# ---- pieces ------------------------------------------------------------------------------------------------------------------------------

_PIECES = "piece binary, left int, size int, doc long, th long, pos long, stop long"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def _rows(piece, left, size, doc, th, pos, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(piece, pa.binary()), pa.array(left, pa.int32()), pa.array(size, pa.int32()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(pos, pa.int64()), pa.array(stop, pa.int64())], _NAMES)


def _done(doc, th, pos, stop) -> pa.RecordBatch:
    none = [None] * len(doc)
    return _rows(none, none, none, doc, th, pos, stop)


def _joined(text: np.ndarray, pos: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of texts, sorted by text and begin, of equal sizes or growing ends: those that overlap or touch as one."""
    if not len(text):
        return text, pos, stop
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pos[1:] > stop[:-1])))
    return text[new], pos[new], np.maximum.reduceat(stop, new)


def _cut(length: int, k: int, heavy: list[int]):
    """Pieces whose anchor is shared; of equal ones in a batch the smallest document's go on, the others' are covered (``stop`` is set)."""
    lone = np.array(heavy, np.int64)

    def run(batches):
        for b in batches:
            keys = np.rec.fromarrays([b.column(0).to_numpy(), b.column(1).to_numpy()])
            if len(ones := np.unique(keys, return_index=True)[1]) < len(keys):
                b = b.take(pa.array(np.sort(ones)))  # of equal rows one speaks for all
            docs, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, ends = _buffer(b.column(2))
            text, first, last, place, h, _ = anchors(data, ends, length, k)
            lists = b.column(3)
            of = np.repeat(np.arange(len(docs)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            # Text and hash in one number; a chance hit adds a piece that then stands alone.
            pick = np.isin(h ^ (text * _ODD), lists.flatten().to_numpy() ^ (of * _ODD))
            if not pick.any():
                continue
            text, first, last, place, h = (x[pick] for x in (text, first, last, place, h))
            by_one = np.isin(h, lone)
            if by_one.any():  # a piece for each window
                n = np.where(by_one, last - first + 1, 1)
                start = _ragged(first, n)
                text, last, place, by_one = (np.repeat(x, n) for x in (text, last, place, by_one))
                first, last, place = start, np.where(by_one, start, last), np.where(by_one, start, place)
            raw, begins = data.tobytes(), np.append(0, ends)
            keys, least = [], {}
            for i, (a, z, p, one) in enumerate(zip(first.tolist(), (last + length).tolist(), place.tolist(), by_one.tolist(), strict=True)):
                key = (raw[a:z], -1 if one else p - a)
                keys.append(key)
                if (was := least.get(key)) is None or docs[text[i]] < docs[text[was]]:
                    least[key] = i
            own, doc = np.fromiter((least[key] for key in keys), np.int64, len(keys)), docs[text]
            alone = own == np.arange(len(keys))
            gone = doc > doc[own]  # rows of the smallest document itself are one
            pos, th = first - begins[text], ths[text]
            go = np.flatnonzero(alone | (~gone & ~alone))
            yield _rows([keys[i][0] for i in go], (place - first)[go], np.where(by_one, length, k)[go], doc[go], th[go], pos[go], [None] * len(go))
            covered, begin, end = _joined(text[gone], pos[gone], (last - first)[gone] + pos[gone] + length)
            yield _done(docs[covered], ths[covered], begin, end)

    return run


def _settle(length: int):
    """Rows in order of (anchor, piece, document): the parts of texts that windows of smaller documents cover. Rows of a piece but those of its smallest
    document are covered at once, so only different pieces are held; pieces of crowded anchors go on window by window."""

    def covered(t: pa.Table, k: int):
        piece, anchor = t.column("piece"), t.column("anchor")
        doc, th, pos, left = (t.column(c).to_numpy() for c in ("doc", "th", "pos", "left"))
        n = len(t)
        fresh = np.ones(n, bool)
        lane_new = np.ones(n, bool)
        if n > 1:
            lane_new[1:] = pc.not_equal(anchor[1:], anchor[:-1]).to_numpy()
            fresh[1:] = lane_new[1:] | pc.not_equal(piece[1:], piece[:-1]).to_numpy()
        which, ones = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        first, owner = window_owners(piece.take(pa.array(ones)).combine_chunks(), left[ones], (np.cumsum(lane_new) - 1)[ones], np.minimum.reduceat(doc, ones), k, length)
        n_windows = np.diff(np.append(first, len(owner)))[which]
        row = np.repeat(np.arange(n), n_windows)
        offset = _ragged(np.zeros(n, np.int64), n_windows)
        gone = owner[np.repeat(first[which], n_windows) + offset] < doc[row]
        row, offset = row[gone], offset[gone]
        if not len(row):
            return
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))
        end = np.append(new[1:], len(row)) - 1
        r = row[new]
        yield _done(doc[r], th[r], pos[r] + offset[new], pos[r] + offset[end] + length)

    def one_by_one(t: pa.Table):
        for at in range(0, len(t), 1000):  # a row gives many
            windows, doc, th, pos = [], [], [], []
            for p, d, h, first in zip(*(t[at : at + 1000].column(c).to_pylist() for c in ("piece", "doc", "th", "pos")), strict=True):
                n = len(p) - length + 1
                windows += [p[i : i + length] for i in range(n)]
                doc += [d] * n
                th += [h] * n
                pos += range(first, first + n)
            n = len(windows)
            yield _rows(windows, [0] * n, [length] * n, doc, th, pos, [None] * n)

    def parts(t: pa.Table):
        """Whole lanes: the crowded ones window by window, the others sorted, by length of anchor."""
        sizes, lane, fresh = t.column("size").to_numpy(), changed(t.column("anchor")), changed(t.column("piece"))
        of = np.cumsum(lane) - 1
        crowded = differ(lane, fresh)[of] > LANE
        if crowded.any():
            yield from one_by_one(t.filter(pa.array(crowded)))
        for k in np.unique(sizes[~crowded]).tolist():
            yield from covered(t.filter(pa.array(~crowded & (sizes == k))), k)

    def differ(lane: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Different pieces of each lane."""
        return np.add.reduceat((lane | fresh).astype(np.int64), np.flatnonzero(lane))

    def several(t: pa.Table) -> pa.Table:
        """Without the lanes of one piece, in which nothing is left to sort."""
        lane = changed(t.column("anchor"))
        return t.filter(pa.array((differ(lane, changed(t.column("piece"))) > 1)[np.cumsum(lane) - 1]))

    def changed(column) -> np.ndarray:
        out = np.ones(len(column), bool)
        if len(column) > 1:
            out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []
        ready: list[pa.Table] = []  # whole lanes
        n, last = 0, None  # the piece that the rows before end with, and its smallest document
        for b in batches:
            done = pc.is_valid(b.column("stop"))
            yield b.filter(done).select(_NAMES)
            b = b.filter(pc.invert(done))
            if not len(b):
                continue
            doc, piece = b.column("doc").to_numpy(), b.column("piece")
            fresh = changed(b.column("anchor")) | changed(piece)
            own = doc[np.maximum.accumulate(np.where(fresh, np.arange(len(b)), 0))]
            if last is not None and last[:2] == (b.column("anchor")[0].as_py(), piece[0].as_py()):
                own[: int(np.append(np.flatnonzero(fresh), len(b))[1])] = last[2]
            last = (b.column("anchor")[-1].as_py(), piece[-1].as_py(), int(own[-1]))
            again = doc > own
            pos, size = b.column("pos").to_numpy()[again], pc.binary_length(piece).to_numpy()[again]
            yield _done(doc[again], b.column("th").to_numpy()[again], pos, pos + size)
            # A window by itself is settled with that.
            b = b.filter(pa.array(~again & (b.column("size").to_numpy() < length)))
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n < _CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            a = t.column("anchor")
            cut = pc.index(a, a[-1]).as_py()
            ready.append(several(t[:cut]))
            if sum(map(len, ready)) > _CHUNK:
                yield from parts(pa.concat_tables(ready).combine_chunks())
                ready = []
            rest = t[cut:]
            if len(rest) > _CHUNK:  # one anchor goes on and on
                yield from one_by_one(rest)
                rest = rest[:0]
            held, n = rest.to_batches(), len(rest)
        if n:
            ready.append(several(pa.Table.from_batches(held).combine_chunks()))
        if sum(map(len, ready)):
            yield from parts(pa.concat_tables(ready).combine_chunks())

    return run


_RANGES = "doc long, th long, pos long, stop long"


def _merge(batches):
    """Parts in order of (doc, th, pos): those that overlap or touch as one. The last may go on in the next batch."""
    names = [c.split()[0] for c in _RANGES.split(", ")]
    held = [np.zeros(0, np.int64)] * 4
    for b in batches:
        doc, th, pos, stop = (np.append(x, b.column(c).to_numpy()) for x, c in zip(held, names, strict=True))
        if not len(doc):
            continue
        text = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        most = np.maximum.accumulate(stop + (text << 40)) - (text << 40)
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pos[1:] > most[:-1])))
        ends = np.maximum.reduceat(stop, new)
        held = [doc[new[-1:]], th[new[-1:]], pos[new[-1:]], ends[-1:]]
        new, ends = new[:-1], ends[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[new], th[new], pos[new], ends)], names)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)


def _apply(batches):
    for b in batches:
        sizes, gone, spans, kept = [], [], [], []
        for text, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            runs = sorted((x["pos"], x["stop"]) for x in parts or ())
            whole, at = hashlib.sha256(), 0
            for a, z in runs:
                whole.update(data[at:a])
                at = z
            whole.update(data[at:])
            sizes.append(len(data))
            gone.append(sum(z - a for a, z in runs))
            spans.append([{"start": a, "stop": z} for a, z in runs])
            kept.append(whole.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["row", "n_bytes", "n_removed", "spans", "kept_sha256"])


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def covered_ranges(docs: DataFrame, *, length: int = 50, k: int = 24) -> DataFrame:
    """(doc, th, pos, stop): parts of texts (bytes) that strings of ``length`` bytes cover which also start in a document of smaller id; th is the hash
    of the text. Parts of a text neither overlap nor touch."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text, tasks = text_or_empty(), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def step(make: Callable[[], DataFrame], tag: str) -> DataFrame:
        """Once the table is written no one holds the plan that made it."""
        out = written(make(), tag)
        forget_shuffles(spark)
        return out

    def copies() -> DataFrame:
        """(doc, th, stop) of texts that a smaller document has, too; ``whole`` where that holds of all rows of the document. They need no suffix array."""
        own = docs.select(_doc().alias("doc"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("stop"), F.md5(text).alias("key"))
        rows = written(own, "text-keys")
        lows = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
        hot, rest, cold = hot_split(rows, lows, ["key"], rows.count())
        all_ = hot.unionByName(rest.join(cold, "key")).select("doc", "th", "stop", (F.col("doc") > F.col("first")).alias("copy"))
        per = all_.groupBy("doc", "th", "stop", "copy").agg(F.count("*").alias("n"))
        return per.withColumn("whole", F.min("copy").over(Window.partitionBy("doc"))).where("copy").select("doc", "th", "stop", "whole")

    def lists(same: DataFrame) -> DataFrame:
        """Shared anchors of each document that is no copy; of none (null), the heavy anchors."""
        to = F.when(F.col("kind") == _KNOWN, F.xxhash64("doc", "h")).otherwise(F.col("h"))
        said = docs.select(_doc().alias("doc"), text.alias("text")).mapInArrow(_say(length, k), _SAID)
        shared = said.repartition(tasks, to).sortWithinPartitions("h").mapInArrow(_shared(tasks), _SAID)
        return shared.groupBy("doc").agg(F.collect_list("h").alias("hs")).join(same.where("whole").select("doc"), "doc", "left_anti")

    def pieces(shared: DataFrame, heavy: list[int]) -> DataFrame:
        body = docs.select(_doc().alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).join(shared.where("doc is not null"), "doc")
        return body.select("doc", "th", "text", "hs").mapInArrow(_cut(length, k, heavy), _PIECES)

    def settled(rows: DataFrame) -> DataFrame:
        anchor = F.expr("substring(piece, left + 1, size)")
        by = F.when(F.col("stop").isNotNull(), F.xxhash64("doc", "pos")).otherwise(F.xxhash64(anchor))
        return rows.repartition(by).withColumn("anchor", anchor).sortWithinPartitions("anchor", "piece", "doc").mapInArrow(_settle(length), _PIECES)

    same = step(copies, "text-copies")
    shared = step(lambda: lists(same), "shared-anchors")
    heavy = [r[0] for r in shared.where("doc is null").select(F.explode("hs")).distinct().collect()]
    found = step(lambda: settled(pieces(shared, heavy)), "covered")
    again = step(lambda: settled(found.where("stop is null")), "covered-windows")
    parts = ["doc", "th", "pos", "stop"]
    all_ = found.union(again).where("stop is not null").select(*parts).union(same.where(F.col("stop") >= length).select("doc", "th", F.lit(0).cast("long"), "stop"))
    return all_.repartition("doc", "th").sortWithinPartitions("doc", "th", "pos").mapInArrow(_merge, _RANGES)


def remove_repeats(docs: DataFrame, *, length: int = 50, k: int = 24) -> DataFrame:
    """Each row of ``docs`` with ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of bytes) and ``kept_sha256`` of the bytes that stay, which
    replace columns of those names: a byte goes if a string of ``length`` bytes that covers it also starts in a document of smaller id.

    Null texts are empty; texts under ``length`` bytes stay whole. Rows of one doc_id do not take from each other, rows without id are below every
    other. Strings do not cross documents, and are judged on the input. An empty table gives an empty result.
    """
    ours = ("n_bytes", "n_removed", "spans", "kept_sha256")
    names = [c for c in docs.columns if c not in ours]
    text = text_or_empty()
    gone = covered_ranges(docs, length=length, k=k).groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "stop")).alias("parts"))
    body = docs.select(nested(docs.select(*[F.col(f"`{c}`") for c in names if c != "text"])), _doc().alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    joined = body.join(gone, ["doc", "th"], "left").select("row", "text", "parts")
    schema = T.StructType([joined.schema["row"], *T._parse_datatype_string("n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string").fields])
    done = joined.mapInArrow(_apply, schema)
    return done.select(*unnested([c for c in names if c != "text"]), *ours)
