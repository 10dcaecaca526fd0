"""Suffix-array deduplication of byte passages across documents.

A byte goes when it lies in a ``LENGTH``-byte string that also starts in a
document with a smaller id.  Three passes:

1. Every window of ``LENGTH`` bytes has an anchor, the least hash among its
   ``GRAM``-byte strings; equal windows have equal anchors.  A unit is a run of
   windows with one anchor.  Anchors are dealt to buckets, with 48-bit hashes of
   the units' bytes (a unit's content).  Anchors that only one document has are
   dropped: no string of theirs is shared, and most text goes no further.  Of
   the rest, each document is told which it has, and of which contents it is
   the least holder.
2. Units of these anchors are dealt by anchor, so windows that could be equal
   meet in one group.  The least holder of a content sends its bytes and stands
   for it; other holders send hashes.  The suffix array of a group's different
   units is built, and for each window the least document that has it is read
   off.  A document loses the windows that a lesser one has, by the unit that
   stands for its own.
3. Each document drops the bytes that its covered windows cover.

Copies and hot passages collapse before the shuffles: of a unit that several
documents of a batch hold, byte for byte, only the least document's is sent, and
the others are covered by it.

The suffix array is built by grouping (after Baier): suffixes are grouped by
first symbol and groups are taken in descending order.  For each member the
nearest position before it whose group is still to come is its previous-smaller
pointer; positions that are pointed at move to a new group just above their
own, the more often the higher.  At the end each group holds the suffixes of
one Lyndon prefix, and one scan in ascending order emits each group's order
along the same pointers.  Both phases are linear; nothing is renamed or sorted
recursively.  ``suffix_order`` does this for one text, ``suffix_orders`` for
many short ones at once.

Tasks work bucket by bucket, so their memory is a bucket's, ``BUCKET_BYTES`` of
text on average.  Beyond ``FAN`` buckets units are dealt in two steps.

Defined results: null texts are empty.  A document with a null id takes no part
and is kept whole.  Rows of one id are one document: they don't cover each
other.  Texts of any length are taken whole, those of less than ``LENGTH`` bytes
stay as they are, and a text without spaces is like any other.  Ties: of equal
passages the document with the least id keeps its own.  Every row gives one row;
an empty table gives none; columns with other names are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, ready, spread, stored, table

LENGTH = 50
GRAM = 24
GROUP_BYTES = 1 << 20
MOST_ROWS = 1 << 15
BUCKET_BYTES = 16 << 20
FAN = 4096
SYMBOLS = 1 << 18
FEW = 48
_SYMBOL = spread(256)
_BASE = 0x9E3779B97F4A7C15


def suffix_order(s: list[int]) -> list[int]:
    """The suffixes of ``s`` in ascending order; a suffix comes before those it is a prefix of."""
    n = len(s)
    if not n:
        return []
    symbols = sorted(set(s))
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    above, below = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    taken, up, prev = bytearray(n + 1), list(range(-1, n - 1)), [-1] * n
    final: list[tuple[int, int]] = []  # groups in descending order, with their sizes
    g = len(symbols) - 1
    above[g] = -1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            final.append((g, len(own)))
            for i in own:
                taken[i] = 1
            hits: dict[int, int] = {}
            for i in own:
                p = up[i]
                if p >= 0 and taken[p]:
                    path = [i]
                    while p >= 0 and taken[p]:
                        path.append(p)
                        p = up[p]
                    for q in path:
                        up[q] = p
                prev[i] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, m in hits.items():
                by_count.setdefault(m, []).append(p)
            for m in sorted(by_count, reverse=True):
                fresh: dict[int, int] = {}
                for p in by_count[m]:
                    old = group[p]
                    new = fresh.get(old, -1)
                    if new < 0:
                        new = fresh[old] = len(members)
                        members.append([])
                        over = above[old]
                        above.append(over)
                        below.append(old)
                        if over >= 0:
                            below[over] = new
                        above[old] = new
                    group[p] = new
                    members[new].append(p)
        g = below[g]
    head, at = [0] * len(members), 0
    for g, size in reversed(final):
        head[g] = at
        at += size
    out, placed, i, start = [-1] * n, bytearray(n), -1, n
    while True:
        j = start - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            j = prev[j]
        i += 1
        if i == n:
            return out
        start = out[i]


def suffix_orders(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``suffix_order`` of many texts of small symbols laid end to end, all taken forward together.

    A step takes one group of every text.  The result has, in each text's
    place, the positions of its suffixes in ascending order.
    """
    size, texts = len(s), len(ends)
    starts = np.r_[0, ends[:-1]]
    text_of = np.repeat(np.arange(texts), ends - starts)
    log = np.zeros(2 * size, np.int64)  # the members of each group, in a run
    log[:size] = np.argsort(text_of * (int(s.max(initial=0)) + 1) + s, kind="stable")
    first = _runs(text_of[log[:size]], s[log[:size]])
    n = len(first) - 1
    lo, hi, above, below = (np.full(n + size, -1, np.int64) for _ in range(4))
    lo[:n], hi[:n] = first[:-1], first[1:]
    owner = text_of[log[first[:-1]]]
    same = owner[1:] == owner[:-1]
    above[:n], below[:n] = np.r_[np.where(same, np.arange(1, n), -1), -1], np.r_[-1, np.where(same, np.arange(n - 1), -1)]
    group = np.empty(size, np.int64)
    group[log[:size]] = np.repeat(np.arange(n), np.diff(first))
    taken, up = np.zeros(size + 1, bool), np.arange(-1, size - 1)  # the last of taken stands for place -1
    up[starts] = -1
    head, room, used = np.zeros(n + size, np.int64), ends.copy(), size
    live = np.arange(texts)
    now = np.full(texts, -1, np.int64)
    now[owner] = np.arange(n)  # the last group of each text
    while len(live):
        g = now[live]
        count = hi.take(g) - lo.take(g)
        step = np.cumsum(count)
        own = log.take(np.repeat(lo.take(g) - step + count, count) + np.arange(step[-1]))
        of = np.repeat(np.arange(len(g)), count)
        still = np.flatnonzero(group.take(own) == g.take(of))
        own, of = own.take(still), of.take(still)
        taken[own] = True
        room[live] -= np.bincount(of, minlength=len(g))
        head[g] = room[live]
        p = up.take(own)
        on = np.flatnonzero(taken.take(p))
        while len(on):
            p[on] = q = up.take(p.take(on))
            on = on[taken.take(q)]
        up[own] = p
        hit = np.sort(p[p >= 0])
        if len(hit):
            cuts = _runs(hit)
            at, times = hit[cuts[:-1]], np.diff(cuts)
            bits = int(len(at)).bit_length()
            key = np.sort(((group[at] * (int(times.max()) + 1) + times) << bits) | np.arange(len(at)))
            at, key = at[key & ((1 << bits) - 1)], key >> bits
            cuts = _runs(key)
            k = len(cuts) - 1
            new, old = np.arange(n, n + k), group[at[cuts[:-1]]]
            lowest = np.r_[True, old[1:] != old[:-1]]
            highest = np.r_[lowest[1:], True]
            over = above[old]
            below[new], above[new] = np.where(lowest, old, new - 1), np.where(highest, over, new + 1)
            below[over[highest & (over >= 0)]] = new[highest & (over >= 0)]
            above[old[lowest]] = new[lowest]
            lo[new], hi[new] = used + cuts[:-1], used + cuts[1:]
            log[used : used + len(at)] = at
            group[at] = np.repeat(new, np.diff(cuts))
            n, used = n + k, used + len(at)
        now[live] = below[g]
        live = live[now[live] >= 0]
    out, placed = np.zeros(size, np.int64), np.zeros(size + 1, bool)
    placed[size] = True
    live = np.flatnonzero(ends > starts)
    j, i = ends[live] - 1, starts[live] - 1
    while len(live):
        fresh = ~placed.take(j)
        a = j[fresh]
        placed[a] = True
        g = group.take(a)
        h = head.take(g)
        out[h] = a
        head[g] = h + 1
        j[fresh] = up.take(a)
        rest = np.flatnonzero(~fresh)
        i[rest] += 1
        more = i[rest] < ends[live[rest]]
        rest, done = rest[more], rest[~more]
        last = out[i[rest]]
        j[rest] = np.where(last > starts[live[rest]], last - 1, -1)
        if len(done):
            keep = np.ones(len(live), bool)
            keep[done] = False
            live, i, j = live[keep], i[keep], j[keep]
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of _BASE and of its inverse, modulo 2^64."""
    if len(_POWERS) < 2 or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(b), np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: list[np.ndarray] = []


def contents(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """48-bit hashes of the units' bytes, from one prefix sum."""
    if not len(first):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_SYMBOL[data] * power[:-1], dtype=np.uint64)]
        own = (sums[last + LENGTH] - sums[first]) * inverse[first]
    return mixed(own + (last - first).astype(np.uint64)) >> np.uint64(16)


def _sliding(key: np.ndarray) -> np.ndarray:
    """The least key of each window's grams."""
    wide, k = LENGTH - GRAM + 1, 1
    while 2 * k <= wide:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    return np.minimum(key[: len(key) - (wide - k)], key[wide - k :]) if k < wide else key


def units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor of 48 bits, document, first window, last window, place of the anchor) of texts laid end to end."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    with np.errstate(over="ignore"):
        power, h, eight = np.uint64(_BASE), _SYMBOL[data], None
        for k in (1, 2, 4, 8):
            h = h[:-k] * power + h[k:]
            power = power * power
            if k == 4:
                eight, base8 = h, power
        h = h[:-8] * base8 + eight[16 : 16 + len(h) - 8]
        hashed, place = mixed(h) & ~np.uint64(255), np.arange(len(h), dtype=np.uint64)
    # The low bits are the place, so the first of equal hashes is the least; they are counted
    # from 0 or from 128, whichever doesn't wrap within a window.
    low = _sliding(hashed | (place & np.uint64(255)))
    late = _sliding(hashed | ((place + np.uint64(128)) & np.uint64(255)))
    on = (np.arange(len(low)) & 128) != 0
    low[on] = late[on] ^ np.uint64(128)
    starts = np.r_[0, ends[:-1]]
    windows = np.maximum(ends - starts - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(ends)), windows)
    at = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    low = low[at]
    anchor = at + (((low & np.uint64(255)).astype(np.int64) - at) & 255)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:] - 1, len(at) - 1]
    # Anchors that collide only make a group larger; their units differ.
    return low[first] >> np.uint64(16), doc[first], at[first], at[last], anchor[first]


def _texts(batches):
    """Groups of at most MOST_ROWS rows of about GROUP_BYTES: (record batch, bytes laid end to end, ends)."""
    for b in batches:
        text = b.column("bytes")
        off = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + GROUP_BYTES, side="right")) - 1)
            end = min(end, at + MOST_ROWS)
            yield b.slice(at, end - at), data[off[at] : off[end]], off[at + 1 : end + 1] - off[at]
            at = end


_KINDS = "bucket long, ids binary, at binary, anchors binary, contents binary, starts binary, shapes binary, bytes binary"
_SENT = [x.split()[0] for x in _KINDS.split(", ")]
_ANSWERS = "g long, kind int, who binary, counts binary, data binary"
_ANSWER = [x.split()[0] for x in _ANSWERS.split(", ")]
HOLDER, LEAST, SPANS, TEXT = 0, 1, 2, 3
_P = (1 << 31) - 1


def _six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, as bytes."""
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _from_six(b) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(np.r_[True, new]), n]


def _ramp(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[k]`` numbers from ``starts[k]`` on, for each k."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _words(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there on."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = wide[: len(data)].copy()
    for k in range(1, 8):
        out |= wide[k : k + len(data)] << np.uint64(8 * k)
    return out


def _differ(words: np.ndarray, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
    """Whether the ``size`` bytes (24 at least) from a differ from those from b."""
    out = np.zeros(len(a), bool)
    for k in range(0, int(np.max(size, initial=0)), 8):
        at = np.minimum(k, size - 8)
        out |= words.take(a + at) != words.take(b + at)
    return out


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column of what lies between the cuts."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Units:
    """Units as columns.

    ``who`` holds documents (ids, and hashes of their texts), ``doc`` the place
    of each unit's there; h and u are anchor and content.  The second pass adds
    the first window, the shape (windows, place of the anchor, whether bytes
    come along) and the bytes.
    """

    def __init__(self, who, doc, h, u, start=None, shape=None, body=None):
        self.who, self.doc, self.h, self.u, self.start, self.shape, self.body = who, doc, h, u, start, shape, body

    def sizes(self) -> np.ndarray:
        """Bytes sent of each unit."""
        return np.where(self.shape[:, 2] > 0, self.shape[:, 0].astype(np.int64) + LENGTH - 1, 0)

    def rows(self, buckets: int, fan: int) -> pa.RecordBatch:
        """A row for each bucket (for the first of two steps, each of ``fan`` groups of buckets)."""
        to = (self.h % np.uint64(buckets)).astype(np.int64) % fan
        order = np.argsort(to, kind="stable")
        cuts, rows = _runs(to[order]).tolist(), []
        size = None if self.shape is None else self.sizes()
        ends = None if size is None else np.cumsum(size)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[i:j]
            there = np.zeros(self.who.shape[1], bool)
            there[self.doc[k]] = True
            at, who = (np.cumsum(there) - 1)[self.doc[k]], self.who[:, there]
            row = [int(to[k[0]]), who.tobytes(), at.astype(np.uint16 if who.shape[1] < 65536 else np.uint32).tobytes(), _six(self.h[k]).tobytes(), _six(self.u[k]).tobytes(), None, None, None]
            if ends is not None:
                n = size[k]
                row[5:] = self.start[k].tobytes(), self.shape[k].tobytes(), self.body[_ramp(ends[k] - n, n)].tobytes()
            rows.append(row)
        return _rows(rows)

    @staticmethod
    def read(row: tuple) -> Units:
        _, who, at, h, u, start, shape, body = row
        h = _from_six(h)
        who, doc = np.frombuffer(who, dtype=np.int64).reshape(2, -1), np.frombuffer(at, dtype=np.uint16 if len(at) == 2 * len(h) else np.uint32)
        if start is None:
            return Units(who, doc, h, _from_six(u))
        return Units(who, doc, h, _from_six(u), np.frombuffer(start, dtype=np.int64), np.frombuffer(shape, dtype=np.uint8).reshape(-1, 3), np.frombuffer(body, dtype=np.uint8))

    @staticmethod
    def of(parts: list[Units]) -> Units:
        base = np.cumsum([0, *(p.who.shape[1] for p in parts)])
        rest = (None if getattr(parts[0], c) is None else np.concatenate([getattr(p, c) for p in parts]) for c in ("h", "u", "start", "shape", "body"))
        return Units(np.concatenate([p.who for p in parts], axis=1), np.concatenate([p.doc + b for p, b in zip(parts, base, strict=False)]), *rest)


def _rows(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_SENT)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], _SENT)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of byte ranges of each document, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = int(end.max(initial=0)) + 1
    cuts = _runs(doc)[1:-1]
    base = np.zeros(len(doc), np.int64)
    base[cuts] = wide
    base = np.cumsum(base)
    reach = np.maximum.accumulate(end + base)
    new = np.flatnonzero(np.r_[True, start[1:] + base[1:] > reach[:-1]] | np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], start[new], (reach - base)[np.r_[new[1:] - 1, len(doc) - 1]] if len(new) else end[:0]


def _spans(who: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, how many ranges each has, the merged ranges)."""
    doc, start, end = _merged(doc, start, end)
    n = np.bincount(doc, minlength=who.shape[1])
    return who[:, n > 0], n[n > 0], np.stack([start, end], axis=1).astype(np.int64)


def _sure(group: int, who, doc, start, end) -> pa.RecordBatch:
    """Ranges that need no answer; they go through the shuffle with a negative bucket."""
    who, n, ranges = _spans(who, doc, start, end)
    return _rows([[-1 - group, who.tobytes(), n.astype(np.int64).tobytes(), None, None, None, None, ranges.tobytes()]])


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that an id belongs to; ``_group_of`` is the same as a column."""
    return np.mod(ids, _P) * 48271 % _P % groups


def _group_of(doc_id: Column, groups: int) -> Column:
    return F.pmod(doc_id, F.lit(_P)) * F.lit(48271) % F.lit(_P) % F.lit(groups)


def _answers(who: np.ndarray, n: np.ndarray, data: np.ndarray, kind: int, groups: int) -> pa.RecordBatch:
    """A row for each group of documents: which of them, how many items each has, and the items (rows of bytes)."""
    g = _group(who[0], groups)
    order = np.argsort(g, kind="stable")
    data = data[_ramp((np.cumsum(n) - n)[order], n[order])]
    g, n = g[order], n[order]
    cuts = _runs(g)
    items = np.r_[0, np.cumsum(n)][cuts]
    return pa.RecordBatch.from_arrays([
        pa.array(g[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, kind, np.int32)),
        _binaries(np.ascontiguousarray(who[:, order].T).reshape(-1).view(np.uint8), 16 * cuts),
        _binaries(n.astype(np.int32).view(np.uint8), 4 * cuts), _binaries(data.reshape(-1), data.shape[1] * items),
    ], _ANSWER)


def _covered(who: np.ndarray, n: np.ndarray, ranges: np.ndarray, groups: int) -> pa.RecordBatch:
    return _answers(who, n, ranges.reshape(-1).view(np.uint8).reshape(-1, 16), SPANS, groups)


def _told(ids: np.ndarray, h: np.ndarray, kind: int, groups: int) -> pa.RecordBatch:
    """The anchors of each document."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    cuts = _runs(ids)
    who = ids[cuts[:-1]]
    return _answers(np.stack([who, np.zeros_like(who)]), np.diff(cuts), _six(h[order]).reshape(-1, 6), kind, groups)


def _items(who: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document of each item of an answer: ids and hashes of texts."""
    return tuple(np.repeat(np.frombuffer(who, np.int64).reshape(-1, 2), np.frombuffer(counts, np.int32), axis=0).T)


def _least_only(words: np.ndarray, ids: np.ndarray, h: np.ndarray, u: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the units that are left, by anchor and content; those that a lesser document of the batch has, byte for byte)."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.uint64)[doc]  # below MOST_ROWS
    with np.errstate(over="ignore"):
        order = np.argsort((mixed(h + u * np.uint64(_BASE)) & ~np.uint64(0xFFFF)) | rank)
    cuts = _runs(h[order], u[order])
    least = np.repeat(order[cuts[:-1]], np.diff(cuts))
    sure = np.flatnonzero(rank[order] > rank[least])
    k, least = order[sure], least[sure]
    size = last[k] - first[k] + LENGTH
    same = (last[least] - first[least] + LENGTH == size) & ~_differ(words, first[k], first[least], size)
    left = np.ones(len(order), bool)
    left[sure[same]] = False
    return order[left], k[same]


def _ask_anchors(buckets: int, fan: int):
    """Anchors and contents by bucket, the least document of each in the batch."""

    def run(batches):
        for group, (b, data, ends) in enumerate(_texts(batches)):
            who = np.stack([b.column("doc_id").to_numpy(), b.column("th").to_numpy()])
            h, doc, first, last, _ = units(data, ends)
            if not len(h):
                continue
            u = contents(data, first, last)
            left, k = _least_only(_words(data), who[0], h, u, doc, first, last)
            if len(k):
                base = np.r_[0, ends[:-1]][doc[k]]
                yield _sure(group % 64, who, doc[k], first[k] - base, last[k] - base + LENGTH)
            k = left[_runs(h[left], u[left], who[0][doc[left]])[:-1]]
            yield Units(who * [[1], [0]], doc[k], h[k], u[k]).rows(buckets, fan)

    return run


def _resplit(buckets: int):
    """The second step of dealing: units of a group of buckets, gathered up to a bound, to their buckets."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] < 0:
                    yield _rows([list(r)])
                    continue
                held.append(Units.read(r))
                size += sum(map(len, filter(None, r[1:])))
                if size >= BUCKET_BYTES:
                    yield Units.of(held).rows(buckets, buckets)
                    held, size = [], 0
        if held:
            yield Units.of(held).rows(buckets, buckets)

    return run


def _answering(answer, groups: int):
    """``answer`` of the units of each bucket; ranges that came along are handed on."""

    def run(batches):
        held, now = [], None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] < 0:
                    who = np.frombuffer(r[1], dtype=np.int64).reshape(2, -1)
                    yield _covered(who, np.frombuffer(r[2], dtype=np.int64), np.frombuffer(r[7], dtype=np.int64).reshape(-1, 2), groups)
                    continue
                if r[0] != now and held:
                    yield from answer(Units.of(held), groups)
                    held = []
                now = r[0]
                held.append(Units.read(r))
        if held:
            yield from answer(Units.of(held), groups)

    return run


def _answer_anchors(x: Units, groups: int):
    """Each document learns which of its anchors others have too, and of which contents it is the least holder."""
    ids = x.who[0][x.doc]
    order = np.lexsort((ids, x.u, x.h))
    ids, h, u = ids[order], x.h[order], x.u[order]
    cuts = _runs(h)
    size = np.diff(cuts)
    shared = np.repeat(np.minimum.reduceat(ids, cuts[:-1]) != np.maximum.reduceat(ids, cuts[:-1]), size)
    cuts = _runs(h, u)
    least = ids == np.repeat(ids[cuts[:-1]], np.diff(cuts))
    for which, kind in ((shared & least, LEAST), (shared & ~least, HOLDER)):
        if which.any():
            yield _told(ids[which], h[which], kind, groups)


def _with_answers(batches, text: str = "bytes"):
    """Texts in groups of about GROUP_BYTES, each with the answers to its documents.

    The rows of a group of documents come together, answers first.
    """
    told: list[tuple] = []  # (g, who, counts, data, kind)
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        kind = b.column("kind").to_numpy()
        cuts = _runs(kind == TEXT).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(i, j - i)
            if kind[i] != TEXT:
                if size >= GROUP_BYTES:
                    yield pa.Table.from_batches(held), told
                    held, size, told = [], 0, []
                told += zip(*(part.column(c).to_pylist() for c in (*_ANSWER[:1], *_ANSWER[2:], "kind")), strict=True)
                continue
            length = pc.coalesce(pc.binary_length(part.column(text)), 0).to_numpy().astype(np.int64)
            at = 0
            while at < part.num_rows:
                room = max(1, int(np.searchsorted(np.cumsum(length[at:]), GROUP_BYTES - size, side="right")))
                piece = part.slice(at, room)
                held.append(piece)
                size += int(length[at : at + room].sum())
                at += room
                if size >= GROUP_BYTES or len(held) > 512 or sum(p.num_rows for p in held) > MOST_ROWS // 2:
                    yield pa.Table.from_batches(held), told
                    last = piece.column("g")[-1].as_py()
                    held, size, told = [], 0, [t for t in told if t[0] == last]
    if held:
        yield pa.Table.from_batches(held), told


def _state(ids: np.ndarray, told: list[tuple], h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each unit, what its document was told of its anchor; -1 if nothing.

    A document may hold an anchor with several contents; it sends the bytes of
    all if it is the least holder of one.
    """
    some, rank = np.unique(ids, return_inverse=True)
    whose, kind = _told_items(told)
    key = _from_six(b"".join(t[3] for t in told))
    at = np.minimum(np.searchsorted(some, whose), len(some) - 1)
    k = np.flatnonzero(some[at] == whose)
    key, kind = (at[k].astype(np.uint64) << np.uint64(48)) | key[k], kind[k]
    order = np.lexsort((-kind, key))
    key, kind = key[order], kind[order]
    own = (rank[doc].astype(np.uint64) << np.uint64(48)) | h
    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
    return np.where(key[at] == own, kind[at], -1) if len(key) else np.full(len(h), -1)


def _told_items(told: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The id and the kind of each item."""
    ids = [_items(t[1], t[2])[0] for t in told]
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.repeat(np.array([t[4] for t in told], np.int64), [len(x) for x in ids])


def _ask_units(buckets: int, fan: int):
    """Units of shared anchors by bucket, with bytes where the document was told to stand for them."""

    def run(batches):
        for group, (rows, told) in enumerate(_with_answers(batches)):
            rows = rows.filter(pc.is_in(rows.column("doc_id"), pa.array(np.unique(_told_items(told)[0]))))
            if not rows.num_rows:
                continue
            who = np.stack([rows.column("doc_id").to_numpy(), rows.column("th").to_numpy()])
            texts = rows.column("bytes").to_pylist()
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            del texts
            h, doc, first, last, place = units(data, ends)
            state = _state(who[0], told, h, doc)
            k = np.flatnonzero(state >= 0)
            if not len(k):
                continue
            h, doc, first, last, place, state = h[k], doc[k], first[k], last[k], place[k], state[k]
            u, base = contents(data, first, last), np.r_[0, ends[:-1]][doc]
            left, k = _least_only(_words(data), who[0], h, u, doc, first, last)
            if len(k):
                yield _sure(group % 64, who, doc[k], first[k] - base[k], last[k] - base[k] + LENGTH)
            k = left
            shape = np.stack([last - first + 1, place - first, state], axis=1)[k].astype(np.uint8)
            x = Units(who, doc[k], h[k], u[k], (first - base)[k], shape)
            x.body = data[_ramp(first[k], x.sizes())]
            yield x.rows(buckets, fan)

    return run


def window_owners(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Of every window of every piece of ``data``, the least owner of a piece of its group that has the same window.

    Pieces come in the order of their groups.  A group's pieces are one text
    for the suffix array, which puts equal windows side by side.
    """
    out = np.zeros(int((sizes - LENGTH + 1).sum()), np.int64)
    window = np.cumsum(sizes - LENGTH + 1) - (sizes - LENGTH + 1)
    cuts = _runs(groups)
    length = np.add.reduceat(sizes + 1, cuts[:-1])
    order = np.argsort(length, kind="stable")  # groups of like length go forward together
    total = np.cumsum(length[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, total[at] - length[order[at]] + SYMBOLS, side="right")))
        some = order[at:end]
        at = end
        p = _ramp(cuts[:-1][some], np.diff(cuts)[some])
        # Bytes count from 1; 0 ends each piece, sorts first and is part of no window.
        s = np.zeros(int((sizes[p] + 1).sum()), np.int64)
        ends = np.cumsum(sizes[p] + 1)
        first = ends - sizes[p] - 1
        s[_ramp(first, sizes[p])] = data[_ramp(starts[p], sizes[p])].astype(np.int64) + 1
        text_ends = np.cumsum(length[some])
        if len(some) >= FEW:
            suffixes = suffix_orders(s, text_ends)
        else:
            suffixes = np.concatenate([np.array(suffix_order(s[z - n : z].tolist()), np.int64) + z - n for z, n in zip(text_ends.tolist(), length[some].tolist(), strict=True)])
        piece = np.repeat(np.arange(len(p)), sizes[p] + 1)
        text = np.repeat(np.arange(len(some)), length[some])
        suffixes = suffixes[suffixes + LENGTH < ends[piece[suffixes]]]
        words = _words((s - 1).astype(np.uint8))
        new = np.r_[True, (text[suffixes[1:]] != text[suffixes[:-1]]) | _differ(words, suffixes[1:], suffixes[:-1], LENGTH)]
        runs = np.flatnonzero(new)
        mine = piece[suffixes]
        least = np.minimum.reduceat(owners[p[mine]], runs)
        out[window[p[mine]] + suffixes - first[mine]] = np.repeat(least, np.diff(np.r_[runs, len(suffixes)]))
    return out


def _shared(data: np.ndarray, start: np.ndarray, step: int, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far each text, read from ``start`` by ``step``, agrees with another one of its group."""
    width = LENGTH - GRAM
    at = start[:, None] + step * np.arange(width)[None, :]
    m = np.full((len(start), 32), 255, np.uint8)
    m[:, :width] = np.where(np.arange(width)[None, :] < sizes[:, None], data.take(np.clip(at, 0, len(data) - 1)), 255)
    key = m.view(">u8")
    order = np.lexsort((key[:, 3], key[:, 2], key[:, 1], key[:, 0], group))
    rows, g = m[order, :width], group[order]
    common = np.cumprod(rows[1:] == rows[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    common[g[1:] != g[:-1]] = 0
    out = np.zeros(len(start), np.int64)
    out[order] = np.maximum(np.r_[0, common], np.r_[common, 0])
    return np.minimum(out, sizes)


def _answer_units(x: Units, groups: int):
    """The covered ranges of each document, from the suffix array of each anchor's different units.

    Units of a group agree at the anchor.  What lies further from it than any
    other unit agrees is part of no equal window: of several units it is cut off
    first, and the suffix array is built of the different texts that remain.
    """
    ids, size = x.who[0][x.doc], x.sizes()
    offset = np.cumsum(size) - size
    order = np.lexsort((size == 0, ids, x.u, x.h))
    cuts = _runs(x.h[order], x.u[order])
    stands = order[cuts[:-1]]  # of each content, a unit of its least holder
    if not size[stands].all():
        raise RuntimeError("a passage has no least holder: the table changed between passes")
    content = np.empty(len(x.h), np.int64)
    content[order] = np.repeat(np.arange(len(stands)), np.diff(cuts))
    owner = ids[stands]
    start, size, place = offset[stands], size[stands], x.shape[stands, 1].astype(np.int64)
    cuts = _runs(x.h[stands])
    group, several = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    shift = np.zeros(len(stands), np.int64)
    piece = np.arange(len(stands))  # the text that stands for each content in the suffix array
    k = np.flatnonzero(several)
    if len(k):
        reach = np.minimum(place[k], LENGTH - GRAM)
        left = _shared(x.body, start[k] + place[k] - 1, -1, reach, group[k])
        rest = size[k] - place[k] - GRAM
        right = _shared(x.body, start[k] + place[k] + GRAM, 1, np.minimum(rest, LENGTH - GRAM), group[k])
        shift[k] = place[k] - left
        start[k] += shift[k]
        size[k] = left + GRAM + right
        raw, seen = x.body.tobytes(), {}
        for c, g, a, n in zip(k.tolist(), group[k].tolist(), start[k].tolist(), size[k].tolist(), strict=True):
            piece[c] = seen.setdefault((g, raw[a : a + n]), c) if n >= LENGTH else -1
    used = np.flatnonzero(piece == np.arange(len(piece)))
    asked = np.flatnonzero(piece >= 0)
    least = np.full(len(stands), np.iinfo(np.int64).max)
    np.minimum.at(least, piece[asked], owner[asked])
    found = window_owners(x.body, start[used], size[used], least[used], group[used])
    windows = size[used] - LENGTH + 1
    at = np.zeros(len(stands), np.int64)
    at[used] = np.cumsum(windows) - windows
    # Holders: rows of the least document follow the windows of its own content, all windows of others are covered.
    n = size[asked] - LENGTH + 1
    of, w = np.repeat(asked, n), _ramp(np.zeros(len(asked), np.int64), n)
    less = np.flatnonzero(found[_ramp(at[piece[asked]], n)] < owner[of])
    of, w = of[less], w[less]
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (w[1:] != w[:-1] + 1)]) if len(of) else np.zeros(0, np.int64)
    last = np.r_[first[1:] - 1, len(of) - 1][: len(first)]
    of, lo, hi = of[first], w[first] + shift[of[first]], w[last] + shift[of[first]] + LENGTH
    mine = np.flatnonzero(ids == owner[content])
    mine = mine[np.argsort(content[mine], kind="stable")]
    bounds = np.searchsorted(content[mine], np.arange(len(stands) + 1))
    times = (bounds[1:] - bounds[:-1])[of]
    row, r = mine[_ramp(bounds[of], times)], np.repeat(np.arange(len(of)), times)
    whole = np.flatnonzero(ids > owner[content])
    span = x.shape[whole, 0].astype(np.int64) - 1 + LENGTH
    rows = np.r_[row, whole]
    if len(rows):
        yield _covered(*_spans(x.who, x.doc[rows], np.r_[x.start[row] + lo[r], x.start[whole]], np.r_[x.start[row] + hi[r], x.start[whole] + span]), groups)


def _cut(columns: list[str], text: str, as_text: bool):
    """Documents with the bytes (or, without characters that were cut through, the text) outside their covered ranges."""
    kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if as_text else pa.binary())])

    def run(batches):
        for rows, told in _with_answers(batches, text):
            parts = [(*_items(t[1], t[2]), np.frombuffer(t[3], np.int64).reshape(-1, 2)) for t in told]
            ids, ths, spans = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros((0, 2), np.int64),)
            who, doc = {}, np.empty(len(ids), np.int64)
            for r, key in enumerate(zip(ids.tolist(), ths.tolist(), strict=True)):
                doc[r] = who.setdefault(key, len(who))
            doc, start, end = _merged(doc, spans[:, 0], spans[:, 1])
            bounds = np.searchsorted(doc, np.arange(len(who) + 1)).tolist()
            start, end, out = start.tolist(), end.tolist(), []
            for i, th, t in zip(rows.column("doc_id").to_pylist(), rows.column("th").to_pylist(), rows.column(text).cast(pa.binary()).to_pylist(), strict=True):
                t, k = t or b"", who.get((i, th), -1)
                runs = range(bounds[k], bounds[k + 1]) if k >= 0 else ()
                at, kept = 0, []
                for r in runs:
                    kept.append(t[at : start[r]])
                    at = end[r]
                kept.append(t[at:])
                body = b"".join(kept)
                out.append((sum(end[r] - start[r] for r in runs), len(runs), body.decode("utf-8", "ignore") if as_text else body))
            new = pa.array([dict(zip(("n_removed", "n_spans", "kept"), x, strict=True)) for x in out], kind)
            for part in rows.select([f"c_{k}" for k in range(len(columns))]).append_column("dedup", new).rename_columns([*columns, "dedup"]).to_batches():
                yield part

    return run


def _dealt(asked: DataFrame, buckets: int, fan: int, answer) -> DataFrame:
    """Units to their buckets, and each bucket's answers."""
    if fan < buckets:
        asked = asked.repartition(fan, "bucket").mapInArrow(_resplit(buckets), _KINDS)
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, _ANSWERS)


def _met(texts: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Texts and answers by group of documents, answers first."""
    return texts.unionByName(answers, allowMissingColumns=True).repartition(tasks, "g").sortWithinPartitions("g", "kind")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with a column ``dedup`` of n_removed, n_spans and kept (the bytes, or the text, that stay)."""
    ready(docs.sparkSession)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, groups = int(total // BUCKET_BYTES + 1), int(total // GROUP_BYTES + 1)
    fan = buckets if buckets <= FAN else FAN
    doc_id = F.col(id_col).cast("long")
    # Documents without an id have no answers; they are spread by their texts.
    place = F.coalesce(_group_of(doc_id, groups), -1 - F.pmod(F.xxhash64(body), F.lit(groups)))
    own = [place.alias("g"), F.lit(TEXT).alias("kind"), doc_id.alias("doc_id"), F.xxhash64(body).alias("th")]
    rows = docs.select(*own, body.alias("bytes")).where(F.col("doc_id").isNotNull())
    asked = rows.select("doc_id", "th", "bytes").mapInArrow(_ask_anchors(buckets, fan), _KINDS)
    first = stored(_dealt(asked, buckets, fan, _answering(_answer_anchors, groups)), "anchors")
    asked = _met(rows, first.where(F.col("kind") != SPANS), buckets).mapInArrow(_ask_units(buckets, fan), _KINDS)
    second = stored(_dealt(asked, buckets, fan, _answering(_answer_units, groups)), "covered")
    covered = first.where(F.col("kind") == SPANS).unionByName(second)
    named = [F.col(c).alias(f"c_{k}") for k, c in enumerate(docs.columns)]
    kind = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("dedup", kind)])
    return _met(docs.select(*own, *named), covered, buckets).mapInArrow(_cut(docs.columns, f"c_{docs.columns.index(text_col)}", as_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup(docs)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))
