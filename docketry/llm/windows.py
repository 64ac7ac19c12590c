"""Substring dedup by compact windows.

A text is the sequence of its five-word shingles.  Under each of ``HASHES`` hash
functions the sequence is split as a Cartesian tree splits it: the least value
of a range is the min-hash of every subsequence that holds it, so one compact
window (left, place, right) stands for all of them, and only windows of at
least ``PASSAGE`` words are made: about 2n/PASSAGE a text and hash, not n^2.
Of equal least values the first counts.  Windows of a text that are alike up to
a passage before and after their places are one, so a text of one phrase makes
few of them; a shingle that stands in many surroundings has one for each.

Equal texts are folded first; a copy of a text of PASSAGE words or more is one
passage as a whole.  Windows of the other documents meet by (hash, least
shingle).  Each window that meets another brings its surroundings, one byte for
each shingle up to PASSAGE words before and after its place and within the
window.  With the places aligned, the intervals of PASSAGE words around them
that have enough shingles in common decide: a window takes the document of
smaller id with the most, once over the intervals that hold the shingles before
its place and once over those after it, and for each interval that neither of
them shares (or not whole) but another one does, the likest of those; no window
is left out and no shared interval.  The words of these pairs decide: passages
are maximal regions in which most shingles occur in the other text, of PASSAGE
words or more, whose multisets of shingles are alike by ``LIKENESS`` or more; a
region that isn't alike as a whole is parted at its misses and where its shift
jumps, and its verbatim runs are kept.

A group of more than BLOCK windows keeps one window for each surroundings, the
others go to the document of that one; what is left meets in pairs of blocks.
All windows of a group are compared inside tasks, so the time, not the rows,
grows with the square of the different surroundings of a group, and rows with
that number over BLOCK.

Cases: null texts and those under PASSAGE words have no passage.  A null doc_id
takes no part.  Rows that repeat a doc_id are one document to the groups and each
of their texts is compared.  Of sources with equally many shingles the least
doc_id is taken.  A passage that only repeats within its document is not looked
for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import U, Words, by_slice, cuts, mix, powers, utf8
from .tables import MOST_BROADCAST_IDS, durable, with_groups, within

SHINGLE = 5
PASSAGE = 50
LIKENESS = 0.8
HASHES = 4
BLOCK = 4_096
PAIRS = 8_192  # windows or pairs of windows looked at at once
BLOCKS = 8  # neighbouring blocks of surroundings whose bits must agree before two windows are compared shingle by shingle
TABLED = 32  # a group of more windows is compared as a table of pairs
#: misses, or steps of the shift, that part a region which isn't alike as a whole, one after the other
PARTED = (64, 32, 16, 8, 4, 2, 1, 0)
_WHITE = " \t\n\x0b\f\r"
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U)


def _sliding(pick: np.ufunc, values: np.ndarray, n: int) -> np.ndarray:
    """pick over each stretch of n values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        values = pick(values[: len(values) - step], values[step:])
        size += step
    return values


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, place, right) of the windows of at least ``least`` values, both ends within.

    A subsequence in which the least value stands in several places belongs to the window of the first of them.  Windows
    that are alike in all values less than ``least`` away from their places are one.
    """
    n = len(values)
    if n < least:
        return []
    # a place has a window if its value is the least of a stretch of ``least`` values; so have the places that bound this window
    low = _sliding(np.minimum, values, least)
    high = _sliding(np.maximum, np.concatenate((np.repeat(low[:1], least - 1), low, np.repeat(low[-1:], least - 1))), least)
    places = np.flatnonzero(high == values)
    at, value = places.tolist(), values[places].tolist()
    left, right = [0] * len(at), [n - 1] * len(at)
    bounds: list[int] = []
    for i, (p, v) in enumerate(zip(at, value, strict=True)):
        while bounds and value[bounds[-1]] > v:
            right[bounds.pop()] = p - 1
        if bounds:
            left[i] = at[bounds[-1]] + 1
        bounds.append(i)
    found = list(zip(left, at, right, strict=True))
    if len(set(value)) == len(value):
        return found
    long = np.array([x for x in found if x[2] - x[0] + 1 >= least])
    place = long[:, 1]
    lo, hi = np.maximum(long[:, 0], place - least + 1), np.minimum(long[:, 2], place + least - 1) + 1
    up, down = powers(n + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(values * up[:n])))
    around = (total[hi] - total[lo]) * down[lo]
    unlike: dict[tuple, tuple[int, int, int]] = {}
    for *key, x in zip(values[place].tolist(), (place - lo).tolist(), (hi - place).tolist(), around.tolist(), long.tolist(), strict=True):
        unlike.setdefault(tuple(key), tuple(x))
    return list(unlike.values())


#: key holds the number of its hash function in the low three bits; before and after: values to the left and right of the place.
_MADE = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])
_ROW = "doc_id long, key long, place int, before int, after int"


def _windows(shingle: int, passage: int, hashes: int):
    least = passage - shingle + 1

    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words = Words(data, offsets)
        at, own = words.shingles(shingle)
        first = np.searchsorted(words.row[at], np.arange(len(batch) + 1))
        made = []
        for turn in range(hashes):
            values = mix(own ^ _SEEDS[turn])
            rows, spans = [], []
            for k in np.flatnonzero(np.diff(first) >= least).tolist():
                found = compact_windows(values[first[k] : first[k + 1]], least)
                spans += found
                rows += [k] * len(found)
            rows, spans = np.array(rows, np.int64), np.array(spans, np.int32).reshape(-1, 3)
            made.append((rows, spans, (mix(values[first[rows] + spans[:, 1]]) & ~U(7)) | U(turn)))
        rows, spans, keys = (np.concatenate(x) for x in zip(*made, strict=True))
        keys = keys.view(np.int64)
        ids = batch.column("doc_id").take(pa.array(rows))
        return pa.RecordBatch.from_arrays([ids, pa.array(keys), *[pa.array(x, pa.int32()) for x in (spans[:, 1], spans[:, 1] - spans[:, 0], spans[:, 2] - spans[:, 1])]], schema=_MADE)

    return lambda batches: by_slice(make, batches)


def _regions(hit: np.ndarray, miss: int) -> list[tuple[int, int]]:
    """Maximal regions (both ends within) of a hit sequence in which 1 for a hit and -miss for a miss sum highest (Ruzzo-Tompa)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    kept: list[list[int]] = []  # start, end, sum before, sum after
    total = last = 0
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        before = total - miss * (s - last)
        total, last = before + (e - s), e
        one = [s, e - 1, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= one[2]:
                j -= 1
            if j < 0 or kept[j][3] >= one[3]:
                kept.append(one)
                break
            one = [kept[j][0], one[1], kept[j][2], one[3]]
            del kept[j:]
    return [(s, e) for s, e, _, _ in kept]


def _multiset(a: np.ndarray, b: np.ndarray, rest: int) -> float:
    """Weighted Jaccard likeness of two arrays of small numbers as multisets; rest: how many more the first has that the second cannot hold."""
    shared = 0
    if len(a) and len(b):
        low = min(int(a.min()), int(b.min()))
        x, y = np.bincount(a - low), np.bincount(b - low)
        n = min(len(x), len(y))
        shared = int(np.minimum(x[:n], y[:n]).sum())
    return shared / max(1, len(a) + rest + len(b) - shared)


def _verbatim(own: np.ndarray, other: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, shift) of the longest runs of own whose every stretch of ``least`` values is in other too, at one shift a run."""
    made = []
    for values in (own, other):
        total, mixed = np.zeros(len(values) - least + 1, U), mix(values)
        for k in range(least):
            total *= _SEEDS[0]
            total += mixed[k : k + len(total)]
        made.append(total)
    a, b = made
    order = np.argsort(b, kind="stable")
    at = order[np.minimum(np.searchsorted(b[order], a), len(b) - 1)]
    same = np.flatnonzero(b[at] == a)
    if not len(same):
        return []
    shift = at[same] - same
    ends = np.flatnonzero(np.append((np.diff(same) > 1) | (np.diff(shift) != 0), True))
    return [(int(same[x]), int(same[y]) + least - 1, int(shift[y])) for x, y in zip(np.append(0, ends[:-1] + 1), ends, strict=True)]


def _followed(own: np.ndarray, other: np.ndarray, place: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The shift of each hit; a shingle that stands in several places is read where the hit after or before it is."""
    shift, met = (place - np.arange(len(own))).tolist(), hit.tolist()
    for turn in (range(len(own) - 2, -1, -1), range(1, len(own))):
        step = 1 if turn.step < 0 else -1
        for i in turn:
            if met[i] and met[i + step] and shift[i] != shift[i + step]:
                at = i + shift[i + step]
                if 0 <= at < len(other) and other[at] == own[i]:
                    shift[i] = shift[i + step]
    return np.array(shift)


def shared_passages(own: np.ndarray, other: np.ndarray, shingle: int = SHINGLE, passage: int = PASSAGE, at_least: float = LIKENESS) -> list[tuple[int, int, int, int, float]]:
    """(first word, end, first word in other, end, likeness) of passages of own that other has too; from shingle hashes."""
    least = passage - shingle + 1
    if min(len(own), len(other)) < least:
        return []
    order = np.argsort(other, kind="stable")
    ordered = other[order]
    at = np.searchsorted(ordered, own)
    at = np.minimum(at, len(other) - 1)
    place = order[at]
    hit = other[place] == own
    found = []
    shift = place - np.arange(len(own))
    # the first place of each shingle in other stands for it; where none repeats, that of own tells whether a stretch holds it
    first_place = np.empty(len(other), np.int64)
    first_place[order] = order[np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1]), np.arange(len(other)), 0))]
    hits = np.concatenate(([0], np.cumsum(hit)))
    hit_place, hit_shift = place[hit], shift[hit]
    once = len(np.unique(hit_place)) == len(hit_place) and bool((ordered[1:] != ordered[:-1]).all())

    def best(s: int, e: int) -> tuple[float, int, int]:
        """The likest stretch of other, at the shifts of some of the hits (a shingle may stand in several places)."""
        made = []
        i, j = int(hits[s]), int(hits[e + 1])
        sites, shifts = hit_place[i:j], hit_shift[i:j]
        if j > i and shifts[0] == shifts[-1] and (shifts == shifts[0]).all():
            some = [int(shifts[0])]
        else:
            shifts = np.sort(shifts)
            some = sorted({int(shifts[round(q * (j - i - 1))]) for q in (0, 0.25, 0.5, 0.75, 1)})
        for d in some:
            lo, hi = max(0, s + d), min(len(other), e + d + 1)
            if hi <= lo:
                made.append((0.0, lo, hi))
            elif once:
                shared = int(((sites >= lo) & (sites < hi)).sum())
                made.append((shared / max(1, e + 1 - s + hi - lo - shared), lo, hi))
            else:
                made.append((_multiset(sites, first_place[lo:hi], e + 1 - s - (j - i)), lo, hi))
        return max(made)

    # first as long as gaps allow; what isn't alike enough as a whole is parted where misses or a jump of the shift part its hits, ever finer
    todo = [(s, e, 0) for s, e in _regions(hit, 4)]
    runs = exact = None
    while todo:
        s, e, turn = todo.pop()
        if e - s + 1 < least:
            continue
        like, lo, hi = best(s, e)
        if like >= at_least:
            found.append((s, e + shingle, lo, hi + shingle - 1, float(like)))
            continue
        if not turn:
            if exact is None:
                exact, runs = _verbatim(own, other, least), _followed(own, other, place, hit)
            # a run of the verbatim words is a passage whatever stands around it
            found += [(max(x, s), min(y, e) + shingle, max(x, s) + d, min(y, e) + d + shingle, 1.0) for x, y, d in exact if min(y, e) - max(x, s) + 1 >= least]
            todo += [(s + x, s + y, 1) for x, y in _regions(hit[s : e + 1], 8)]
        elif turn <= len(PARTED):
            at = np.flatnonzero(hit[s : e + 1]) + s
            apart = np.maximum(np.diff(at) - 1, np.abs(np.diff(runs[at]))) > PARTED[turn - 1]
            ends = np.flatnonzero(np.append(apart, True))
            todo += [(int(at[x]), int(at[y]), turn + 1) for x, y in zip(np.append(0, ends[:-1] + 1), ends, strict=True)]
    # intervals of the least length with enough shingles in common that no passage holds yet, tested one by one
    need = int(np.ceil(2 * at_least / (1 + at_least) * least - 1e-9))
    count = np.concatenate(([0], np.cumsum(hit)))
    good = (count[least:] - count[:-least] >= need) & hit[: len(hit) - least + 1] & hit[least - 1 :]
    for x, y, *_ in found:
        good[max(0, x) : max(0, y - shingle - least + 2)] = False
    a = 0
    while a < len(good):
        if not good[a]:
            a += 1 + int(np.argmax(good[a + 1 :])) if good[a + 1 :].any() else len(good)
            continue
        like, lo, hi = best(a, a + least - 1)
        if like >= at_least:
            found.append((a, a + least - 1 + shingle, lo, hi + shingle - 1, float(like)))
            # the next one half a passage on, or where the good ones end
            ahead = good[a : a + least // 2 + 1]
            a += max(1, len(ahead) - 1 if ahead.all() else int(np.argmin(ahead)) - 1)
        else:
            a += 1
    whole = [f for f in found if f[4] < 1.0 or exact is None]
    return found if exact is None else whole + [f for f in dict.fromkeys(found) if f[4] == 1.0 and not any(w[0] <= f[0] and f[1] <= w[1] for w in whole)]


_FOUND = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), *[(c, pa.int32()) for c in ("start", "end", "source_start", "source_end")], ("likeness", pa.float64())])


def _verify(shingle: int, passage: int, at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = utf8(batch.column("text_a")), utf8(batch.column("text_b"))
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            out = []
            for i, j in cuts(oa + ob):
                sides = []
                for d, o in ((da, oa), (db, ob)):
                    words = Words(d[o[i] : o[j]], o[i : j + 1] - o[i])
                    at, own = words.shingles(shingle)
                    sides.append((own, np.searchsorted(words.row[at], np.arange(j - i + 1))))
                (sa, fa), (sb, fb) = sides
                for k in range(j - i):
                    out += [(b[i + k], a[i + k], *p) for p in shared_passages(sb[fb[k] : fb[k + 1]], sa[fa[k] : fa[k + 1]], shingle, passage, at_least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def _around(shingle: int, passage: int):
    """(key, n, doc_id, around): a byte for each shingle of a window up to a passage before and after its place; 0 beyond its ends."""
    wide = passage - shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            spots = batch.column("spots")
            ends = spots.offsets.to_numpy()
            parts = spots.flatten()
            key, n, place, before, after = (parts.field(c).to_numpy() for c in ("key", "n", "place", "before", "after"))
            ends = ends - ends[0]
            for i, j in cuts(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, own = words.shingles(shingle)
                value = np.maximum(mix(own ^ _SEEDS[4]) >> U(56), U(1)).astype(np.uint8)
                first = np.searchsorted(words.row[at], np.arange(j - i + 1))
                rows = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                for k in range(0, len(rows), PAIRS):
                    which = rows[k : k + PAIRS]
                    some = ends[i] + k + np.arange(len(which))
                    inside = first[which] + place[some] < first[which + 1]  # rows that repeat a doc_id have other places
                    which, some = which[inside], some[inside]
                    step = np.arange(-wide, wide + 1)
                    spot = first[which][:, None] + place[some][:, None] + step
                    held = (step >= -before[some][:, None]) & (step <= after[some][:, None]) & (spot >= first[which][:, None]) & (spot < first[which + 1][:, None])
                    around = np.where(held, value[np.clip(spot, 0, max(len(value) - 1, 0))], 0) if len(some) else np.zeros((0, len(step)), np.uint8)
                    flat = np.ascontiguousarray(around, np.uint8)
                    at_byte = pa.py_buffer((np.arange(len(some) + 1) * len(step)).astype(np.int32))
                    packed = pa.Array.from_buffers(pa.binary(), len(some), [None, at_byte, pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(n[some]), batch.column("doc_id").slice(i, j - i).take(pa.array(which)), packed], ["key", "n", "doc_id", "around"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles of each interval of half the width x has in common with y, each at its own place or beside it.

    The last column of both is 0, so rows are read one after the other as one sequence and no shingle meets those of another row.
    """
    n, width = x.shape
    x, y = x.ravel(), y.ravel()
    hit = x == y
    hit[1:] |= x[1:] == y[:-1]
    hit[:-1] |= x[:-1] == y[1:]
    hit &= x > 0
    # sums of 1, 2, 4 ... places; those that make up half the width are added
    half = width // 2
    part = hit.astype(np.uint8 if half < 256 else np.int32)
    total, size, done = np.zeros_like(part), 1, 0
    while size <= half:
        if half & size:
            total[: max(0, len(part) - done)] += part[done:]
            done += size
        part, size = part[:-size] + part[size:], 2 * size
    return total.reshape(n, width)[:, :half]


def nearest(group: np.ndarray, doc: np.ndarray, around: np.ndarray, at_least: float, every: bool = False) -> list[tuple[int, int]]:
    """(source, window) indexes: for each window the earlier one of its group, by doc, that is likest before and the one likest after its place.

    Rows are ordered by group and doc.  A pair counts if one interval of half the width of ``around`` and one more that
    holds the place has the shingles that a likeness of at_least needs, each at its own place or beside it.  every: for
    each such interval that these two don't share, or not whole, but an earlier window does, also the likest that does.
    """
    n, width = around.shape
    wide = width // 2
    need = int(np.ceil(2 * at_least / (1 + at_least) * (wide + 1) - 1e-9))
    side = wide // 2
    values = np.arange(256, dtype=U)
    bit = np.where(values > 0, U(1) << (mix(values) >> U(58)), U(0))[np.ascontiguousarray(around.T)]

    def masks(spans: list[tuple[int, int]], beside: int = 0) -> np.ndarray:
        return np.stack([np.bitwise_or.reduce(bit[max(0, lo - beside) : hi + beside], axis=0) for lo, hi in spans])

    sides = [(wide - side, wide), (wide + 1, wide + 1 + side)]
    whole = np.stack([(around[:, lo:hi] > 0).all(axis=1) for lo, hi in sides])
    own, other = masks(sides), ~masks(sides, 1)
    # each interval that holds the place holds BLOCKS neighbours of these blocks before and after it
    long = wide // (BLOCKS + 1)
    blocks = [(wide - k * long, wide - (k - 1) * long) for k in range(BLOCKS, 0, -1)] + [(wide + 1 + (k - 1) * long, wide + 1 + k * long) for k in range(1, BLOCKS + 1)]
    block_own, block_other = masks(blocks), ~masks(blocks, 1)
    beyond = [(around[:, lo:hi] == 0).sum(axis=1, dtype=np.uint8) for lo, hi in blocks]
    missing = wide + 1 - need
    best = np.full((n, wide + 1), -1, np.int64)  # of each interval of a window, by its start: shingles in common * n + n - 1 - source
    padded = np.concatenate((around, np.zeros((n, 1), np.uint8)), axis=1)

    def scored(t: np.ndarray, s: np.ndarray) -> None:
        spans = _shared(padded[t], padded[s])
        some = np.flatnonzero((spans >= need).any(axis=1))
        if not len(some):
            return
        some = some[np.argsort(t[some], kind="stable")]
        spans = spans[some].astype(np.int64)
        rank = np.where(spans >= need, spans * n + (n - 1 - s[some])[:, None], -1)
        head = np.flatnonzero(np.append(True, np.diff(t[some]) > 0))
        at = t[some][head]
        best[at] = np.maximum(best[at], np.maximum.reduceat(rank, head, axis=0))

    def near(t: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Whether BLOCKS neighbouring blocks of t lack few of their shingles in those of s; t may be a column of a table of pairs, s its row."""
        lost = [np.bitwise_count(x[t] & y[s]) + z[t] for x, y, z in zip(block_own, block_other, beyond, strict=True)]
        total = sum(lost[1:BLOCKS], lost[0])
        few = total <= missing
        for k in range(BLOCKS):
            total = total - lost[k] + lost[k + BLOCKS]
            few |= total <= missing
        return few

    waiting, many = [], 0

    def wait(t: np.ndarray, s: np.ndarray, most: int = PAIRS) -> None:
        """Scores the pairs, PAIRS at once, of which the side that lies in the interval lacks few of its shingles in the other's."""
        nonlocal waiting, many
        if len(t):
            some = doc[t] != doc[s]
            some &= np.logical_or.reduce([whole[k][t] & (np.bitwise_count(own[k][t] & other[k][s]) <= missing) for k in (0, 1)])
            waiting.append((t[some], s[some]))
            many += int(some.sum())
        if many >= most:
            t, s = (np.concatenate(x) for x in zip(*waiting, strict=True))
            for i in range(0, len(t), PAIRS):
                scored(t[i : i + PAIRS], s[i : i + PAIRS])
            waiting, many = [], 0

    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    # small groups meet all at once, row by row ahead; a large one as tables of pairs
    small = np.flatnonzero(np.repeat(size <= TABLED, size))
    of = group[small]
    for lag in range(1, TABLED):
        t = np.flatnonzero(of[lag:] == of[:-lag])
        if not len(t):
            break
        t, s = small[t + lag], small[t]
        some = near(t, s)
        wait(t[some], s[some])
    for lo, many_rows in zip(start[size > TABLED].tolist(), size[size > TABLED].tolist(), strict=True):
        rows = max(1, 8 * PAIRS // many_rows)
        for i in range(lo, lo + many_rows, rows):
            t, s = np.arange(i, min(i + rows, lo + many_rows)), np.arange(lo, min(i + rows, lo + many_rows))
            x, y = np.nonzero(near(t[:, None], s[None, :]))
            some = t[x] > s[y]
            wait(t[x[some]], s[y[some]])
    wait(np.zeros(0, np.int64), np.zeros(0, np.int64), 1)
    likest = np.stack([best[:, : wide - side + 1].max(axis=1), best[:, side:].max(axis=1)]) if n else np.zeros((2, 0), np.int64)
    found = [(t, n - 1 - likest[k, t] % n) for k in (0, 1) for t in (np.flatnonzero(likest[k] >= 0),)]
    if every:

        def settle(t: np.ndarray, s: np.ndarray) -> None:
            # what some window shares whole, one that shares it whole must settle
            best[t] = np.where(_shared(padded[t], padded[s]) >= np.where(best[t] // n > wide, wide + 1, need), -1, best[t])

        for t, s in found:
            settle(t, s)
        while len(t := np.flatnonzero((best >= 0).any(axis=1))):
            s = n - 1 - best[t, (best[t] >= 0).argmax(axis=1)] % n
            settle(t, s)
            found.append((t, s))
    return [pair for t, s in found for pair in zip(s.tolist(), t.tolist(), strict=True)]


def _compared(at_least: float):
    """Pairs (a, b) of documents of the blocks (key, i, j), whose rows follow each other."""

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([group.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
        new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
        of, doc = np.cumsum(new), group.column("doc_id").to_numpy()
        around = group.column("around").combine_chunks()
        around = np.frombuffer(b"".join(around.to_pylist()), np.uint8).reshape(len(around), -1)
        order = np.lexsort((doc, of))
        of, doc, around = of[order], doc[order], around[order]
        # equal surroundings of a group: the first stands for all
        hashed = mix((around.astype(U) * mix(np.arange(1, around.shape[1] + 1, dtype=U))).sum(axis=1, dtype=U) ^ mix(of.astype(U)))
        _, first, same = np.unique(hashed, return_index=True, return_inverse=True)
        rep = first[same]
        a, b = doc[rep], doc
        keep = np.sort(first)
        found = nearest(of[keep], doc[keep], around[keep], at_least, every=True)
        if found:
            x, y = np.array(found).T
            a, b = np.append(a, doc[keep][x]), np.append(b, doc[keep][y])
        some = a < b
        if some.any():
            made = np.unique(np.stack([a[some], b[some]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, many = [], None, 0
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            end = tuple(key[-1])
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            if (cut or (last is not None and last != end)) and many + cut >= BLOCK:
                # all groups but the last one are whole
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, many = [batch.slice(cut)], len(batch) - cut
            else:
                held.append(batch)
                many += len(batch)
            last = end
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def repeated_passages(docs: DataFrame, shingle: int = SHINGLE, passage: int = PASSAGE, at_least: float = LIKENESS, hashes: int = HASHES) -> DataFrame:
    """(doc_id, source_id, start, end, source_start, source_end, likeness): the maximal word ranges of a document that a document of smaller id has too."""
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring(F.sha2("text", 256), 1, 32).alias("same"))
    keys = durable(own.select("doc_id", "same").distinct())
    firsts = keys.groupBy("same").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("n")).where("n > 1")
    copies = durable(with_groups(keys, firsts, "same").where("doc_id <> source_id").select("doc_id", "same", "source_id"))
    few = copies.count() <= MOST_BROADCAST_IDS
    texts = own.join(F.broadcast(copies) if few else copies, ["doc_id", "same"], "left_anti").select("doc_id", "text")
    length = F.size(F.split(F.trim(F.col("text"), F.lit(_WHITE)), f"[{_WHITE}]+"))
    whole = own.join(F.broadcast(copies) if few else copies, ["doc_id", "same"]).select("doc_id", "source_id", length.alias("end")).where(F.col("end") >= passage)
    whole = whole.select("doc_id", "source_id", F.lit(0).alias("start"), "end", F.lit(0).alias("source_start"), F.col("end").alias("source_end"), F.lit(1.0).alias("likeness"))
    # dealt once: the groups read all columns, so that they and their windows share one exchange
    made = texts.mapInArrow(_windows(shingle, passage, hashes), _ROW).repartition("key")
    groups = made.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"), F.count("*").cast("int").alias("n"), F.max(F.col("place") + F.col("before") + F.col("after")).alias("most")).where("head <> tail AND most >= 0").select("key", "n")
    spots = made.join(groups, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "n", "place", "before", "after")).alias("spots"))
    spots = durable(spots)
    around = within(texts, spots.select("doc_id")).join(spots, "doc_id").select("doc_id", "text", "spots").mapInArrow(_around(shingle, passage), "key long, n int, doc_id long, around binary")
    around = durable(around)
    # of a group of several blocks, equal surroundings are one window; the others take the document of that one
    many = around.where(F.col("n") > BLOCK).withColumn("hash", F.xxhash64("key", "around"))
    heads = many.groupBy("hash").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    many = durable(with_groups(many.drop("n"), heads, "hash"))
    blocks = many.where("doc_id = head").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    large = many.where("doc_id = head").join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("doc_id", "around"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    large = large.select("key", "doc_id", "around", "own", F.explode(other).alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "around")
    dealt = around.where(F.col("n") <= BLOCK).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "doc_id", "around").unionByName(large)
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(_compared(at_least), "a long, b long").unionByName(many.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    pairs = durable(pairs.distinct())
    some = within(texts, durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    found = (
        pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b").mapInArrow(_verify(shingle, passage, at_least), "doc_id long, source_id long, start int, end int, source_start int, source_end int, likeness double")
    )
    # a passage within another one of its document isn't listed; of equal ones that of the least source is
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "source_id", "source_start", F.desc("source_end"), F.desc("likeness")).rowsBetween(Window.unboundedPreceding, -1)
    return found.unionByName(whole).withColumn("reach", F.max("end").over(before)).where("reach IS NULL OR reach < end").drop("reach")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, text) with the word ranges of ``spans`` taken out."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        texts = []
        for i, j in cuts(offsets):
            own = data[offsets[i] : offsets[j]]
            words = Words(own, offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                lo, hi = words.first[k], words.first[k + 1]
                keep = np.ones(offsets[i + k + 1] - offsets[i + k], bool)
                base = offsets[i + k] - offsets[i]
                for s, e in ((x["start"], x["end"]) for x in spans[i + k]):
                    if lo + s < hi:
                        end = words.start[lo + e] if lo + e < hi else base + len(keep)
                        keep[words.start[lo + s] - base : end - base] = False
                texts.append(own[base : base + len(keep)][keep].tobytes().decode("utf-8", "replace").strip())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("before"), pa.array(texts, pa.string())], ["doc_id", "before", "cut"])


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated passages taken out of all documents but the first; those left without words go.  n_chars, if there, is made anew."""
    spans = repeated_passages(docs, **options).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    # one row a document and text: the cut texts are joined back by both
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id")
    changed = texts.withColumn("before", F.sha2("text", 256)).select("doc_id", "before", "text", "spans").mapInArrow(_cut, "doc_id long, before string, cut string").dropDuplicates(["doc_id", "before"])
    # columns of docs may have any name: each side is read through its alias
    out = docs.alias("d").join(changed.alias("c"), (F.col("d.doc_id").cast("long") == F.col("c.doc_id")) & (F.sha2("d.text", 256) == F.col("c.before")), "left")
    out = out.where("c.cut IS NULL OR c.cut <> ''")
    renewed = {"text": F.coalesce("c.cut", "d.text")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.when(F.col("c.cut").isNull(), F.col("d.n_chars")).otherwise(F.char_length("c.cut").cast(docs.schema["n_chars"].dataType))
    return out.select(*[renewed.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
