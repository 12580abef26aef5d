"""Exact removal of byte strings that occur earlier, by sharded suffix arrays.

A byte goes if a ``SIZE``-byte string that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. Strings are judged on the input.

1. Anchors. Each SIZE-byte string (window) has as its anchor the 24-byte gram with the least hash in it; equal
   windows have equal anchors. Anchors are about 1 in 39 bytes. They are counted over all texts (each chunk of
   text sends a gram once, so a passage in a third of the documents is counted before the shuffle), and a
   window whose anchor is no other window's anchor anywhere else cannot repeat. Most text ends here.
2. Shards. The other windows travel as runs that share an anchor, with the bytes they span, to the shard of
   their anchor hash: equal windows meet, each window in one shard. A chunk sends equal runs once.
3. Per shard, a suffix array by Larsson-Sadakane refinement in numpy (ranks by 7-byte prefixes, doubled
   within the groups that are still unsorted) and common prefixes by Kasai's walk over all runs at once.
   Neighbours with a common prefix of SIZE are equal windows; all but the first are marked.
4. An anchor with more bytes than a shard holds is split into shards of its own by document order, and the
   shards' sorted distinct windows are merged by binary search. One with ``HOT`` places or more, such as a passage that a third of
   all documents share, is too much for a task: its windows travel one by one under 128-bit digests (a chunk sends equal ones
   once), spread over all tasks, and meet in sorted order. There are at most (anchors / HOT) such grams; their list is sent to all.
5. Marked spans return to their documents by (doc_id, text key) and are united.

Exact copies of a document (equal MD5 of the text) are settled at once: all their windows are in the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, U, chunks, distinct_ranges, gram_hashes, partitions, range_hashes, spread, words_at

SIZE, GRAM = 100, 24
REACH = SIZE - GRAM + 1  # anchor places in a window
LANE = 64  # suffixes of a run that are walked in a row
SHARD = 1 << 18  # bytes of a shard: its arrays fit a core's cache
SHARDS = 4  # shards' worth of runs that are read before equal ones go
SEND = 1 << 22  # bytes of text that go out together
HOT = 1 << 19  # places of a gram from which its windows go one by one: about 100 MB of runs
LAST = (1 << 63) - 1
FOUND = "bucket int, kind int, h binary, d binary, p binary, m binary"
RUN = "key long, doc long, own long, start int, bytes binary, kind int"
SPANS = "doc_id long, text_key long, spans binary"
PLACES = "text_key long, spans binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    m, have = x, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have :]) if w > have else m


@dataclass
class Anchors:
    """Of a chunk: hashes of its grams, the least one in each window, which windows lie in one row, and the anchors."""

    grams: np.ndarray
    least: np.ndarray
    whole: np.ndarray

    def positions(self) -> np.ndarray:
        """Grams that are the least of some window."""
        shown = np.zeros(len(self.least) + 2 * (REACH - 1), U)
        shown[REACH - 1 : REACH - 1 + len(self.least)] = np.where(self.whole, self.least, U(0))
        most = ~sliding_min(~shown, REACH)  # the largest minimum among the windows that hold a gram
        return np.flatnonzero(self.grams == most[: len(self.grams)])


def anchors(data: np.ndarray, offsets: np.ndarray) -> Anchors | None:
    n = len(data) - SIZE + 1
    if n <= 0:
        return None
    grams = gram_hashes(data, GRAM)
    whole = np.ones(n, bool)
    for end in offsets[1:-1]:  # a window lies in one row
        whole[max(0, end - SIZE + 1) : end] = False
    return Anchors(grams, sliding_min(grams, REACH), whole)


def room_of(lengths: np.ndarray) -> np.ndarray:
    """For runs laid end to end: how many bytes of its run each position has, itself included."""
    ends = np.cumsum(lengths)
    return np.repeat(ends, lengths) - np.arange(int(ends[-1]) if len(ends) else 0)


def prefix_keys(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The first 7 bytes of each suffix, 9 bits each; the end of a run is below byte 0."""
    out = np.zeros(len(data), U)
    wide = np.concatenate([data, np.zeros(7, np.uint8)]).astype(U)
    wide += U(1)
    for j in range(7):
        out <<= U(9)
        out |= wide[j : len(data) + j] * (room > j)
    return out


def suffix_array(data: np.ndarray, room: np.ndarray, key: np.ndarray | None = None, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes, each up to the end of its run; equal suffixes follow their position.

    With a ``depth``, suffixes that agree on as many bytes may stay in any order: enough to look up strings up to that length.

    Larsson-Sadakane: suffixes are sorted by 7 bytes; then only groups that are still unsorted are sorted
    again, by the rank of the suffix that starts where the known prefix ends, which doubles it.
    """
    n = len(data)
    key = prefix_keys(data, room) if key is None else key
    known = 7
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    slot = np.arange(n)
    group = np.maximum.accumulate(np.where(fresh, slot, 0))
    if depth is None:
        tails = np.flatnonzero(room[order] < known)  # a group holds such tails alone or none
        at = order[tails]
        order[tails] = at[np.lexsort((at, group[tails]))]
        group[tails] = tails
    rank = np.empty(n, np.int64)
    rank[order] = group
    open_ = np.append(group[1:] == group[:-1], False)
    open_[1:] |= open_[:-1].copy()
    open_ = np.flatnonzero(open_)
    if depth is not None:
        open_ = open_[room[order[open_]] >= known]  # tails of one group are equal to their end
    while len(open_) and (depth is None or known < depth):
        at = order[open_]
        # a suffix that ends here comes first, equal ones by position
        rest = np.where(room[at] > known, rank[np.minimum(at + known, n - 1)], at - n)
        key2 = rank[at] * np.int64(2 * n) + rest
        by = np.argsort(key2)
        at, key2 = at[by], key2[by]
        order[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key2[1:] != key2[:-1]
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        known *= 2
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
    return order, rank


def kasai(data: np.ndarray, room: np.ndarray, before: np.ndarray, starts: np.ndarray, counts: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to ``cap``, of each listed suffix with the one before it in suffix order.

    ``before[i]``: the predecessor of suffix i, or -1. ``counts`` suffixes from each of ``starts``: Kasai's walk
    goes through all runs in step (long ones in pieces of LANE); a suffix shares at least one byte less than the
    one to its left did, and what comes beyond is compared 8 bytes at a time.
    """
    pieces = -(-counts // LANE)
    nth = spread(np.zeros(len(counts), np.int64), pieces)
    starts, counts = np.repeat(starts, pieces) + nth * LANE, np.minimum(np.repeat(counts, pieces) - nth * LANE, LANE)
    out = np.zeros(len(before), np.int32)
    words = np.array(words_at(data))
    left = np.zeros(len(starts), np.int64)
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    for t in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -t, "left"))
        i = starts[:live] + t
        j = before[i]
        most = np.where(j >= 0, np.minimum(np.minimum(room[i], room[j]), cap), 0)
        have = np.where(j >= 0, np.maximum(left[:live] - 1, 0), 0)
        go = np.flatnonzero(have < most)
        while len(go):
            x, y = i[go] + have[go], j[go] + have[go]
            differ = words[x] ^ words[y]
            # equal low bytes of the two words: trailing zero bits of their difference, 8 a byte
            low = differ & (~differ + U(1))
            equal = np.where(differ == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) // 8)
            have[go] = np.minimum(have[go] + equal, most[go])
            go = go[(equal == 8) & (have[go] < most[go])]
        left[:live] = have
        out[i] = have
    return out


def first_windows(data: np.ndarray, begin: np.ndarray, counts: np.ndarray, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window positions in suffix order, place of the earliest equal window of each).

    Runs begin at ``begin`` with ``counts`` windows; ``rank_of`` gives the place of every window position in
    corpus order.
    """
    room = room_of(counts + SIZE - 1)
    order, _ = suffix_array(data, room)
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    common = kasai(data, room, before, begin, counts, SIZE)
    order = order[room[order] >= SIZE]
    # suffixes between two equal windows have the same prefix and are windows too
    heads = np.flatnonzero(common[order] < SIZE)
    low = np.minimum.reduceat(rank_of[order], heads)
    return order, np.repeat(low, np.diff(np.append(heads, len(order))))


def _find(n_buckets: int):
    """Anchors of a chunk of texts: each gram's first place with the number of its places in the chunk; the other places directly.

    A place is a text key and a position, so copies of a text count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("text_key").to_numpy()
            h, d, p = [], [], []
            size = 0
            for lo, hi, data, offsets in chunks(batch.column("text")):
                got = anchors(data, offsets)
                if got is not None:
                    at = got.positions()
                    row = np.searchsorted(offsets, at, "right") - 1
                    h.append(got.grams[at])
                    d.append(ids[lo:hi][row])
                    p.append((at - offsets[row]).astype(np.int32))
                size += len(data)
                if size >= SEND:
                    yield from _send(h, d, p, n_buckets)
                    h, d, p, size = [], [], [], 0
            yield from _send(h, d, p, n_buckets)

    return run


def _send(h: list, d: list, p: list, n_buckets: int) -> Iterator[pa.RecordBatch]:
    if not h:
        return
    h, d, p = np.concatenate(h), np.concatenate(d), np.concatenate(p)
    by = np.lexsort((p, d, h))
    h, d, p = h[by], d[by], p[by]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1]))
    h, d, p = h[new], d[new], p[new]
    first = np.append(True, h[1:] != h[:-1])
    many = np.diff(np.append(np.flatnonzero(first), len(h))).astype(np.int32)
    repeated = ~first | np.repeat(many > 1, many)
    rows: list[tuple] = []
    b = (h[first] % U(n_buckets)).astype(np.int64)
    o = np.argsort(b, kind="stable")
    fh, fd, fp, fm, b = h[first][o], d[first][o], p[first][o], many[o], b[o]
    cut = np.searchsorted(b, np.arange(n_buckets + 1))
    for k in range(n_buckets):
        x, y = cut[k], cut[k + 1]
        if x < y:
            rows.append((k, 0, fh[x:y].tobytes(), fd[x:y].tobytes(), fp[x:y].tobytes(), fm[x:y].tobytes()))
    if repeated.any():
        o = np.lexsort((p[repeated], d[repeated]))
        rows.append((int(d[repeated][o][0] % n_buckets), 1, b"", d[repeated][o].tobytes(), p[repeated][o].tobytes(), b""))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["bucket", "kind", "h", "d", "p", "m"])


def _by_doc(d: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(d):
        return
    o = np.lexsort((p, d))
    d, p = d[o], p[o]
    cut = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d))
    yield pa.RecordBatch.from_arrays([pa.array(d[cut[:-1]]), pa.array([p[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["text_key", "spans"])


def _repeated(hot: int):
    """Of a partition's anchors, those whose gram occurs at two places or more: positions by text; and as rows without positions
    the grams with ``hot`` places or more."""
    return lambda batches: _repeated_of(batches, hot)


def _repeated_of(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    h, d, p, m = [], [], [], []
    for batch in batches:
        for kind, a, b, c, e in zip(*(batch.column(n).to_pylist() for n in ("kind", "h", "d", "p", "m"))):
            if kind == 1:
                yield from _by_doc(np.frombuffer(b, np.int64), np.frombuffer(c, np.int32))
            else:
                h.append(np.frombuffer(a, U))
                d.append(np.frombuffer(b, np.int64))
                p.append(np.frombuffer(c, np.int32))
                m.append(np.frombuffer(e, np.int32))
    if h:
        h, d, p, m = np.concatenate(h), np.concatenate(d), np.concatenate(p), np.concatenate(m)
        o = np.argsort(h)
        keep = np.append(False, h[o][1:] == h[o][:-1])
        keep[:-1] |= keep[1:]
        keep |= m[o] > 1  # most grams are alone and go before the places are compared
        o = o[keep]
        o = o[np.lexsort((p[o], d[o], h[o]))]
        h, d, p, m = h[o], d[o], p[o], m[o]
        same = np.append(False, (h[1:] == h[:-1]) & (d[1:] == d[:-1]) & (p[1:] == p[:-1]))
        m = m.astype(np.int64)
        if same.any():  # a copy of the text in another chunk; its count is the same or more
            at = np.flatnonzero(~same)
            m = np.maximum.reduceat(m, at)
            h, d, p = h[at], d[at], p[at]
        if not len(h):
            return
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        twice = np.bincount(group) > 1
        places = np.bincount(group, weights=m)
        keep = twice[group] | (places > 1)[group]
        yield from _by_doc(d[keep], p[keep])
        often = h[new][places >= hot].view(np.int64)
        if len(often):
            yield pa.RecordBatch.from_arrays([pa.array(often), pa.nulls(len(often), pa.binary())], names=["text_key", "spans"])


def _ranks(doc: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in corpus order, by (doc_id, text_key): (rank of each entry, doc_id and text_key of each rank)."""
    by = np.lexsort((own, doc))
    new = np.append(True, (doc[by][1:] != doc[by][:-1]) | (own[by][1:] != own[by][:-1]))[: len(by)]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    return rank, doc[by][new], own[by][new]


def _runs(hot: np.ndarray):
    """Runs of windows whose anchor repeats, with their bytes; a chunk's later equal runs as spans at once. Those of hot anchors as
    single windows. ``hot`` is sorted."""
    return lambda batches: _runs_of(batches, hot)


def _rows(key, doc, own, start, texts, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(own), pa.array(start.astype(np.int32)), pa.array(texts, pa.binary()), pa.array(np.full(len(key), kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32))], names=["key", "doc", "own", "start", "bytes", "kind"])


def _single_windows(data: np.ndarray, at: np.ndarray, doc: np.ndarray, own: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows at positions of a chunk under their digests: the earliest of equal ones; the others as spans."""
    h1, h2 = (range_hashes(data, at, at + SIZE, salt=x) for x in (1, 2))
    o = np.lexsort((place, own, doc, h2, h1))
    h1, h2, doc, own, place = h1[o], h2[o], doc[o], own[o], place[o]
    first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    later = ~first & ((doc != doc[head]) | (own != own[head]) | (place != place[head]))
    yield _rows(h1[first].view(np.int64), doc[first], own[first], place[first], [x.tobytes() for x in h2[first]], 2)
    if later.any():
        # windows that follow each other make one span
        o = np.lexsort((place[later], own[later], doc[later]))
        doc, own, place = doc[later][o], own[later][o], place[later][o].astype(np.int64)
        new = np.append(True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (place[1:] > place[:-1] + 1))
        last = place[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)]
        yield _rows(doc[new], doc[new], own[new], place[new], [int(b - a + SIZE).to_bytes(4, "little") for a, b in zip(place[new], last)], 1)


def _runs_of(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
        spans = batch.column("spans").to_pylist()
        for lo, hi, data, offsets in chunks(batch.column("text")):
            n = len(data) - SIZE + 1
            if n <= 0:
                continue
            # two texts with one key would have each other's places: those beyond the text are left out
            known = [np.frombuffer(x, np.int32) + offsets[i - lo] for i in range(lo, hi) for x in spans[i] or ()]
            if not known:
                continue
            got = anchors(data, offsets)
            least, whole = got.least, got.whole
            new = whole.copy()
            new[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
            known = np.concatenate(known)
            seen = np.unique(got.grams[known[known < len(got.grams)]])
            if not len(seen):
                continue
            first = np.flatnonzero(new)
            low = least[first]
            useful = seen[np.minimum(np.searchsorted(seen, low), len(seen) - 1)] == low
            good = whole & useful[np.cumsum(new) - 1] if len(first) else whole
            new &= good
            start = first[useful]
            if not len(start):
                continue
            tail = good.copy()
            tail[:-1] &= ~good[1:] | new[1:]
            end = np.flatnonzero(tail) + SIZE
            row = np.searchsorted(offsets, start, "right") - 1
            key, doc, own, place = least[start].view(np.int64), ids[lo:hi][row], keys[lo:hi][row], (start - offsets[row]).astype(np.int32)
            if len(hot):
                often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                if often.any():
                    n_windows = (end - start - SIZE + 1)[often]
                    at, row_of = spread(start[often], n_windows), np.repeat(row[often], n_windows)
                    yield from _single_windows(data, at, ids[lo:hi][row_of], keys[lo:hi][row_of], at - offsets[row_of])
                    start, end, key, doc, own, place = (x[~often] for x in (start, end, key, doc, own, place))
                    if not len(start):
                        continue
            # equal runs of this chunk: the earliest goes on, the others are known to repeat
            _, body, _ = distinct_ranges(data, start, end)
            o = np.lexsort((place, own, doc, body))
            later = np.zeros(len(o), bool)
            later[o[1:]] = (body[o][1:] == body[o][:-1]) & ((doc[o][1:] != doc[o][:-1]) | (own[o][1:] != own[o][:-1]) | (place[o][1:] != place[o][:-1]))
            raw = data.tobytes()
            texts = [raw[s:e] if not x else int(e - s).to_bytes(4, "little") for s, e, x in zip(start.tolist(), end.tolist(), later)]
            yield _rows(np.where(later, doc, key), doc, own, place, texts, later)


def _mark(key: np.ndarray, doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the windows of a shard that occur earlier in it, as spans; ``doc`` is the rank of a document.

    Of equal runs the earliest is indexed, the others repeat whole. An anchor with one distinct run has nothing
    to compare, unless its gram occurs twice in the run (periodic text).
    """
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    _, body, _ = distinct_ranges(data, begin, begin + size)
    by = np.lexsort((start, doc, body))
    twin = np.append(False, body[by][1:] == body[by][:-1])
    head = by[np.maximum.accumulate(np.where(twin, 0, np.arange(len(by))))]
    later = by[twin & ((doc[by] != doc[head]) | (start[by] != start[head]))]
    out = [(doc[later], start[later].astype(np.int64), start[later] + size[later])]
    left = np.sort(by[~twin])
    grams = gram_hashes(data, GRAM)
    inside = np.repeat(np.arange(len(texts)), size)[: len(grams)]
    own = np.bincount(inside[grams == np.repeat(key.view(U), size)[: len(grams)]], minlength=len(texts))
    _, group = np.unique(key[left], return_inverse=True)
    left = left[(np.bincount(group)[group] > 1) | (own[left] > 1)]
    left = left[np.argsort(key[left], kind="stable")]
    new = np.append(True, key[left][1:] != key[left][:-1])[: len(left)]
    total = np.cumsum(size[left])
    cut, last = [0], 0
    for i in np.flatnonzero(new)[1:]:  # shards end where an anchor does
        if total[i - 1] - last >= SHARD:
            cut.append(int(i))
            last = total[i - 1]
    for a, b in zip(cut, [*cut[1:], len(left)]):
        if a < b:
            out.append(_compared(doc[left[a:b]], start[left[a:b]], [texts[i] for i in left[a:b]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _compared(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((start, doc))
    at = np.empty(len(by), np.int64)
    at[by] = np.cumsum(np.append(False, (doc[by][1:] != doc[by][:-1]) | (start[by][1:] != start[by][:-1])))
    size = np.array([len(t) for t in texts])
    counts = size - SIZE + 1
    width = int(counts.max()) + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    if len(data) <= 2 * SHARD or len(texts) == 1:
        pos = spread(begin, counts)
        rank_of = np.zeros(len(data), np.int64)
        rank_of[pos] = np.repeat(at * width, counts) + pos - np.repeat(begin, counts)
        order, low = first_windows(data, begin, counts, rank_of)
        gone = np.zeros(len(data), bool)
        gone[order] = rank_of[order] != low
    else:
        gone = _merged(data, begin, counts, at, width)
    run = np.repeat(np.arange(len(texts)), size)
    head = gone.copy()
    head[1:] &= ~gone[:-1] | (run[1:] != run[:-1])
    tail = gone.copy()
    tail[:-1] &= ~gone[1:] | (run[1:] != run[:-1])
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    r = run[a]
    return doc[r], start[r] + a - begin[r], start[r] + b - begin[r] + SIZE


def _merged(data: np.ndarray, begin: np.ndarray, counts: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Marks of one anchor's runs in shards by corpus order: each shard's windows are looked up in those before."""
    gone = np.zeros(len(data), bool)
    by = np.argsort(at, kind="stable")
    size = counts + SIZE - 1
    part = np.cumsum(size[by]) // SHARD
    part = part[np.searchsorted(at[by], at[by], "left")]  # repeated rows of one place stay together
    seen: list[np.ndarray] = []
    windows = np.lib.stride_tricks.sliding_window_view(data, SIZE)
    for k in np.unique(part):
        own = by[part == k]
        local = np.concatenate([data[begin[r] : begin[r] + size[r]] for r in own])
        first = np.cumsum(size[own]) - size[own]
        pos = spread(first, counts[own])
        back = pos - np.repeat(first, counts[own]) + np.repeat(begin[own], counts[own])
        rank_of, to = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        rank_of[pos] = np.repeat(at[own] * width, counts[own]) + pos - np.repeat(first, counts[own])
        to[pos] = back
        order, low = first_windows(local, first, counts[own], rank_of)
        gone[to[order[rank_of[order] != low]]] = True
        rows = np.concatenate([windows[to[order]], np.ones((len(order), 1), np.uint8)], axis=1)  # the last byte keeps trailing zeros
        names = np.ascontiguousarray(rows).view(f"S{SIZE + 1}").ravel()
        for old in seen:
            i = np.minimum(np.searchsorted(old, names), len(old) - 1)
            gone[to[order[old[i] == names]]] = True
        seen.append(np.unique(names))
    return gone


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in key order: shards are cut at anchor borders. Single windows in order of key, then of the corpus: of equal ones all but
    the first are marked."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    open_: tuple = (None, {})  # the last key of single windows, and the place of each digest under it

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held)
            key, doc, own, start = (rows.column(c).to_numpy() for c in ("key", "doc", "own", "start"))
            rank, docs, owns = _ranks(doc, own)
            r, a, b = _mark(key, rank, start, rows.column("bytes").to_pylist())
            yield from _spans(r, a, b, docs, owns)

    for batch in batches:
        settled = batch.filter(pc.equal(batch.column("kind"), 1))
        if settled.num_rows:
            a = settled.column("start").to_numpy().astype(np.int64)
            n = np.frombuffer(b"".join(settled.column("bytes").to_pylist()), "<u4")
            rank, docs, owns = _ranks(settled.column("doc").to_numpy(), settled.column("own").to_numpy())
            yield from _spans(rank, a, a + n, docs, owns)
        single = batch.filter(pc.equal(batch.column("kind"), 2))
        if single.num_rows:
            key, doc, own, start = (single.column(c).to_numpy() for c in ("key", "doc", "own", "start"))
            digest = np.frombuffer(b"".join(single.column("bytes").to_pylist()), np.int64)
            o = np.lexsort((np.arange(len(key)), digest, key))
            key, doc, own, start, digest = key[o], doc[o], own[o], start[o].astype(np.int64), digest[o]
            first = np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]))
            head = np.flatnonzero(first)
            place = np.stack([doc[head], own[head], start[head]])
            known = [open_[1].get(int(x)) if k == open_[0] else None for k, x in zip(key[head].tolist(), digest[head].tolist())] if open_[0] is not None and (key == open_[0]).any() else None
            for i, x in enumerate(known or ()):
                if x is not None:
                    place[:, i] = x
            group = np.cumsum(first) - 1
            later = (doc != place[0][group]) | (own != place[1][group]) | (start != place[2][group])
            end_key = single.column("key")[-1].as_py()
            mine = np.flatnonzero(key[head] == end_key)
            fresh = {int(digest[head[i]]): tuple(place[:, i].tolist()) for i in mine}
            open_ = (end_key, open_[1] | fresh if end_key == open_[0] else fresh)
            if later.any():
                rank, docs, owns = _ranks(doc[later], own[later])
                yield from _spans(rank, start[later], start[later] + SIZE, docs, owns)
        batch = batch.filter(pc.equal(batch.column("kind"), 0))
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        total = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())
        lo = 0
        for i in [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]:  # an anchor begins here
            have = size + (total[i - 1] if i else 0) - (total[lo - 1] if lo else 0)
            if have >= SHARDS * SHARD and key[i] != (key[i - 1] if i else last):
                held.append(batch.slice(lo, i - lo))
                yield from flush()
                held, size, lo = [], 0, i
        held.append(batch.slice(lo))
        size += int(total[-1] - (total[lo - 1] if lo else 0))
        last = key[-1]
    yield from flush()


def _spans(rank: np.ndarray, a: np.ndarray, b: np.ndarray, docs: np.ndarray, owns: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(rank):
        return
    o = np.lexsort((a, rank))
    rank, both = rank[o], np.stack([a[o], b[o]], axis=1).astype(np.int32)
    cut = np.append(np.flatnonzero(np.append(True, rank[1:] != rank[:-1])), len(rank))
    own = rank[cut[:-1]]
    yield pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array(owns[own]), pa.array([both[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "text_key", "spans"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans, copy in zip(*(batch.column(n).to_pylist() for n in ("text", "spans", "copy"))):
            raw = text.encode()
            rest, removed, n_spans = raw, 0, 0
            if copy and len(raw) >= SIZE:
                rest, removed, n_spans = b"", len(raw), 1
            elif spans:
                s = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in spans])
                s = s[np.argsort(s[:, 0], kind="stable")]
                reach = np.maximum.accumulate(s[:, 1])
                new = np.append(True, s[1:, 0] > reach[:-1])
                a, b = s[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                kept, last = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.append(raw[last:x])
                    last = y
                rest = b"".join([*kept, raw[last:]])
                removed, n_spans = int((b - a).sum()), len(a)
            out.append((len(raw), removed, n_spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        n = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())]
        kept = pc.if_else(batch.column("absent"), None, n.pop())
        rest = [c for c in batch.schema.names if c.startswith("carry_")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, kept, batch.column("text_key"), *[batch.column(c) for c in rest]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text_key", *rest])


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, text_key, and the columns to carry
    under ``carry_<name>``.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty, its kept_text null. Documents under SIZE
    bytes lose nothing. Documents are told apart and ordered by (doc_id, hash of the text): two texts under one id are two
    documents; repeated rows of one id with one text are the same document and have equal results. Null ids come after all
    others. kept_text drops bytes of a character that was cut; kept_sha256 is of the exact bytes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark), partitions(spark)
    carried = [F.col(c).alias(f"carry_{c}") for c in carry or []]
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("text").isNull().alias("absent"), *carried)
    base = base.withColumn("text_key", F.xxhash64("text"))
    names = scratch.cut(base.select("doc_id", "text_key", F.md5(F.col("text").cast("binary")).alias("md5")))
    firsts = scratch.cut(names.groupBy("md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("text_key").alias("text_key")))
    copies = names.join(firsts.where("first != last").select("md5", "first"), "md5").where("doc_id != first").select("doc_id", "text_key").distinct()
    # one exchange for both passes: left joins alone and all columns in both, so that nothing is pushed below it in one of them
    texts = base.repartition("doc_id", "text_key")
    found = scratch.cut(base.select("text_key", "text").mapInArrow(_find(4 * n), FOUND).repartition(n, "bucket").mapInArrow(_repeated(HOT), PLACES))
    hot = np.array(sorted(r.text_key for r in found.where("spans is null").collect()), np.int64)  # anchors / HOT at most
    places = found.where("spans is not null").groupBy("text_key").agg(F.collect_list("spans").alias("spans"))  # an entry per partition and chunk
    places = places.join(firsts, "text_key").groupBy(F.col("first").alias("doc_id"), "text_key").agg(F.first("spans").alias("spans"))
    runs = texts.join(places, ["doc_id", "text_key"], "left").select(*texts.columns, "spans").mapInArrow(_runs(hot), RUN)
    spans = runs.repartition(n, "key").sortWithinPartitions("key", "doc", "own", "start").mapInArrow(_shards, SPANS)
    # spans and copy marks come together, so that the texts are joined once
    marks = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "text_key", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("copy")))
    gone = marks.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"), F.max("copy").alias("copy"))
    whole = texts.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"), "absent", "text_key", *[F.col(f"carry_{c}") for c in carry or []])
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in whole.schema.fields if f.name.startswith("carry_"))
    out = whole.mapInArrow(_finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, text_key long{extra}")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
