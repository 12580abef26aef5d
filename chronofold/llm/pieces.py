"""SentencePiece encoding and decoding by suffix-array matching.

For a BPE model with byte fallback, identity normalisation and a dummy prefix. A batch of texts is cut into words
(no piece goes on past the start of a word); the distinct words are concatenated and indexed by a suffix array. Every
piece of the vocabulary is looked up by binary search: its range of suffixes are its occurrences, the edges. Edges
are sorted by position and relaxed: from single characters on, the edge of least rank that joins two neighbouring
symbols of a word is taken, leftmost among equals, until none joins any. Characters that no piece covers become bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import chunks, distinct_ranges, spread
from chronofold.llm.suffix import prefix_keys, room_of, suffix_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
BATCH = 1 << 20  # bytes of text that are indexed together: bounds a worker's memory
LONG = 48  # characters of a word from which it is relaxed with a heap
KEY = 7  # bytes of a search key, as in prefix_keys
WIDE = 16  # lengths of pieces that are looked up by position


@dataclass(frozen=True)
class Vocabulary:
    text: tuple[bytes, ...]  # of each id; byte pieces as their byte, control pieces empty
    rank: np.ndarray  # order of merges, by id
    byte_id: np.ndarray  # id of each byte's piece
    normal: np.ndarray  # ids that can match text, in byte order of their text


@lru_cache(2)
def load(path: str | bytes) -> Vocabulary:
    """Vocabulary of a model file, given by its path or its bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(**{"model_proto" if isinstance(path, bytes) else "model_file": path})
    text, byte_id, normal = [], np.zeros(256, np.int32), []
    scores = np.array([sp.get_score(i) for i in range(sp.get_piece_size())])
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            byte_id[value] = i
            text.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            text.append(b"")
        else:
            text.append(piece.encode())
            normal.append(i)
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
    return Vocabulary(tuple(text), rank, byte_id, np.array(sorted(normal, key=lambda i: text[i]), np.int32))


@lru_cache(2)
def _piece_keys(path: str | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower keys, upper keys, lengths) of the normal pieces, one row per KEY bytes."""
    v = load(path)
    texts = [v.text[i] for i in v.normal]
    length = np.array([len(t) for t in texts])
    rows = -(-int(length.max()) // KEY)
    lower, upper = np.zeros((rows, len(texts)), np.uint64), np.zeros((rows, len(texts)), np.uint64)
    for n, t in enumerate(texts):
        for r in range(rows):
            lo = hi = 0
            for j in range(r * KEY, r * KEY + KEY):
                lo = lo << 9 | (t[j] + 1 if j < len(t) else 0)
                hi = hi << 9 | (t[j] + 1 if j < len(t) else 511)
            lower[r, n], upper[r, n] = lo, hi
    return lower, upper, length


class Edges:
    """Occurrences of pieces by position: the id of the piece of each length from 1 to WIDE at every byte, ``none`` if there is none.

    This is the list of edges sorted by position (a counting sort); the few longer ones are kept in a sorted list.
    """

    def __init__(self, n: int, start: np.ndarray, length: np.ndarray, ids: np.ndarray, rank: np.ndarray):
        self.none = len(rank)
        self.rank = np.append(rank, np.iinfo(np.int32).max).astype(np.int32)
        self.table = np.full(n * WIDE, self.none, np.uint16 if self.none < 1 << 16 else np.int32)
        near = length <= WIDE
        self.table[start[near] * WIDE + length[near] - 1] = ids[near]
        far = np.flatnonzero(~near)
        key = start[far] << 20 | length[far]
        by = np.argsort(key)
        self.far, self.far_id = key[by], ids[far][by]

    def id_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = self.table[start * WIDE + np.minimum(size, WIDE) - 1].astype(np.int32)
        long = np.flatnonzero(size > WIDE)
        if len(long):
            out[long] = self.none
            if len(self.far):
                long = long[size[long] < 1 << 20]
                key = start[long].astype(np.int64) << 20 | size[long]
                i = np.minimum(np.searchsorted(self.far, key), len(self.far) - 1)
                hit = self.far[i] == key
                out[long[hit]] = self.far_id[i[hit]]
        return out

    def cost(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.rank[self.id_of(start, end)]


def occurrences(data: np.ndarray, room: np.ndarray, path: str | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, length, id) of every piece in the words, by piece."""
    v = load(path)
    lower, upper, length = _piece_keys(path)
    keys = prefix_keys(data, room)
    order, _ = suffix_array(data, room, keys, int(length.max()))
    n = len(data)

    def search(bound: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), n, np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) // 2
            at = order[mid]
            left = room[at]
            less, tied = np.zeros(len(live), bool), np.ones(len(live), bool)
            for r in range(len(bound)):
                k = np.flatnonzero(tied)
                if not len(k) or (r and not (length[live[k]] > r * KEY).any()):
                    break
                k = k[length[live[k]] > r * KEY] if r else k
                inside = left[k] > r * KEY
                mine = np.where(inside, keys[np.minimum(at[k] + r * KEY, n - 1)], np.uint64(0))
                other = bound[r, live[k]]
                less[k] = mine < other
                tied[k] = mine == other
            go = less | (tied if right else np.zeros(len(live), bool))
            lo[live[go]] = mid[go] + 1
            hi[live[~go]] = mid[~go]

    first, last = search(lower, False), search(upper, True)
    many = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(length)), many)
    return order[spread(first, many)], length[which], v.normal[which]


def relax(starts: np.ndarray, ends: np.ndarray, word: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, end) after all merges, by position. Input symbols are characters, in order."""
    none = np.iinfo(np.int32).max
    size_of = np.bincount(word) if len(word) else np.zeros(0, np.int64)
    long = size_of[word] > LONG
    final = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)  # by start: the end of the symbol that starts there
    for w in np.unique(word[long]):
        k = slice(*np.searchsorted(word, [w, w + 1]))
        s, e = _relax_long(starts[k], ends[k], edges)
        final[s] = e
    s, e, w = (x[~long].astype(np.int32) for x in (starts, ends, word))
    price = np.full(len(s), none, np.int32)
    pair = np.flatnonzero(w[1:] == w[:-1])
    price[pair] = edges.cost(s[pair].astype(np.int64), e[pair + 1])
    while len(s):
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        least = np.minimum.reduceat(price, head)
        size = np.diff(np.append(head, len(s)))
        done = least == none
        if done.any():
            shut = np.repeat(done, size)
            final[s[shut]] = e[shut]
            go = ~shut
            s, e, w, price = s[go], e[go], w[go], price[go]
            size, least = size[~done], least[~done]
            if not len(s):
                break
            head = np.cumsum(size) - size
        hit = np.flatnonzero(price == np.repeat(least, size))
        at = hit[np.searchsorted(hit, head)]  # the leftmost of each word
        e[at] = e[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))  # places after the joined symbols have gone
        s, e, w, price = s[keep], e[keep], w[keep], price[keep]
        left = new[new > 0] - 1
        k = np.concatenate([new, left[w[left] == w[left + 1]]])
        last = k == len(s) - 1
        other = np.where(last, k, k + 1)
        ends_word = last | (w[other] != w[k])
        price[k] = np.where(ends_word, none, edges.cost(s[k].astype(np.int64), e[other]))
    s = np.flatnonzero(final)
    return s, final[s].astype(np.int64)


def _relax_long(starts: np.ndarray, ends: np.ndarray, edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """One long word: the same merges from a heap. Prices are read from the edges one by one, without an array call each."""
    none = np.iinfo(np.int32).max
    n = len(starts)
    s, e = starts.tolist(), ends.tolist()
    base = s[0]
    table = memoryview(np.ascontiguousarray(edges.table[base * WIDE : e[-1] * WIDE]))
    far = dict(zip(edges.far.tolist(), edges.far_id.tolist())) if len(edges.far) else {}
    rank = memoryview(edges.rank)

    def one(a: int, b: int) -> int:
        size = b - a
        return rank[table[(a - base) * WIDE + size - 1] if size <= WIDE else far.get(a << 20 | size, edges.none)]

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(c, i, s[i], e[i + 1]) for i in range(n - 1) if (c := one(s[i], e[i + 1])) != none]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or s[i] != a or e[j] != b:
            continue
        e[i], alive[j] = e[j], False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                c = one(s[k], e[after[k]])
                if c != none:
                    heapq.heappush(heap, (c, k, s[k], e[after[k]]))
    use = [i for i in range(n) if alive[i]]
    return np.array([s[i] for i in use]), np.array([e[i] for i in use])


def encode(texts: list[str], path: str | bytes = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text)."""
    v = load(path)
    raw = [b"" if not t else SPACE + t.encode().replace(b" ", SPACE) for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    text_end = np.cumsum(size)
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    mark = np.zeros(n + 3, bool)
    mark[: n - 2] = (data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])
    start = mark[:n].copy()
    start[3:] &= ~mark[: n - 3]  # a word starts at a space sign that does not follow another
    start[(text_end - size)[size > 0]] = True
    start = np.flatnonzero(start)
    end = np.append(start[1:], n)
    first, back, _ = distinct_ranges(data, start, end)
    # the distinct words, end to end
    ws, we = start[first], end[first]
    length = we - ws
    own = data[spread(ws, length)]
    room = room_of(length)
    edges = Edges(len(own), *occurrences(own, room, path), v.rank)
    chars = np.flatnonzero((own & 0xC0) != 0x80)
    word = np.repeat(np.arange(len(length)), length)
    s, e = relax(chars, np.append(chars[1:], len(own)), word[chars], edges)
    found = edges.id_of(s, e)
    known = found != edges.none
    many = np.where(known, 1, e - s)
    at = spread(s, many)
    ids = np.where(np.repeat(known, many), np.repeat(found, many), v.byte_id[own[np.minimum(at, len(own) - 1)]]).astype(np.int32)
    per_word = np.bincount(np.repeat(word[s], many), minlength=len(length))
    word_at = np.cumsum(per_word) - per_word
    n_ids = per_word[back]
    out = ids[spread(word_at[back], n_ids)]
    total = np.concatenate([[0], np.cumsum(n_ids)])
    return out, total[np.concatenate([[0], np.searchsorted(start, text_end)])]


@lru_cache(2)
def _pieces(path: str | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = [t.replace(SPACE, b" ") for t in load(path).text]
    size = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def decode(ids: np.ndarray, offsets: np.ndarray, path: str | bytes = MODEL) -> list[bytes]:
    """Bytes of each text: pieces end to end, space signs as spaces, without the first space. Unknown and control ids give nothing."""
    data, at, size = _pieces(path)
    many = size[ids]
    out = data[spread(at[ids], many)].tobytes()
    cut = np.concatenate([[0], np.cumsum(many)])[offsets].tolist()
    return [out[a + 1 : b] if b > a and out[a] == 32 else out[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _shipped(docs: DataFrame, path: str):
    """The model's bytes (a few hundred KB), read by the driver: workers need no file of their own."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _tokenize(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model.value
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column("text"), BATCH):
                texts = [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                ids, offsets = encode(texts, path)
                back = decode(ids, offsets, path)
                same = [b == t.replace("▁", " ").encode() for b, t in zip(back, texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(offsets), pa.int64()), pa.array(same)],
                    names=["doc_id", "ids", "n_ids", "round_trip"],
                )

    return run


def tokenize(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """One row per document: doc_id, ids, n_ids, round_trip (decoding gives the text back, a literal U+2581 as a space).

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text has no ids; repeated rows are encoded
    each for itself; very long texts and words are encoded whole.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_tokenize(_shipped(docs, path)), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def untokenize(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of each row with ids: null or empty ids give an empty text, ids outside the vocabulary or null in a list give
    nothing, repeated rows are decoded each for itself; other columns are ignored, an empty table gives no rows."""
    model, size = _shipped(tokens, path), len(load(path).text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model.value
        for batch in batches:
            lists = [[y for y in x or [] if y is not None and 0 <= y < size] for x in batch.column("ids").to_pylist()]
            flat = np.array([y for x in lists for y in x], np.int64)
            texts = decode(flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
