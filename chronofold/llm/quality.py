"""Quality rules: base counts, and divergence from language references by Jensen-Shannon distance.

References are statistics of all documents of a language: the shares of byte classes, and the shares of its
common words (all that make ``COMMON`` of its words and occur ``EVIDENCE`` times, by exact count: ``TOP`` words at most). A
document is judged against the reference of its own language, however small: where words are rare, fewer of them count
as common. It diverges if the distance of its byte classes is over ``CLASS_LIMIT`` and it has ``CLASS_GUARD`` bytes, or
if that of its common words is over ``WORD_LIMIT`` and it has ``WORD_GUARD`` words: shorter texts are too noisy to
judge. A document without a language is judged by the base rules alone. A language column that is missing counts as null.

Given as columns are the distances from the own language's reference; for a language with under ``REFERENCE_WORDS`` words, whose
distances do not compare with those of others, and for none, from that of all documents together.

Counts within a text are exact: words and lines are told apart by their bytes. Words of the references go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, U, chunks, distinct_ranges, mix, random_words, word_bounds

COMMON, EVIDENCE = 1 / 500, 20
TOP, REFERENCE_WORDS = 500, 10_000  # both follow: 1 / COMMON, and EVIDENCE / COMMON
LANGUAGES = 256  # are counted in one pass over the texts, more of them in further passes
CLASS_LIMIT, CLASS_GUARD, WORD_LIMIT, WORD_GUARD = 0.30, 200, 0.55, 50
WINDOW = 5
#: Byte classes: lower case, upper case, digit, white space, punctuation, symbol, control, beyond ASCII.
CLASSES = np.full(256, 6)
CLASSES[list(range(97, 123))] = 0
CLASSES[list(range(65, 91))] = 1
CLASSES[list(range(48, 58))] = 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[list(b".,;:!?'\"()-")] = 4
CLASSES[[c for c in range(33, 127) if CLASSES[c] == 6]] = 5
CLASSES[128:] = 7
N_CLASSES = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
ALL = ""  # the language of all documents together
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of rows of p and q, given as counts or shares."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash, number) of the words; equal words of the chunk, and no others, have one number."""
    s, e, row = word_bounds(data, offsets)
    _, number, h = distinct_ranges(data, s, e)
    return s, e, row, h, number


def _groups(langs: list, lo: int, hi: int) -> Iterator[tuple[str, np.ndarray]]:
    own = np.array([x or ALL for x in langs[lo:hi]], object)
    for x in sorted(set(own)):
        yield x, np.flatnonzero(own == x)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and language: byte classes, word total, and words that make half of COMMON there."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        out = []
        for lo, hi, data, offsets in chunks(batch.column("text")):
            _, _, row, h, _ = _words(data, offsets)
            kinds = CLASSES[data]
            at = np.repeat(np.arange(hi - lo), np.diff(offsets))
            for lang, rows in _groups(langs, lo, hi):
                mine = np.zeros(hi - lo, bool)
                mine[rows] = True
                own = h[mine[row]]
                counts = np.bincount(kinds[mine[at]], minlength=N_CLASSES)
                out.append((lang, None, len(own), counts.tolist()))
                if len(own):
                    w, n = np.unique(own, return_counts=True)
                    keep = n >= COMMON / 2 * len(own)
                    out += [(lang, int(x), int(y), None) for x, y in zip(w[keep].view(np.int64), n[keep])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["lang", "word", "n", "classes"])


def _count(known: dict[str, np.ndarray]):
    """Occurrences of the known words of each language in its texts, and of those of ALL in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            total: dict[str, np.ndarray] = {}

            def add(lang: str, h: np.ndarray) -> None:
                words = known[lang]
                if len(words):
                    i = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    total[lang] = total.get(lang, 0) + np.bincount(i[words[i] == h], minlength=len(words))

            for lo, hi, data, offsets in chunks(batch.column("text")):
                _, _, row, h, _ = _words(data, offsets)
                h = h.view(np.int64)
                if ALL in known:
                    add(ALL, h)
                for lang, rows in _groups(langs, lo, hi):
                    if lang != ALL and lang in known:
                        mine = np.zeros(hi - lo, bool)
                        mine[rows] = True
                        add(lang, h[mine[row]])
            out = [(lang, int(known[lang][k]), int(n[k])) for lang, n in total.items() for k in np.flatnonzero(n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["lang", "word", "n"])

    return run


def references(docs: DataFrame, scratch: Scratch) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Language -> (byte class counts, common words as sorted hashes, their counts and that of the rest).

    Exact and whatever the layout: a word that makes COMMON of a language makes half of it in chunks that hold half of
    its occurrences, so the candidates (2 / COMMON per language at most) include it; they are then counted in full.
    """
    found = scratch.cut(docs.mapInArrow(_candidates, "lang string, word long, n long, classes array<long>"))
    top = found.where("word is null").groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(N_CLASSES)])
    whole = top.agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(N_CLASSES)]).first()
    if whole is None or not whole["n"]:
        return {}
    # one row a language, a few hundred bytes each
    langs = {r["lang"]: r for r in top.where((F.col("lang") != ALL) & (F.col("n") > 0)).orderBy("lang").collect()}
    words = found.where("word is not null")
    # of all documents together the candidates are those of any language group
    everyone = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON / 2 * whole["n"]).collect()
    out = {}
    names = list(langs)
    for lo in range(0, max(1, len(names)), LANGUAGES):
        block = names[lo : lo + LANGUAGES]
        known: dict[str, list[int]] = {k: [] for k in block} | ({} if lo else {ALL: [r["word"] for r in everyone]})
        if block:
            total = F.create_map(*[F.lit(x) for k in block for x in (k, langs[k]["n"])])
            sums = words.where(F.col("lang").isin(block)).groupBy("lang", "word").agg(F.sum("n").alias("n"))
            for r in sums.where(F.col("n") >= F.lit(COMMON / 2) * total[F.col("lang")]).collect():  # 2 / COMMON words a language at most
                known[r["lang"]].append(r["word"])
        counted = docs.mapInArrow(_count({k: np.array(sorted(v), np.int64) for k, v in known.items()}), "lang string, word long, n long")
        least = F.create_map(*[F.lit(x) for k in known for x in (k, max(EVIDENCE, COMMON * langs.get(k, whole)["n"]))])
        exact: dict[str, list] = {k: [] for k in known}
        for r in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")]).collect():  # 1 / COMMON words a language at most
            exact[r["lang"]].append((r["word"], r["n"]))
        for lang, best in exact.items():
            row = langs.get(lang, whole)
            best.sort()
            out[lang] = (np.array([row[f"c{i}"] for i in range(N_CLASSES)], float), np.array([w for w, _ in best], np.int64), np.array([c for _, c in best] + [row["n"] - sum(c for _, c in best)], float))
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row of a chunk, and (row, hash) of its words."""
    n = len(offsets) - 1
    s, e, row, h, number = _words(data, offsets)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])[offsets[1:]] - np.concatenate([[0], np.cumsum(mask)])[offsets[:-1]]
    n_words = np.bincount(row, minlength=n)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    chars = sums(((data & 0xC0) != 0x80) & (np.cumsum(inside[:-1], dtype=np.int8) > 0)) if len(data) else np.zeros(n, np.int64)
    symbols = sums(SYMBOLS[data]) if len(data) else np.zeros(n, np.int64)
    return n_words, chars, symbols, _dup_lines(data, offsets, s), _repeat_words(number, row, n), row, h


def _dup_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros(n, np.int64)
    if not len(data):
        return out
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    start = start[start < len(data)]
    # a line ends at its line break or with its row
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], offsets[1:][np.searchsorted(offsets, start, "right") - 1])
    has = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, start)
    start, end = start[has], end[has]
    row = np.searchsorted(offsets, start, "right") - 1
    _, h, _ = distinct_ranges(data, start, end)
    o = np.lexsort((h, row))
    again = (h[o][1:] == h[o][:-1]) & (row[o][1:] == row[o][:-1])
    return np.bincount(row[o][1:][again], minlength=n)


_PLACE = random_words(4, WINDOW + 1) | U(1)


def _repeat_words(number: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words in windows that a row holds twice or more. Windows are sorted by a hash; where hashes agree, the words decide."""
    out = np.zeros(n, np.int64)
    first = np.flatnonzero(row[: max(0, len(row) - WINDOW + 1)] == row[WINDOW - 1 :]) if len(row) >= WINDOW else np.zeros(0, np.int64)
    if not len(first):
        return out
    key = row[first].astype(U) * _PLACE[WINDOW]
    for j in range(WINDOW):
        key = mix(key + number[first + j].astype(U) * _PLACE[j])
    o = first[np.argsort(key, kind="stable")]
    key = np.sort(key)
    near = np.flatnonzero(key[1:] == key[:-1])
    same = row[o[near]] == row[o[near + 1]]
    for j in range(WINDOW):
        same &= number[o[near] + j] == number[o[near + 1] + j]
    twice = np.zeros(len(o), bool)
    if same.all():
        twice[near] = twice[near + 1] = True
    else:  # windows that differ under one hash
        seen: dict[tuple, int] = {}
        for k, at in enumerate(o.tolist()):
            before = seen.setdefault((row[at], *number[at : at + WINDOW].tolist()), k)
            if before != k:
                twice[before] = twice[k] = True
    edge = np.zeros(len(row) + 1, np.int32)
    np.add.at(edge, o[twice], 1)
    np.add.at(edge, o[twice] + WINDOW, -1)
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n)


def _judge(refs: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                n_words, chars, symbols, dup, rep, row, h = base_counts(data, offsets)
                n = hi - lo
                by_class, by_word, far_class, far_word = np.zeros((4, n))
                if refs:
                    at = np.repeat(np.arange(n), np.diff(offsets))
                    kinds = np.bincount(at * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
                    signed = h.view(np.int64)

                    def distances(rows: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
                        place = np.full(n, -1)
                        place[rows] = np.arange(len(rows))
                        classes, words, shares = refs[lang]
                        w, p = signed[place[row] >= 0], place[row][place[row] >= 0]
                        k = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
                        k = np.where(words[k] == w, k, len(words)) if len(words) else np.zeros(len(w), np.int64)
                        hist = np.bincount(p * (len(words) + 1) + k, minlength=len(rows) * (len(words) + 1)).reshape(len(rows), -1)
                        return distance(kinds[rows], classes), distance(hist, shares)

                    own = np.array([x if x in refs and x else ALL for x in langs[lo:hi]], object)
                    for lang in set(own):
                        rows = np.flatnonzero(own == lang)
                        by_class[rows], by_word[rows] = distances(rows, lang)
                        if lang != ALL:
                            far_class[rows], far_word[rows] = by_class[rows], by_word[rows]
                            if refs[lang][2].sum() < REFERENCE_WORDS:
                                by_class[rows], by_word[rows] = distances(rows, ALL)
                failed = (n_words < 10) | (100 * rep > 20 * n_words)
                apart = ((far_class > CLASS_LIMIT) & (np.diff(offsets) >= CLASS_GUARD)) | ((far_word > WORD_LIMIT) & (n_words >= WORD_GUARD))
                cols = [n_words, chars, symbols, dup, rep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), *[pa.array(c.astype(np.int64)) for c in cols], pa.array(failed), pa.array(~failed & ~apart), pa.array(by_class), pa.array(by_word), *[batch.column(c).slice(lo, n) for c in batch.schema.names[3:]]],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", *batch.schema.names[3:]],
                )

    return run


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, class_distance, word_distance, and the columns to
    carry under ``carry_<name>``.

    ``docs`` has doc_id and text, and lang or not. A null or empty text has no words and fails; repeated rows are
    judged each for itself; an empty table gives no rows.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    carry = carry or []
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    refs = references(narrow.select("text", "lang"), Scratch(docs.sparkSession))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[3:])
    return narrow.mapInArrow(_judge(refs), f"{BASE}, base_failed boolean, kept boolean, class_distance double, word_distance double{extra}")
