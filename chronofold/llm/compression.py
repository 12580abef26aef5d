"""Quality classifier by compression: a text that a dictionary of good texts shortens more is likely good.

Fitted on at most ``SAMPLE`` labelled documents of each class that are not held out (the first by a hash of the id;
texts of up to ``TEXT_LIMIT`` bytes). The texts of one half are two zstandard dictionaries, as content, of equal size; on the
other half the compressed-size difference, normalised by the text's bytes, is calibrated by logistic regression. Scoring
compresses every whole text with both dictionaries in blocks, so a long text is read to its end with a warm dictionary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, TEXT_LIMIT, DICTIONARY, BLOCK, LEVEL = 1500, 1 << 14, 1 << 19, 1 << 12, 6
FOLDS, CUT = 5, 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]  # of 1 and the difference


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def difference(self, text: bytes) -> float:
        """(bad size - good size) per byte of the text; 0 for an empty text."""
        if not text:
            return 0.0
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return sum(len(self.bad.compress(x)) - len(self.good.compress(x)) for x in blocks) / len(text)


def _dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """Both as long as the shorter one may be; a class without texts has a few line breaks."""
    whole = [b"".join(texts) or b"\n" * 8 for texts in (good, bad)]
    n = min(DICTIONARY, *map(len, whole))
    return tuple(x[-max(n, 8):] for x in whole)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Model of (text, label) rows: even rows make the dictionaries, odd ones the calibration."""
    good, bad = _dictionaries([t for t, y in rows[::2] if y == 1], [t for t, y in rows[::2] if y == 0])
    sizes = _Sizes(good, bad)
    x = np.array([[1.0, sizes.difference(t)] for t, _ in rows[1::2]] or [[1.0, 0.0]])
    y = np.array([y for _, y in rows[1::2]] or [1.0], float)
    scale = np.array([1.0, 50.0])
    return Model(good, bad, tuple(_logistic(x * scale, y) * scale))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[bytes, int]]:
    """The bounded sample: (text, label) in a fixed order, classes mixed. Labels that contradict each other are left out."""
    use = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
    use = use.where((F.col("y") == F.col("y2")) & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0))
    order = F.xxhash64("doc_id", F.lit(7))
    ids = [use.where(F.col("y") == y).orderBy(order).limit(sample).select("doc_id", "y") for y in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * sample rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text").between(1, TEXT_LIMIT))
    got = texts.join(chosen, "doc_id").orderBy(order, F.crc32(F.col("text").cast("binary"))).limit(4 * sample).collect()
    each = {y: [(r["text"].encode(), y) for r in got if r["y"] == y] for y in (0, 1)}
    # even and odd places get both classes
    return [x for y in (0, 1) for x in each[y][: len(each[y]) // 2 * 2]]


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model.good, model.bad)
        for batch in batches:
            x = np.array([[1.0, sizes.difference((t or "").encode())] for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Only the text is read; null is empty and both have the score of no
    difference; long texts are read to their end; repeated rows are scored each for itself; a null doc_id is not held out; an empty
    table gives no rows."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
