"""Bounded and streaming readers of event files and stdin."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.model import ENVELOPE
from chronofold.sources.envelope import require_all, split_envelopes
from chronofold.sources.stream import LINES, EventFiles, event_files

MAX_BATCH = 256
LOOK = 64  # files that a poll counts at once


def _numbered(df: DataFrame, source_id: str, batch_id: int = 0) -> DataFrame:
    """Lines with file name and an ascending line_no. Splits of a file keep their order by block start."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.select("value", F.lit(source_id).alias("source_id"), F.col("_metadata.file_name").alias("position"), (F.col("_metadata.file_block_start") + row).alias("line_no"), F.lit(batch_id).cast("long").alias("batch_id"))


def read_lines(spark: SparkSession, path: str | list[str], source_id: str = "directory", batch_id: int = 0) -> DataFrame:
    if not path:
        return spark.createDataFrame([], LINES)
    return _numbered(spark.read.text(path), source_id, batch_id)


def replay_events(spark: SparkSession, path: str) -> DataFrame:
    """Replay scan. A directory: its .json files in name order, one event each. A file: one event, else NDJSON.

    Blank lines are skipped, an empty file gives no events, the first bad record fails the read.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(fs_path).isDirectory():
        whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_name").rlike(r"(?i)\.json$"))
        return require_all(_numbered(whole, "replay"))
    first = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    if first and _is_object(first[0].value):
        return require_all(read_lines(spark, path, "replay"))
    return require_all(_numbered(spark.read.text(path, wholetext=True), "replay"))


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def load_event(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file, one event."""
    return require_all(_numbered(spark.read.text(path, wholetext=True), "event"))


def directory_batch(spark: SparkSession, path: str, committed: str | None = None, max_batch: int = MAX_BATCH, source_id: str = "directory", batch_id: int = 0) -> tuple[DataFrame, DataFrame, str | None]:
    """(events, rejects, last file) of the next batch after the committed file.

    Whole files in name order until ``max_batch`` events are reached, one file at least. Names are listed; only the next files
    are read to count their lines: one, then twice as many each time, ``LOOK`` at most.
    """
    names = [n for n in event_files(path) if committed is None or n > committed]
    end, total, i, look = None, 0, 0, 1
    while i < len(names) and total < max_batch:
        block, look = names[i : i + look], min(2 * look, LOOK)
        lines = read_lines(spark, [f"{path.rstrip('/')}/{n}" for n in block]).where("trim(value) != ''")
        counts = {r.position: r["count"] for r in lines.groupBy("position").count().collect()}  # LOOK rows at most
        for n in block:
            if total >= max_batch:
                break
            if counts.get(n):  # files without an event are passed over
                end, total = n, total + counts[n]
            i += 1
    taken = [n for n in names if end is not None and n <= end]
    lines = read_lines(spark, [f"{path.rstrip('/')}/{n}" for n in taken] if taken else [], source_id, batch_id)
    events, rejects = split_envelopes(lines)
    return events, rejects, end


def numbered_stream(spark: SparkSession, path: str, files_per_batch: int = 100, source_id: str = "stream", limit: int = 0) -> DataFrame:
    """Unbounded directory source in name order: lines with file name, line number and ``batch_id``.

    ``files_per_batch`` files in name order have one batch_id, whatever micro-batch they come in. ``limit``: files that a
    micro-batch takes at most (none: all that are there, as a run until caught up needs). One task reads a file; its lines are
    dealt to all tasks, by number and not in turn, which would sort them.
    """
    spark.dataSource.register(EventFiles)
    lines = spark.readStream.format(EventFiles.name()).options(path=path, group=files_per_batch, sourceId=source_id, limit=limit).load()
    return lines.repartition(spark.sparkContext.defaultParallelism, "position", "line_no")


def stdin_lines(spark: SparkSession, stream: Iterable[str] | None = None, source_id: str = "stdin", batch_id: int = 0) -> DataFrame:
    """Lines of stdin; the position is the zero-padded line index, blank lines use one up."""
    rows = [(x.rstrip("\n"), source_id, f"{i:012d}", i, batch_id) for i, x in enumerate(sys.stdin if stream is None else stream)]
    return spark.createDataFrame(rows, LINES)


class StdinLines:
    """Stdin as a source of batches: ``max_batch`` lines are held at a time. Lines up to the committed position are passed over."""

    def __init__(self, stream: Iterable[str] | None = None):
        self.lines = enumerate(sys.stdin if stream is None else stream)
        self.held: tuple[str, list] | None = None

    def batch(self, spark: SparkSession, committed: str | None = None, max_batch: int = MAX_BATCH, source_id: str = "stdin") -> tuple[DataFrame, DataFrame, str | None]:
        if self.held is None or (committed is not None and self.held[0] <= committed):
            rows = []
            for i, x in self.lines:
                at = f"{i:012d}"
                if x.strip() and (committed is None or at > committed):
                    rows.append((x.rstrip("\n"), source_id, at, i, 0))
                    if len(rows) >= max_batch:
                        break
            self.held = (rows[-1][2], rows) if rows else None  # an uncommitted batch comes again
        events, rejects = split_envelopes(_local_lines(spark, self.held[1] if self.held else []))
        return events, rejects, self.held[0] if self.held else None


def _local_lines(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of LINES that the driver holds, handed over as Arrow columns and not row by row."""
    if not rows:
        return spark.createDataFrame([], LINES)
    types = {"string": pa.string(), "long": pa.int64()}
    names, kinds = zip(*(x.split() for x in LINES.split(", ")))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], names=list(names)), LINES)


def from_rows(spark: SparkSession, events: list[dict], batch_id: int = 0) -> DataFrame:
    """Event dicts as an envelope DataFrame; arrival order is list order."""
    rows = []
    for i, e in enumerate(events):
        payload = e["payload"] if isinstance(e["payload"], str) else json.dumps(e["payload"])
        rows.append((e.get("event_id", f"e{i}"), e["event_type"], payload, e.get("metadata", {}), e.get("version", 1), e["sequence"], e.get("source_id", "rows"), e.get("position", f"{i:012d}"), i, e.get("batch_id", batch_id)))
    from decimal import Decimal

    return spark.createDataFrame([(*r[:5], Decimal(r[5]), *r[6:]) for r in rows], ENVELOPE)
