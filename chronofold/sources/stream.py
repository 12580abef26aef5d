"""A streaming source of event files in name order.

Spark's own file source takes files by modification time; events must be taken by file name, as the bounded directory
source does. Here an offset is the last name taken and the number of files up to it: files are listed on the driver, each
trigger takes those with greater names, and a file that appears later under a smaller name is never read. Every line
carries its file's place in that order as ``batch_id`` (``group`` files make one), so a fold that sorts by it gives the
same result however the stream is cut into micro-batches, and after a restart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINES = "value string, source_id string, position string, line_no long, batch_id long"
READ = 1 << 20  # bytes of a file that are read at once
SUFFIX = re.compile(r"\.(json|ndjson|jsonl)$", re.IGNORECASE)


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def event_files(path: str) -> list[str]:
    """Names of the event files of a folder, sorted; hidden ones are left out."""
    where, root = _folder(path)
    names = [f.base_name for f in where.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
    return sorted(n for n in names if SUFFIX.search(n) and not n.startswith((".", "_")))


@dataclass
class FilePart(InputPartition):
    name: str
    place: int


def _lines(stream) -> Iterator[list[str]]:
    """Lists of lines, of about READ bytes each; a line's end is \\n or \\r\\n."""
    rest = b""
    while block := stream.read(READ):
        *whole, rest = (rest + block).split(b"\n")
        if whole:
            yield [x.removesuffix(b"\r").decode("utf-8", "replace") for x in whole]
    if rest:
        yield [rest.removesuffix(b"\r").decode("utf-8", "replace")]


class EventFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.source = options["path"], options.get("sourceid", "stream")
        self.group, self.limit = int(options.get("group", 1)), int(options.get("limit", 0))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"after": "", "files": 0}

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        new = [n for n in event_files(self.path) if n > at["after"]]
        new = new[: self.limit] if self.limit else new
        self.at = {"after": new[-1], "files": at["files"] + len(new)} if new else at
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[FilePart]:
        self.at = self.at or end  # after a restart the engine plans the last batch first
        names = [n for n in event_files(self.path) if start["after"] < n <= end["after"]]
        # files that came in between since then belong to no batch: places are counted from the end
        if len(names) != end["files"] - start["files"]:
            raise RuntimeError(f"files between {start['after']!r} and {end['after']!r} have changed since they were taken")
        return [FilePart(n, start["files"] + i) for i, n in enumerate(names)]

    def commit(self, end: dict) -> None:
        self.at = self.at or end

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        where, root = _folder(self.path)
        row = 0
        with where.open_input_stream(f"{root.rstrip('/')}/{part.name}") as stream:
            for lines in _lines(stream):
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines, pa.string()), pa.array([self.source] * n), pa.array([part.name] * n), pa.array(range(row, row + n), pa.int64()), pa.array([part.place // self.group] * n, pa.int64())],
                    names=["value", "source_id", "position", "line_no", "batch_id"],
                )
                row += n


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chronofold_event_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> EventFilesReader:
        return EventFilesReader(self.options)
