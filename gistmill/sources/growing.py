"""Growing transcripts as a stream: files of lines, read from the byte where the last batch ended.

``GrowingLines`` is a Python data source.  Its offset holds, for each file, the byte behind its last whole line and a mark of how the file begins.  A batch reads
what lies between two offsets, dealt among tasks by byte ranges; a line belongs to the range in which it starts.  A line that is not ended yet stays for a later
batch.  A file that has become shorter, or begins otherwise, has been replaced: it is read from its start.  A repeated batch reads the same bytes.

A line of more than ``maxLineBytes`` is a record of a tool or a document and no turn: it is passed over, in whatever batches its bytes arrive.
The offset grows with the number of files.  Folders may be in any store that pyarrow can open by a uri, and must be seen by the driver and all executors.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", folder).load()
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MAX_LINE, PART, HEAD = 512 * 1024, 32 * 1024 * 1024, 256


@dataclass
class Range(InputPartition):
    """Bytes of a file: lines that start at ``start`` or behind it and before ``stop``; ``begin`` is where the batch begins, on the start of a line."""

    path: str
    begin: int
    start: int
    stop: int


class GrowingLines(DataSource):
    """path string, start long (the line's first byte), line string."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, start long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return _Reader(o["path"], o.get("suffix", ".jsonl"), int(o.get("maxLineBytes", MAX_LINE)), int(o.get("partBytes", PART)))


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, max_line: int, part: int):
        self.folder, self.suffix, self.max_line, self.part = folder, suffix, max_line, part

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = self._store()
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        out = {}
        for info in sorted(found, key=lambda x: x.path):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and info.size:
                with store.open_input_file(info.path) as file:
                    at = _whole(file, info.size)
                    if at:
                        out[info.path] = [at, *_mark(file, min(at, HEAD))]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, _ = self._store()
        out: list[InputPartition] = []
        for path, (stop, _, mark) in end.items():
            begin, size, had = start.get(path, [0, 0, ""])
            same = begin <= stop
            if begin and same:
                # the mark now may cover more bytes than the one before
                with store.open_input_file(path) as file:
                    same = _mark(file, size)[1] == had
            begin = begin if same else 0
            out += [Range(path, begin, at, min(at + self.part, stop)) for at in range(begin, stop, self.part)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as file:
            at = partition.start
            if at > partition.begin:
                # the line that runs on from the range before is that one's
                file.seek(at - 1)
                at = at - 1 + sum(len(piece) for piece, _ in _line(file))
            file.seek(at)
            while at < partition.stop:
                pieces, size = [], 0
                for piece, ended in _line(file):
                    size += len(piece)
                    if size <= self.max_line:
                        pieces.append(piece)
                    else:
                        pieces.clear()
                if not size or not ended:
                    return
                if size <= self.max_line:
                    yield partition.path, at, b"".join(pieces).rstrip(b"\r\n").decode("utf-8", "replace")
                at += size

    def commit(self, end: dict) -> None:
        """Nothing to do: transcripts stay where they are."""


def _line(file, block: int = 64 * 1024) -> Iterator[tuple[bytes, bool]]:
    """The next line in pieces of a bounded size, each with whether it ends the line; leaves the file behind the line."""
    while True:
        at = file.tell()
        piece = file.read(block)
        if not piece:
            return
        found = piece.find(b"\n")
        if found >= 0:
            file.seek(at + found + 1)
            yield piece[: found + 1], True
            return
        yield piece, False


def _whole(file, size: int, block: int = 64 * 1024) -> int:
    """The byte behind the last line feed."""
    stop = size
    while stop:
        start = max(0, stop - block)
        file.seek(start)
        found = file.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


def _mark(file, size: int) -> list:
    """How many bytes a mark covers, and the mark."""
    file.seek(0)
    return [size, hashlib.sha256(file.read(size)).hexdigest()[:16]]
