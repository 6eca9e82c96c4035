"""Follow append-only log files: a stream source whose offsets are bytes per file."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, and of the blocks in which line ends are looked for.
SPLIT = 32 << 20
BLOCK = 1 << 20
#: Tasks of a trigger beyond which a task reads several splits, as long as they are small.
TASKS = 256


class LogPart(InputPartition):
    """The lines of a file that begin in ``[start, end)``; a line of the file begins at ``first``."""

    def __init__(self, path: str, first: int, start: int, end: int, stop: int):
        super().__init__((path, first, start, end, stop))
        self.path, self.first, self.start, self.end, self.stop = path, first, start, end, stop


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder given as a local path or a URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def last_line_end(source, start: int, size: int) -> int:
    """The position after the last line feed in ``[start, size)``; ``start`` without one.  Read from the end, block by block."""
    at = size
    while at > start:
        begin = max(start, at - BLOCK)
        source.seek(begin)
        found = source.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return start


def lines_from(source, part: LogPart) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of a part, without line ends; the last line may end in the next part."""
    at = part.start
    skip = at > part.first  # the line that is under way here belongs to the part before
    at -= skip
    source.seek(at)
    read, rest = at, b""
    while at < part.end:
        block = source.read(min(BLOCK, part.stop - read))
        if not block:
            return
        read += len(block)
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            if at >= part.end:
                return
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1


class TailReader(DataSourceStreamReader):
    """Offsets: bytes read per file, always at a line's end, so a torn last line waits until it is whole."""

    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        store, folder = open_store(self.path)
        known = getattr(self, "known", {})
        ends = {}
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(self.suffix) and info.base_name[0] not in "._":
                with store.open_input_file(info.path) as source:
                    end = last_line_end(source, min(known.get(info.base_name, 0), info.size), info.size)
                if end:
                    ends[info.base_name] = max(end, known.get(info.base_name, 0))
        self.known = known | ends
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = after | getattr(self, "known", {})
        parts: list[InputPartition] = []
        news = sum(max(0, stop - before.get(name, 0)) for name, stop in after.items())
        # a task costs more than the reading of a small split, so tasks grow with the news instead of their number
        step = max(self.split, min(SPLIT, -(-news // (TASKS * self.split)) * self.split))
        for name, stop in sorted(after.items()):
            first = before.get(name, 0)
            parts += [LogPart(name, first, at, min(at + step, stop), stop) for at in range(first, stop, step)]
        return parts

    def read(self, partition: LogPart) -> Iterator[tuple]:
        store, folder = open_store(self.path)
        with store.open_input_file(f"{folder.rstrip('/')}/{partition.path}") as source:
            if source.size() < partition.stop:
                raise OSError(f"{partition.path} is shorter than what was read of it: not append-only")
            for at, line in lines_from(source, partition):
                yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the query's checkpoint."""


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(folder)``: file, offset, line.

    Options: ``suffix`` of the files (``.jsonl``) and ``split``, the bytes a task reads at least, where a file has them; where more than
    ``TASKS`` splits are new, a task reads several of them, ``SPLIT`` bytes at most.  A file that grows is read on from where
    the stream stopped, also after a restart from the checkpoint; Spark's file source never reads a file
    again.  Offsets have one number per file of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("split", SPLIT)))


def tail(spark: SparkSession, folder: str, suffix: str = ".jsonl", split: int = SPLIT) -> DataFrame:
    """The lines of all append-only files of a folder as a stream."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("suffix", suffix).option("split", split).load(folder)
