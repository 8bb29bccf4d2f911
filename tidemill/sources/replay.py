"""A stream that replays the lines of text files at a pace, and goes on at its line after a restart.

The offset is a place: the cycle, the file, the byte of the next line, and the
number of lines so far.  A batch takes the lines that are due since the batch
before, straight from their place in the file; nothing else of it is read.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from itertools import islice

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Lines of a batch at most, and bytes read at once.
MOST, BLOCK = 10_000, 1 << 16
START = {"cycle": 0, "file": 0, "at": 0, "rows": 0}


def text_files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The file, or the folder's files by name; those with a leading dot or underscore are not data."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [place]
    found = [i for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return system, sorted(i.path for i in found)


def file_lines(system: fs.FileSystem, path: str, at: int) -> Iterator[tuple[str, int]]:
    """(line, byte after it) from a byte on; blank lines are left out."""
    with system.open_input_file(path) as f:
        f.seek(at)
        rest = b""
        while block := f.read(BLOCK):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                at += len(line) + 1
                if text := line.removesuffix(b"\r"):
                    yield text.decode("utf-8", "replace"), at
        if rest:
            yield rest.removesuffix(b"\r").decode("utf-8", "replace"), at + len(rest)


def lines_from(path: str, start: dict, cycles: int | None, rows: int | None) -> Iterator[tuple[str, dict]]:
    """(line, offset after it) from an offset on: cycles times over (for ever if None), rows lines in all at most."""
    system, files = text_files(path)
    cycle, file, at, n = (start[k] for k in ("cycle", "file", "at", "rows"))
    while (cycles is None or cycle < cycles) and files:
        before = n
        for i in range(file, len(files)):
            for line, end in file_lines(system, files[i], at):
                if rows is not None and n >= rows:
                    return
                n += 1
                yield line, {"cycle": cycle, "file": i, "at": end, "rows": n}
            at = 0
        if n == before and not (file or start["at"]):
            return  # there is no line to replay
        cycle, file = cycle + 1, 0


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        number = lambda k: int(options[k]) if k in options else None
        self.path, self.rate, self.cycles, self.rows = options["path"], float(options.get("linesPerSecond", "100")), number("cycles"), number("rows")
        self.last: float | None = None

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return dict(START)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = time.monotonic()
        due = min(MOST, 1 if self.last is None else int((now - self.last) * self.rate))
        if due < 1:
            return iter(()), start
        self.last = now
        taken = list(islice(lines_from(self.path, start, self.cycles, self.rows), due))
        return iter([(line,) for line, _ in taken]), taken[-1][1] if taken else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(line,) for line, _ in islice(lines_from(self.path, start, self.cycles, self.rows), end["rows"] - start["rows"])])


class LineReplay(DataSource):
    """Options: path, linesPerSecond (100), cycles and rows (without end)."""

    @classmethod
    def name(cls) -> str:
        return "tidemill-lines"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> _Reader:  # noqa: N802
        return _Reader(self.options)


def replay_lines(spark: SparkSession, path: str, lines_per_second: float = 100, cycles: int | None = None, rows: int | None = None) -> DataFrame:
    """The lines of a file or a folder's files as a stream, one column `value`."""
    spark.dataSource.register(LineReplay)
    reader = spark.readStream.format(LineReplay.name()).option("path", path).option("linesPerSecond", str(lines_per_second))
    for name, value in (("cycles", cycles), ("rows", rows)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load()
