"""Lines of log files by byte ranges: several tasks read one large file, and every line keeps its place.

A range owns the lines whose first byte lies in it, so that no line is lost or read twice, wherever a range is cut. Files
are opened by pyarrow, for local folders and for the schemes that it knows. A task holds one line and one batch.

Bytes that are no UTF-8 become replacement signs. Empty files give no row. A last line without its newline is read by the
batch reader and waits in the stream until it is whole. A file that shrinks is not read again by the stream.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stepweave.functions.scalars import excluded
from stepweave.sources.arrival import written

#: Bytes of a range, tasks beyond which short ranges share one, and bytes of lines sent to Spark at once.
SPLIT, TASKS, BATCH = 64 << 20, 64, 4 << 20
#: Ranges whose line counts may be broadcast (64 TB of logs at the usual split).
FEW_RANGES = 1_000_000
LINES = "file string, start long, n long, offset long, line string"
COUNTS = "file string, start long, lines long"


class Piece(NamedTuple):
    file: str
    start: int
    first: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def _opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder or file, its path there, and what stands before such paths in its address."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/"), ""
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
    return system, path.rstrip("/"), root[: root.index(path)] if path in root else ""


def _sizes(root: str, pattern: str) -> dict[str, int]:
    """Bytes of the files below a folder whose names match, or of the one file named."""
    system, path, before = _opened(root)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and fnmatch(i.base_name, pattern)]
    return {before + i.path: i.size for i in sorted(found, key=lambda i: i.path)}


def _lines(piece: Piece) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in a piece."""
    system, path, _ = _opened(piece.file)
    with system.open_input_file(path) as f:
        at = max(piece.first - 1, 0)
        f.seek(at)
        buffered = io.BufferedReader(f, 1 << 20)
        if piece.first:  # the rest of another range's line, or the newline before this one's first
            at += len(buffered.readline())
        while at < piece.end and (line := buffered.readline()):
            yield at, line
            at += len(line)


def _cut(file: str, begin: int, end: int, split: int) -> Iterator[Piece]:
    """Pieces of [begin, end), cut at multiples of the split; start is the multiple, so it names a range whatever was read before."""
    for start in range(begin // split * split, end, split):
        yield Piece(file, start, max(start, begin), min(start + split, end))


def _dealt(pieces: Iterator[Piece], split: int) -> list[Pieces]:
    """Tasks of about a split's bytes; shorter splits share tasks, of SPLIT bytes at most, once there are more than TASKS. A small file counts for a sixty-fourth, as opening it takes its time."""
    pieces = list(pieces)
    size = max(split, min(SPLIT, sum(p.end - p.first for p in pieces) // TASKS))
    tasks, held = [], size
    for p in pieces:
        if held >= size:
            tasks.append(Pieces([]))
            held = 0
        tasks[-1].pieces.append(p)
        held += max(p.end - p.first, size // 64)
    return tasks


def _rows(pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
    names = ["file", "start", "n", "offset", "line"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for p in pieces:
        numbers, offsets, lines, held = [], [], [], 0
        for n, (at, line) in enumerate(_lines(p)):
            numbers.append(n)
            offsets.append(at)
            lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
            held += len(line)
            if held >= BATCH:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(([p.file] * len(lines), [p.start] * len(lines), numbers, offsets, lines), kinds, strict=True)], names)
                numbers, offsets, lines, held = [], [], [], 0
        if lines:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(([p.file] * len(lines), [p.start] * len(lines), numbers, offsets, lines), kinds, strict=True)], names)


class _Ranges(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern, self.split = options["path"], options.get("pattern", "*.jsonl"), int(options.get("split", SPLIT))
        self.counts = options.get("only") == "counts"

    def partitions(self) -> list[Pieces]:
        return _dealt((p for file, size in _sizes(self.root, self.pattern).items() for p in _cut(file, 0, size, self.split)), self.split) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator:
        if self.counts:
            return ((p.file, p.start, sum(1 for _ in _lines(p))) for p in partition.pieces)
        return _rows(partition.pieces)


class _Tail(DataSourceStreamReader):
    """Offsets are the bytes of each file read so far; what has been appended since, up to its last newline, is the next batch."""

    def __init__(self, options: dict):
        self.root, self.pattern, self.split = options["path"], options.get("pattern", "*.jsonl"), int(options.get("split", SPLIT))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, size in _sizes(self.root, self.pattern).items():
            if size > self.known.get(file, 0):
                self.known[file] = max(self._whole(file, size), self.known.get(file, 0))
        return dict(self.known)

    def _whole(self, file: str, size: int) -> int:
        """Where the last whole line of a file ends; looks backwards from its end."""
        system, path, _ = _opened(file)
        with system.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(end - (1 << 20), 0)
                f.seek(begin)
                if (at := f.read(end - begin).rfind(b"\n")) >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return _dealt((p for file in sorted(end) for p in _cut(file, int(start.get(file, 0)), int(end[file]), self.split)), self.split)

    def read(self, partition: Pieces) -> Iterator:
        return _rows(partition.pieces)

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    """format("loglines"): path (a folder, looked through with all folders below it, or a file), pattern of names, split in bytes.

    Rows: file, start (of the range), n (place in the range, from 0; of a stream in what the batch read of it), offset
    (bytes before the line in its file) and line. With only=counts: file, start and the lines of each range.
    """

    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return COUNTS if self.options.get("only") == "counts" else LINES

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(dict(self.options))


def records(spark: SparkSession, path: str, pattern: str = "*.jsonl", split: int = SPLIT) -> DataFrame:
    """file, ordinal (the line's number in its file, from 0) and raw line of all lines that are not blank.

    Lines are counted by range first, and a range begins at the sum of those before it. Lines of ranges that came after
    the count are left for the next reading.
    """
    spark.dataSource.register(LogLines)
    source = spark.read.format("loglines").option("pattern", pattern).option("split", split)
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    firsts = written(source.option("only", "counts").load(path).select("file", "start", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before")))
    few = firsts.limit(FEW_RANGES + 1).count() <= FEW_RANGES
    lines = spark.read.format("loglines").option("pattern", pattern).option("split", split).load(path)
    placed = lines.join(F.broadcast(firsts) if few else firsts, ["file", "start"])
    return placed.select("file", (F.col("before") + F.col("n")).alias("ordinal"), "line").where(F.btrim("line") != "")


def follow_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", split: int = SPLIT) -> DataFrame:
    """Lines as a stream: file, offset and line. The offset orders the lines of a file as their ordinals do, in any batch."""
    spark.dataSource.register(LogLines)
    lines = spark.readStream.format("loglines").option("pattern", pattern).option("split", split).load(path)
    return lines.select("file", "offset", "line").where(F.btrim("line") != "")


def folder_name(project: Column) -> Column:
    """The name of the folder that holds a project's logs: what is neither letter nor digit becomes a dash."""
    return F.regexp_replace(project, "[^A-Za-z0-9]", "-")


def permitted(lines: DataFrame, deny: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines of records whose folder (cwd) no glob of the deny list matches, and one row that counts the others (name, n).

    Only the folder is read from a line that is turned away. A line without one passes; the parser judges it.
    """
    folder = F.get_json_object("line", "$.cwd")
    denied = F.coalesce(excluded(folder, deny), F.lit(False))
    return lines.where(~denied), lines.agg(F.count_if(denied).alias("n")).select(F.lit("capture_excluded").alias("name"), "n")
