"""Log lines by byte ranges: a Python data source that reads what lies behind a cursor, in batch
and as a stream.

Files are cut into ranges of RANGE bytes, each read by one task: a range holds the lines that
start in it, so every line is read once, however long. A last line without its line feed waits. A
cursor is a file's byte and line with the digests of two probes, the file's first bytes and those
before the cursor; where they no longer fit, or the file is shorter, it is read from the start.
Nothing else before the cursor is read. Files are opened with pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, of a read, and of a probe.
RANGE, BLOCK, PROBE = 128 << 20, 1 << 20, 4096

SOURCE = "logloom_lines"
#: nth: the line's number in its range from 1, blank lines included. A range ends with a row
#: without raw, whose nth and end_offset are the range's count of lines and where they end.
RAW = "path string, reason string, part int, nth long, start_offset long, end_offset long, raw string"
CURSORS = "path string, offset long, line_number long, head_sha256 string, tail_sha256 string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def list_files(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files below folder, sorted; none if there is no such folder."""
    fs, root = file_system(folder)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix))


def probes(file, offset: int) -> list[str]:
    """Digests of the first bytes of a file, up to offset, and of those before offset."""
    size = min(PROBE, offset)
    return [hashlib.sha256(file.read_at(size, at)).hexdigest() for at in (0, offset - size)]


def last_line_end(file, size: int, least: int) -> int:
    """The place behind the last line feed at or behind least, found backwards from the end."""
    end = size
    while end > least:
        begin = max(least, end - BLOCK)
        at = file.read_at(end - begin, begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return least


class LogRange(InputPartition):
    """The lines of path that start from begin (where one starts if whole) to before end; bytes at
    stop and behind aren't read."""

    def __init__(self, path: str, reason: str, part: int, begin: int, end: int, whole: bool, stop: int):
        self.path, self.reason, self.part, self.begin, self.end, self.whole, self.stop = path, reason, part, begin, end, whole, stop


def ranges_of(path: str, reason: str, begin: int, stop: int) -> list[LogRange]:
    cuts = [*range(begin, stop, RANGE), stop]
    return [LogRange(path, reason, k, a, b, k == 0, stop) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def lines_of(file, part: LogRange) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes with their line feed) of the complete lines of a range."""
    at = part.begin if part.whole else part.begin - 1  # a line feed just before makes begin a start
    held, read, skip = b"", at, not part.whole
    while skip or at < part.end:
        cut = held.find(b"\n")
        parts = []
        if cut < 0:  # a line over several blocks is joined once
            parts = [held]
            while cut < 0 and read < part.stop:
                block = file.read_at(min(BLOCK, part.stop - read), read)
                if not block:
                    break
                read += len(block)
                cut = block.find(b"\n")
                parts.append(block)
            if cut < 0:
                return
            cut += sum(len(p) for p in parts[:-1])
            held = b"".join(parts)
        # all lines that the held bytes complete
        begin = 0
        while cut >= 0:
            if not skip:
                if at >= part.end:
                    return
                yield at, at + cut + 1 - begin, held[begin : cut + 1]
            at, skip, begin = at + cut + 1 - begin, False, cut + 1
            cut = held.find(b"\n", begin)
        held = held[begin:]


def batches_of(folder: str, part: LogRange) -> Iterator[pa.RecordBatch]:
    fs, _ = file_system(folder)
    names = [c.split(" ")[0] for c in RAW.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        same = [pa.array([v] * len(rows), t) for v, t in ((part.path, pa.string()), (part.reason, pa.string()), (part.part, pa.int32()))]
        return pa.RecordBatch.from_arrays(same + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    with fs.open_input_file(part.path) as file:
        rows, size, n, last = [], 0, 0, part.begin
        for start, end, raw in lines_of(file, part):
            n, last = n + 1, end
            text = raw[:-1].removesuffix(b"\r")
            text = text.removeprefix(b"\xef\xbb\xbf") if start == 0 else text
            if text.strip():
                rows.append((n, start, end, text.decode("utf-8", "replace")))
                size += len(text)
            if size >= BLOCK:
                yield batch(rows)
                rows, size = [], 0
        yield batch([*rows, (n, last, last, None)])


class _Reader:
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.cursors = json.loads(options.get("cursors", "{}"))

    def start(self, path: str, size: int, known: list | None) -> tuple[str, int]:
        """(reason, byte) to read from: new, resume, file_truncated or prefix_changed."""
        if known is None:
            return "new", 0
        if size < known[0]:
            return "file_truncated", 0
        with file_system(self.folder)[0].open_input_file(path) as file:
            return ("resume", known[0]) if probes(file, known[0]) == known[1:] else ("prefix_changed", 0)

    def read(self, part: LogRange | None) -> Iterator[pa.RecordBatch]:
        if part is not None:  # Spark asks once where there is no range
            yield from batches_of(self.folder, part)


class LogReader(_Reader, DataSourceReader):
    def partitions(self) -> list[LogRange]:
        out = []
        for path, size in list_files(self.folder, self.suffix):
            reason, begin = self.start(path, size, self.cursors.get(path))
            out += ranges_of(path, reason, begin, size)
        return out


class LogStream(_Reader, DataSourceStreamReader):
    """An offset has for every file the byte behind its last complete line, and its probes."""

    def initialOffset(self) -> dict:
        return self.cursors

    def latestOffset(self) -> dict:
        out, fs = {}, file_system(self.folder)[0]
        for path, size in list_files(self.folder, self.suffix):
            with fs.open_input_file(path) as file:
                end = last_line_end(file, size, 0)
                out[path] = [end, *probes(file, end)]
        return out

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        out = []
        for path, (stop, *_) in sorted(end.items()):
            reason, begin = self.start(path, stop, start.get(path))
            out += ranges_of(path, reason, begin, stop)
        return out

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    """Options: path (a folder), suffix (.jsonl), cursors (JSON: path to byte and two digests)."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def read_lines(spark: SparkSession, folder: str, stage: str, cursors: DataFrame | None = None, suffix: str = ".jsonl") -> tuple[DataFrame, DataFrame]:
    """(path, reason, line_number, start_offset, end_offset, raw of every line behind the cursors;
    cursors to keep once those are safely stored). What is read is first stored in the folder
    `stage`, so that files are read once; lines are numbered by sums of the ranges' counts. cursors
    hold a row a file, which the driver lists anyway. Without new lines the result is empty, and the
    cursors are as before, but for files that must be read again."""
    spark.dataSource.register(LogLines)
    known = {} if cursors is None else {r.path: r for r in cursors.collect()}
    told = json.dumps({p: [r.offset, r.head_sha256, r.tail_sha256] for p, r in known.items()})
    found = spark.read.format(SOURCE).option("suffix", suffix).option("cursors", told).load(folder)
    found.write.mode("overwrite").parquet(stage)
    raw = spark.read.schema(RAW).parquet(stage)
    before = spark.createDataFrame([(p, r.offset, r.line_number) for p, r in known.items()], "path string, _offset long, _line long")
    ends = raw.where("raw is null").join(before, "path", "left").withColumn("_line", F.when(F.col("reason") == "resume", F.col("_line")).otherwise(0))
    earlier = F.sum("nth").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ends.select("path", "part", (F.col("_line") + F.coalesce(earlier, F.lit(0))).alias("_first"))
    lines = raw.where("raw is not null").join(parts, ["path", "part"]).select("path", "reason", (F.col("_first") + F.col("nth")).alias("line_number"), "start_offset", "end_offset", "raw")
    after = ends.groupBy("path").agg(F.max("end_offset").alias("offset"), (F.first("_line") + F.sum("nth")).alias("line_number"))
    # a file without a new byte has no range, and keeps its cursor if it is there and unchanged
    kept = before.join(after, "path", "left_anti").where("_offset > 0").select("path", F.col("_offset").alias("offset"), F.col("_line").alias("line_number"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if fs.get_file_info(row["path"]).size is None or fs.get_file_info(row["path"]).size < row["offset"]:
                    continue
                with fs.open_input_file(row["path"]) as file:
                    rows.append((row["path"], row["offset"], row["line_number"], *probes(file, row["offset"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[c.split(" ")[0] for c in CURSORS.split(", ")])

    return lines, after.unionByName(kept).mapInArrow(probe, CURSORS)


def stream_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """A streaming DataFrame of path, reason, start_offset, end_offset, raw of the lines that files
    gain. A line's place is its byte; files that were cut or changed come again from the start."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format(SOURCE).option("suffix", suffix).load(folder).where("raw is not null").select("path", "reason", "start_offset", "end_offset", "raw")
