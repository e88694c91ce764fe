"""Append-only JSONL logs with byte offsets, resumed from cursors.

Files are found and read by Spark's binaryFile source, so any file system that Spark reads will
do. A file's lines are cut within its task; a last line without its line feed waits for the next
read. What a line holds is judged by JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.records import is_object, strict_text

#: The record types of a session log.
RECORD_TYPES = ("session_meta", "turn_context", "response_item", "event_msg", "world_state", "compacted")

LINES = "path string, location string, modified timestamp, line_number long, start_offset long, end_offset long, raw string"
CURSORS = "path string, offset long, line_number long, prefix_sha256 string"


def find_files(spark: SparkSession, live: str, archive: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """path, location (live or archive), modified, length, content of every log file below the
    folders; a file met under two spellings of its path counts once, the live one first."""
    def read(folder: str, location: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        return files.select("path", F.lit(location).alias("location"), F.col("modificationTime").alias("modified"), "length", "content")
    files = read(live, "live")
    if archive:
        other = read(archive, "archive")
        seen = files.select(F.lower("path").alias("_p")).distinct()
        files = files.unionByName(other.join(seen, F.lower(other.path) == F.col("_p"), "left_anti"))
    return files


def resume(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Adds offset and first_line to read from, and reason: new, resume, file_truncated or
    prefix_changed; the last two read from the start again."""
    known = cursors.select(F.col("path").alias("_path"), F.col("offset").alias("_offset"), F.col("line_number").alias("_line"), "prefix_sha256")
    joined = files.join(known, files.path == F.col("_path"), "left")
    reason = F.when(F.col("_offset").isNull(), "new").when(F.col("_offset") > F.col("length"), "file_truncated")
    prefix = F.sha2(F.substring("content", F.lit(1), F.col("_offset").cast("int")), 256)
    reason = reason.when(prefix != F.col("prefix_sha256"), "prefix_changed").otherwise("resume")
    joined = joined.withColumn("reason", reason)
    fine = F.col("reason") == "resume"
    return joined.withColumn("offset", F.when(fine, F.col("_offset")).otherwise(0)).withColumn("first_line", F.when(fine, F.col("_line")).otherwise(0)).drop("_path", "_offset", "_line", "prefix_sha256")


def cut_lines(files: DataFrame) -> DataFrame:
    """Rows of LINES: every complete line of each file from its offset on, with physical numbers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                at, number, rows = file["offset"], file["first_line"], []
                content = file["content"]
                while (end := content.find(b"\n", at)) >= 0:
                    number += 1
                    raw = content[at:end].removesuffix(b"\r")
                    raw = raw.removeprefix(b"\xef\xbb\xbf") if at == 0 else raw
                    if raw.strip():
                        rows.append((number, at, end + 1, raw.decode("utf-8", "replace")))
                    at = end + 1
                if rows:
                    n = len(rows)
                    same = [pa.array([file[c]] * n, t) for c, t in (("path", pa.string()), ("location", pa.string()), ("modified", pa.timestamp("us", "UTC")))]
                    own = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*same, *own], names=[c.split(" ")[0] for c in LINES.split(", ")])

    return files.select("path", "location", "modified", "content", F.col("offset").cast("long"), F.col("first_line").cast("long")).mapInArrow(cut, LINES)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds timestamp, record_type, payload (VARIANT) and issue: malformed_json, invalid_record,
    unknown_record_type, or null for a good record. Raw text goes."""
    v = lines.withColumn("v", F.try_parse_json("raw"))
    kind = strict_text(F.col("v"), "$.type")
    at = strict_text(F.col("v"), "$.timestamp")
    issue = F.when(F.col("v").isNull(), "malformed_json")
    issue = issue.when(kind.isNull() | at.isNull() | ~is_object(F.col("v"), "$.payload"), "invalid_record")
    issue = issue.when(~kind.isin(*RECORD_TYPES), "unknown_record_type")
    return v.select(*[c for c in lines.columns if c != "raw"], at.alias("timestamp"), kind.alias("record_type"), F.try_variant_get("v", "$.payload", "variant").alias("payload"), issue.alias("issue"))


def advance(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Cursors after a read: the end of the last complete line of each file, or where it began."""
    ends = lines.groupBy("path").agg(F.max("end_offset").alias("_end"), F.max("line_number").alias("_last"))
    joined = files.join(ends, "path", "left")
    end = F.coalesce("_end", "offset").cast("long")
    return joined.select("path", end.alias("offset"), F.coalesce("_last", "first_line").cast("long").alias("line_number"), F.sha2(F.substring("content", F.lit(1), end.cast("int")), 256).alias("prefix_sha256"))


def read_log(spark: SparkSession, live: str, archive: str | None = None, cursors: DataFrame | None = None, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(records and issues, cursors to keep once those are safely stored)."""
    cursors = cursors if cursors is not None else spark.createDataFrame([], CURSORS)
    files = resume(find_files(spark, live, archive, pattern), cursors)
    lines = cut_lines(files)
    return parse_lines(lines), advance(files, lines)


def session_index(records: DataFrame) -> DataFrame:
    """One row a session: session_id, current_path, n_files, n_records and last_at. A file's
    session is the id of its last session_meta, else the one in its name, else its path's digest;
    the current file is the newest, live before archive."""
    good = records.where("issue is null")
    meta = F.when(F.col("record_type") == "session_meta", strict_text(F.col("payload"), "$.id"))
    named = F.regexp_extract("path", r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1)
    files = good.groupBy("path", "location", "modified").agg(F.max_by(meta, F.when(meta.isNotNull(), F.col("line_number"))).alias("meta"), F.max("timestamp").alias("last_at"), F.count("*").alias("n"))
    files = files.withColumn("session_id", F.coalesce("meta", F.when(named != "", named), F.substring(F.sha2("path", 256), 1, 32)))
    newest = F.max_by("path", F.struct("last_at", "modified", (F.col("location") == "live").alias("live"), "path"))
    return files.groupBy("session_id").agg(newest.alias("current_path"), F.count("*").alias("n_files"), F.sum("n").alias("n_records"), F.max("last_at").alias("last_at"))
