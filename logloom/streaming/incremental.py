"""Incremental runs over growing logs: read, normalize, mask, deduplicate, store, then advance.

State is Parquet under one folder: versions of the cursors and of the rows. A run writes its rows
and its cursors as the next version, and only then the marker that makes them count; a run that
fails leaves nothing behind that the next would read, so its lines are read again, and
deduplication by identity keeps rows that a replay brings once more from counting twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from logloom.functions.redaction import assert_masked, redact_parts
from logloom.operators.dedup import dedup_records
from logloom.operators.normalize import fingerprinted, normalize
from logloom.sources.jsonl import CURSORS, parse_lines, read_log
from logloom.sources.ranges import stream_lines
from logloom.streaming.stateful import stream_identities


def _committed(spark: SparkSession, state: str) -> int:
    try:
        return spark.read.schema("version long").parquet(f"{state}/commits").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def rows_of(spark: SparkSession, state: str) -> DataFrame | None:
    """All rows of committed runs."""
    version = _committed(spark, state)
    return spark.read.parquet(*[f"{state}/rows/version={v}" for v in range(1, version + 1)]) if version else None


def cursors_of(spark: SparkSession, state: str) -> DataFrame:
    version = _committed(spark, state)
    return spark.read.schema(CURSORS).parquet(f"{state}/cursors/version={version}") if version else spark.createDataFrame([], CURSORS)


#: What tells native ids of one session apart.
TYPES = ("source_record_type", "source_payload_type")


def prepared(records: DataFrame, session=None) -> DataFrame:
    """Normalized, masked and fingerprinted rows of records, with session_id: session, a Column, or
    by default one of each file."""
    rows = normalize(records).withColumn("session_id", session if session is not None else F.substring(F.sha2("source_path", 256), 1, 16))
    return fingerprinted(checked(rows.withColumn("content", redact_parts(F.col("content")))))


def checked(rows: DataFrame) -> DataFrame:
    """rows with is_masked, which holds where the masking step left its list with every part of the
    content. A row that didn't go through it stops the job."""
    parts = rows.schema["content"].dataType.elementType
    went = F.forall("content", lambda p: p["redactions"].isNotNull()) if "redactions" in parts.names else F.size("content") == 0
    return rows.withColumn("is_masked", assert_masked(F.coalesce(went, F.lit(True)), F.lit(True)))


def run_once(spark: SparkSession, live: str, state: str, archive: str | None = None, session=None) -> int:
    """Reads what the logs gained since the last committed run; returns the run's version. session
    is a Column that names a row's session, by default its file."""
    version = _committed(spark, state) + 1
    records, cursors = read_log(spark, live, archive, cursors_of(spark, state))
    rows = prepared(records, session)
    # earlier rows of the same sessions count the occurrences before; they aren't written again
    known = rows_of(spark, state)
    place = [F.col("_old").desc(), F.col("at"), F.col("source_path"), F.col("start_offset")]
    new = rows.withColumn("_old", F.lit(0))
    if known is not None:
        same = known.drop("identity", "duplicate", "conflict").withColumn("_old", F.lit(1))
        new = new.unionByName(same.join(new.select("session_id").distinct(), "session_id", "left_semi"))
    unique = dedup_records(new, "session_id", "source_id", "fingerprint", ["source_path", "start_offset"], place, TYPES)
    unique.where("_old = 0 and not duplicate").drop("_old").write.mode("overwrite").parquet(f"{state}/rows/version={version}")
    cursors.write.mode("overwrite").parquet(f"{state}/cursors/version={version}")
    spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{state}/commits")
    return version


def follow(spark: SparkSession, live: str, state: str, session=None) -> None:
    """Reads what the logs below live gained and appends its rows to `state`/rows, each identity
    once, then ends; called again it goes on from there. What is read is behind the last run's end
    alone, and no earlier row is read or joined: identities are kept state. A file that was changed
    comes again as a whole, without counting twice."""
    lines = stream_lines(spark, live).withColumn("line_number", F.lit(None).cast("long"))
    rows = prepared(parse_lines(lines), session)
    kind = rows.schema
    judged = stream_identities(rows.withColumn("_row", F.to_json(F.struct(*rows.columns))), "session_id", "source_id", "fingerprint", "source_path", "start_offset", "at", TYPES, "_row")
    kept = judged.where("not duplicate").select(F.from_json("_row", kind).alias("_row"), "identity").select("_row.*", "identity")
    kept.writeStream.format("parquet").option("path", f"{state}/rows").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_latest(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """A streaming DataFrame without the repeats of a key that arrive within the given delay."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def upsert_batch(target: str, key: list[str], order: list[str] | None = None):
    """A foreachBatch function: each micro-batch is one folder by its number, so that a batch that
    is repeated overwrites itself and counts once. Read by latest_rows, where later batches win.
    Of a key's rows in a batch the last by order stays, of equal ones the greatest row, so that a
    repeated batch keeps the same."""
    def write(batch: DataFrame, number: int) -> None:
        whole = F.struct(*[F.col(c) for c in [*(order or []), *batch.columns]])
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), whole).alias("_row"))
        last.select("_row.*").write.mode("overwrite").parquet(f"{target}/batch={number}")
    return write


def latest_rows(spark: SparkSession, target: str, key: list[str]) -> DataFrame:
    """One row a key of what upsert_batch has written: that of the last batch."""
    rows = spark.read.parquet(target)
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*key, "batch")], F.lit(0).alias("_")), "batch").alias("_row"))
    return kept.select(*key, *[f"_row.{c}" for c in rows.columns if c not in (*key, "batch")])


def compact_batches(spark: SparkSession, target: str, compacted: str, key: list[str]) -> None:
    """Writes the rows of all batches, one a key, as batch 0 of another folder."""
    latest_rows(spark, target, key).write.mode("overwrite").parquet(f"{compacted}/batch=0")
