"""Chunks, validated documents, idempotent receipts, and published snapshots behind a pointer."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.keys import safe_identifier, safe_path, sum_of_hex

CHUNK_BYTES = 262_144


def split_utf8(text: str, most: int) -> list[str]:
    """Parts of at most so many UTF-8 bytes (4 at least), cut after a line where one ends in the
    part, never within a character; joined they are the text."""
    parts, data, at = [], text.encode(), 0
    while at < len(data):
        end = min(at + max(most, 4), len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        line = data.rfind(b"\n", at, end) + 1
        if end < len(data) and line > at:
            end = line
        parts.append(data[at:end].decode())
        at = end
    return parts or [""]


def chunked(rows: DataFrame, text: str, most: int = CHUNK_BYTES) -> DataFrame:
    """Rows with text replaced by its chunks: adds part (from 1) and parts. A null text has no
    chunk."""
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_utf8(t, most) if t is not None else None)

    exploded = rows.withColumn("_parts", cut(F.col(text))).select("*", F.posexplode("_parts").alias("_at", "_chunk"))
    return exploded.withColumn("part", F.col("_at") + 1).withColumn("parts", F.size("_parts")).withColumn(text, F.col("_chunk")).drop("_parts", "_at", "_chunk")


def fenced_blocks(text: Column) -> Column:
    """array<struct<kind, language, body>>: text and code in turn; with an odd number of fences the
    whole is one text."""
    fences = F.regexp_count(text, F.lit(r"(?m)^```"))
    pieces = F.split(text, r"(?m)^```")
    def one(piece: Column, at: Column) -> Column:
        code = at % 2 == 1
        language = F.regexp_extract(piece, r"^([^\n]*)\n", 1)
        body = F.when(code, F.regexp_replace(piece, r"^[^\n]*\n", "")).otherwise(F.regexp_replace(piece, r"^\n", ""))
        return F.struct(F.when(code, "code").otherwise("text").alias("kind"), F.when(code & (language != ""), language).alias("language"), body.alias("body"))
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("language"), text.alias("body")))
    return F.when(fences % 2 == 1, whole).otherwise(F.filter(F.transform(pieces, one), lambda b: b["body"] != ""))


def encode_json(value: object) -> str:
    """The one encoding of documents: two spaces, letters as they are, a line feed at the end."""
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"


def document_issues(documents: DataFrame, path: str, body: str, workspace: str, snapshot: str) -> DataFrame:
    """path and issue of every document that may not be published: unsafe_path, case_collision,
    bad_json (doubled keys included), missing_field, wrong_version, wrong_identity."""
    v = F.try_parse_json(body)
    text = lambda field: F.try_variant_get(v, f"$.{field}", "string")
    twins = documents.groupBy(F.lower(path).alias("_folded")).agg(F.count("*").alias("_n"))
    rows = documents.join(twins, F.lower(documents[path]) == F.col("_folded"))
    missing = text("data_type").isNull() | text("generated_at").isNull() | text("snapshot_id").isNull() | text("workspace_id").isNull()
    issue = F.when(~safe_path(F.col(path)), "unsafe_path").when(F.col("_n") > 1, "case_collision").when(v.isNull(), "bad_json").when(missing, "missing_field")
    issue = issue.when(~F.coalesce(text("schema_version").rlike(r"^1\.\d+$"), F.lit(False)), "wrong_version")
    issue = issue.when((text("workspace_id") != workspace) | (text("snapshot_id") != snapshot), "wrong_identity")
    return rows.select(F.col(path).alias("path"), issue.alias("issue")).where("issue is not null")


def receive(receipts: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (delivery_id, body_sha256) with state new, repeated or conflict: an id counts once,
    and never for another body. Of an id met twice in incoming the first by hash is new."""
    known = receipts.select("delivery_id", F.col("body_sha256").alias("_known"))
    first = incoming.groupBy("delivery_id").agg(F.min("body_sha256").alias("_first"))
    rows = incoming.distinct().join(first, "delivery_id").join(known, "delivery_id", "left")
    expected = F.coalesce("_known", "_first")
    return rows.select("delivery_id", "body_sha256", F.when(F.col("body_sha256") != expected, "conflict").when(F.col("_known").isNotNull(), "repeated").otherwise("new").alias("state"))


class Conflict(Exception):
    """Another writer was first."""


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with a text, whole or not at all; False if there is one already. The text is
    written beside it and renamed, which fails where the name is taken."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    system.mkdirs(target.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = system.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else system.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(system.makeQualified(beside), system.makeQualified(target), options)
        return True
    except Py4JJavaError as e:
        system.delete(beside, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or system.exists(target):
            return False
        raise


def manifest_of(documents: DataFrame) -> DataFrame:
    """path, bytes, sha256 of documents (path, body)."""
    return documents.select("path", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("sha256"))


def manifest_digest(manifest: DataFrame) -> tuple[int, int, str]:
    """(files, bytes, digest): the digest is the sum of the rows' own digests modulo 2**256, so it
    needs no order and no row collects the others."""
    row = F.sha2(F.concat_ws("\0", "path", F.col("bytes").cast("string"), "sha256"), 256)
    found = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), sum_of_hex(row).alias("digest")).first()
    return found.n, found.bytes, found.digest


def publish(documents: DataFrame, root: str, workspace: str, snapshot: str, expected: int | None = None) -> int:
    """Writes documents (path, body) as a version, reads it back against their manifest, then moves
    the pointer that makes it current; returns the pointer's number.

    The pointer is a numbered file that can be made once: of two writers that saw the same number
    (expected, or what is there now) one gets Conflict. A broken attempt can be repeated; what is
    current already is not published again. Documents with issues, and a version that reads back
    otherwise than it was written, stop it.
    """
    spark = documents.sparkSession
    names = spark.createDataFrame([(workspace, snapshot)], "w string, s string").select(safe_identifier(F.col("w")) & safe_identifier(F.col("s"))).first()
    if not names[0]:
        raise ValueError("unsafe workspace or snapshot id")
    issues = document_issues(documents, "path", "body", workspace, snapshot).limit(5).collect()
    if issues:
        raise ValueError(f"documents with issues: {issues}")
    last = pointers(spark, root).where(F.col("workspace") == workspace).orderBy(F.desc("sequence")).first()
    number = last.sequence if last else 0
    if expected is not None and expected != number:
        raise Conflict(f"pointer {number} of {workspace} is current, not {expected}")
    wanted = manifest_digest(manifest_of(documents))
    if last and (last.snapshot, last.digest) == (snapshot, wanted[2]):
        return number
    # a folder of its own, so that another writer of this name, or a reader, isn't disturbed
    version = f"versions/workspace={workspace}/snapshot={snapshot}/{wanted[2][:16]}-{uuid.uuid4().hex[:8]}"
    documents.select("path", "body", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("sha256")).write.parquet(f"{root}/{version}")
    verify_version(spark, f"{root}/{version}", wanted)
    pointer = {"workspace": workspace, "snapshot": snapshot, "sequence": number + 1, "version": version, "files": wanted[0], "bytes": wanted[1], "digest": wanted[2]}
    if not create_once(spark, f"{root}/pointers/{workspace}/{number + 1:020d}.json", json.dumps(pointer)):
        raise Conflict(f"pointer {number + 1} of {workspace} was made by another writer")
    return number + 1


def verify_version(spark: SparkSession, path: str, wanted: tuple[int, int, str]) -> None:
    """Stops unless the documents stored at path have this manifest, by their own bytes."""
    stored = spark.read.parquet(path)
    found = manifest_digest(manifest_of(stored))
    if found != tuple(wanted):
        raise ValueError(f"what is stored at {path} isn't what was to be: {found}, not {tuple(wanted)}")


POINTER = "workspace string, snapshot string, sequence long, version string, files long, bytes long, digest string"


def pointers(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(POINTER).json(f"{root}/pointers/*/*.json")
    except AnalysisException:
        return spark.createDataFrame([], POINTER)


def current(spark: SparkSession, root: str) -> DataFrame:
    """workspace and the snapshot that its last pointer names."""
    return pointers(spark, root).groupBy("workspace").agg(F.max_by("snapshot", "sequence").alias("snapshot"))


def read_current(spark: SparkSession, root: str, workspace: str) -> DataFrame:
    """The documents of a workspace's current snapshot."""
    row = pointers(spark, root).where(F.col("workspace") == workspace).orderBy(F.desc("sequence")).first()
    if row is None:
        raise KeyError(workspace)
    return spark.read.parquet(f"{root}/{row.version}")


def changed_bodies(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose hash the manifest (path, sha256) doesn't confirm."""
    return documents.join(manifest.select("path", F.col("sha256").alias("_sent")), "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_sent"))).drop("_sent")
