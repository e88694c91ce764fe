"""An outbox: snapshots are stored before they are sent, and acknowledged after they are committed.

Below a root, `items/<number>` holds a snapshot's documents, `ready/<number>.json` says that they
are whole and what they must hash to, and `done/<number>.json` that they were committed. Numbers
rise over all workspaces. A run that is lost at any step leaves an item that isn't ready, which is
never sent and whose number stays unused, or one that is ready and is sent again; the delivery id
is fixed when it is queued, so that the receiver counts it once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.keys import digest, safe_identifier
from logloom.operators.publish import create_once, manifest_digest, manifest_of, verify_version

ITEM = "number long, workspace string, snapshot string, delivery_id string, files long, bytes long, digest string"


def _marks(spark: SparkSession, root: str, kind: str, schema: str = ITEM) -> DataFrame:
    try:
        return spark.read.schema(schema).json(f"{root}/{kind}/*.json")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _claim(spark: SparkSession, root: str) -> int:
    """The next free number; of several writers each gets one of its own."""
    number = (_marks(spark, root, "claims", "number long").agg(F.max("number")).first()[0] or 0) + 1
    while not create_once(spark, f"{root}/claims/{number:020d}.json", json.dumps({"number": number})):
        number += 1
    return number


def enqueue(documents: DataFrame, root: str, workspace: str, snapshot: str) -> int:
    """Stores documents (path, body) as an item and returns its number. They are read back before
    the item is ready. Without documents, or with unsafe names or repeated paths, it stops."""
    spark = documents.sparkSession
    fine = documents.groupBy("path").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    names = spark.range(1).select(safe_identifier(F.lit(workspace)) & safe_identifier(F.lit(snapshot))).first()
    if not names[0] or not fine.n or fine.most > 1:
        raise ValueError("an item needs safe names and documents with a path each")
    number = _claim(spark, root)
    wanted = manifest_digest(manifest_of(documents))
    documents.select("path", "body").write.parquet(f"{root}/items/{number:020d}")
    verify_version(spark, f"{root}/items/{number:020d}", wanted)
    ident = spark.range(1).select(digest(F.lit("delivery"), F.lit(workspace), F.lit(snapshot), F.lit(str(number)))).first()[0]
    item = {"number": number, "workspace": workspace, "snapshot": snapshot, "delivery_id": ident, "files": wanted[0], "bytes": wanted[1], "digest": wanted[2]}
    create_once(spark, f"{root}/ready/{number:020d}.json", json.dumps(item))
    return number


def pending(spark: SparkSession, root: str) -> DataFrame:
    """Items that are ready and not done, with their place in the order of sending."""
    done = _marks(spark, root, "done", "number long").select("number")
    return _marks(spark, root, "ready").join(done, "number", "left_anti").orderBy("number")


def send_next(spark: SparkSession, root: str, deliver: Callable[[dict, DataFrame], None]) -> int | None:
    """Checks the oldest pending item's documents against their digest, gives them to deliver
    (item, documents) and marks them done; returns its number, None without one. deliver returns
    once they are committed, and must take an item of a delivery id that it has had as done. An
    error of it leaves the item pending; a tampered item stops before anything is sent."""
    row = pending(spark, root).first()
    if row is None:
        return None
    path = f"{root}/items/{row.number:020d}"
    verify_version(spark, path, (row.files, row.bytes, row.digest))
    deliver(row.asDict(), spark.read.parquet(path))
    create_once(spark, f"{root}/done/{row.number:020d}.json", json.dumps({"number": row.number}))
    return row.number
