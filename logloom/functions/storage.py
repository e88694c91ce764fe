"""Tables stored between steps, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    spark.checkpoint.dir. Only where that is unset (tests, local mode) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs run within: what goes to Python at once is bounded by bytes, since a batch of so
    many rows of long texts has no bound that memory would hold."""
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back. It cuts the lineage, so a
    lost executor costs no recomputation of what lies before, and later passes reuse the rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
