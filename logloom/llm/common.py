"""Helpers shared by the training-data operators: tables, shared storage, small maths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.storage import materialise, shared_dir, small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Deletes what materialise wrote for df, once nothing reads it any more."""
    spark, ours = df.sparkSession, f"{shared_dir(df.sparkSession)}/logloom/"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = fs.Path(ours)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    inside = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    for parent in {fs.Path(f).getParent().toString() for f in df.inputFiles()}:
        if fs.Path(parent).toUri().getPath().startswith(inside):
            system.delete(fs.Path(parent), True)


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of df's, whatever extra columns it has."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
