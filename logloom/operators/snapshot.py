"""Paging, manifests and previews of snapshot documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_by_count(rows: DataFrame, by: list[str], order: list[Column], size: int = 100) -> DataFrame:
    """Adds sequence (from 1, within by) and page (from 1)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("sequence", F.row_number().over(w)).withColumn("page", (F.floor((F.col("sequence") - 1) / size) + 1).cast("int"))


def page_by_bytes(rows: DataFrame, by: list[str], order: str, size: str, most_items: int, most_bytes: int) -> DataFrame:
    """by, order, page (from 1): items fill a page greedily until one more would exceed either
    bound; a larger item has a page of its own. Rows are sorted by group and order and read as they
    come, with three numbers as state, whatever a group's size."""
    used = rows.select(*by, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, page, items, used_bytes = object(), 0, 0, 0
        for batch in batches:
            pages = []
            for *key, n in zip(*(batch[c].to_pylist() for c in (*by, "_size")), strict=True):
                if key != group:
                    group, page, items, used_bytes = key, 1, 0, 0
                elif items and (items >= most_items or used_bytes + n > most_bytes):
                    page, items, used_bytes = page + 1, 0, 0
                items, used_bytes = items + 1, used_bytes + n
                pages.append(page)
            yield batch.drop_columns(["_size"]).append_column("page", pa.array(pages, pa.int32()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.drop("_size").schema)
    return used.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, f"{columns}, page int")


def page_manifest(paged: DataFrame, by: list[str], order: str, body: Column) -> DataFrame:
    """Per page: first and last sequence, items, bytes, and SHA-256 of the bodies in order."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), body.alias("body")))), lambda x: x["body"]), "\n")
    return paged.groupBy(*by, "page").agg(F.min(order).alias("first_sequence"), F.max(order).alias("last_sequence"), F.count("*").alias("items"), F.sum(F.octet_length(body)).alias("bytes"), F.sha2(parts, 256).alias("sha256"))


def tree_digest(files: DataFrame, by: list[str], path: str, size: str, sha256: str) -> DataFrame:
    """Per tree: files, bytes and a digest over its sorted (path, size, hash) lines."""
    line = F.concat_ws("\t", F.col(path), F.col(size).cast("string"), F.col(sha256))
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("tree_sha256"))


def path_collisions(files: DataFrame, path: str) -> DataFrame:
    """Paths that differ in case only, or repeat."""
    return files.groupBy(F.lower(path).alias("folded")).agg(F.count("*").alias("n")).where("n > 1")


def display_mode(role: Column, phase: Column, length: Column, most: int = 1000) -> Column:
    """collapsed for developer and tool messages, commentary, and long texts; else expanded."""
    return F.when(role.isin("developer", "system", "tool") | F.coalesce(phase == "commentary", F.lit(False)) | (length >= most), "collapsed").otherwise("expanded")


def message_category(role: Column, phase: Column) -> Column:
    return F.when(role.isin("developer", "system"), "internal").when(role == "tool", "tool").when(F.coalesce(phase == "commentary", F.lit(False)), "commentary").otherwise("chat")
