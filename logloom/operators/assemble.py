"""Whole snapshots: messages and summaries routed to pages and chunks, an index, sections, and a
manifest made from the documents that are there.

Documents are rows of by (such as workspace and snapshot), path and body, in the one encoding of
publish.encode_json. No document depends on another's row but by its size and hash.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.keys import safe_filename

from .chunks import BLOCKS, chunk_documents
from .documents import LAST
from .publish import CHUNK_BYTES, encode_json
from .snapshot import page_by_bytes

#: Items of a page and its bytes.
PAGE_ITEMS, PAGE_BYTES = 100, 524_288
#: Bytes of a page that its own fields may take; what indenting its items adds is counted for them.
ENVELOPE = 4096

SPLIT = "struct<content:string,chunks:array<struct<path:string,body:string>>>"


def encoded(body: Column) -> Column:
    """A JSON text in the encoding of documents."""
    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: encode_json(json.loads(b)), na_action="ignore")

    return run(body)


def _digest_fields(body: Column) -> list[Column]:
    return [F.octet_length(body).alias("byte_size"), F.sha2(body, 256).alias("sha256")]


def split_messages(messages: DataFrame, by: list[str], most: int) -> DataFrame:
    """messages with content (JSON) and chunks: blocks whose document would exceed `most` bytes go
    into chunk documents, of which the content keeps paths, sizes and hashes."""
    names = ["workspace_id", "snapshot_id", "generated_at"]

    @F.pandas_udf(SPLIT)
    def cut(ids: pd.Series, stems: pd.Series, lists: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        import hashlib

        rows = []
        for ident, stem, blocks, context in zip(ids, stems, lists, contexts, strict=True):
            plain = [{"kind": b["kind"], "language": b["language"], "text": b["text"] or ""} for b in ([] if blocks is None else blocks)]
            whole = encode_json(plain).encode()
            if len(whole) <= most:
                rows.append((json.dumps({"kind": "blocks", "blocks": plain}, ensure_ascii=False), []))
                continue
            made = [encode_json(d) for d in chunk_documents(dict(zip(names, context.split("\0"), strict=True)), ident, plain, most)]
            chunks = [{"path": f"messages/chunks/{stem}-part-{k:06d}.json", "body": body} for k, body in enumerate(made, 1)]
            links = [{"path": c["path"], "part": k, "byte_size": len(c["body"].encode()), "sha256": hashlib.sha256(c["body"].encode()).hexdigest()} for k, c in enumerate(chunks, 1)]
            content = {"kind": "chunked_blocks", "original_byte_size": len(whole), "chunk_count": len(links), "chunks": links, "sha256": hashlib.sha256(whole).hexdigest()}
            rows.append((json.dumps(content), chunks))
        return pd.DataFrame(rows, columns=["content", "chunks"])

    context = F.concat_ws("\0", *(F.col(c).cast("string") if c in messages.columns else F.lit("") for c in names))
    made = cut(F.col("message_id"), safe_filename(F.col("message_id")), F.col("blocks").cast(BLOCKS), context)
    return messages.withColumn("_split", made).withColumns({"content": F.col("_split.content"), "chunks": F.col("_split.chunks")}).drop("_split", "blocks")


def paged_documents(items: DataFrame, by: list[str], folder: str, data_type: str, most_items: int = PAGE_ITEMS, most_bytes: int = PAGE_BYTES) -> DataFrame:
    """Page documents of items (by, sequence, item as JSON): by, page, path, body, first_sequence,
    last_sequence, items. A page holds its items in order within both bounds, as encoded with its
    own fields; a larger item has one of its own."""
    body = encoded(F.col("item"))
    # an item's lines stand four spaces further right within a page, with a comma at the end
    size = F.octet_length(body) + 5 * F.regexp_count(body, F.lit("\n")) + 1
    sized = items.withColumn("_size", size)
    paged = page_by_bytes(sized, by, "sequence", "_size", most_items, most_bytes - ENVELOPE).join(items, [*by, "sequence"])
    listed = F.array_sort(F.collect_list(F.struct("sequence", "item")))["item"]  # of one page
    pages = paged.groupBy(*by, "page").agg(listed.alias("_items"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("items"))
    fields = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit(data_type).alias("data_type"), *by, "page"))
    whole = F.concat(F.regexp_replace(fields, r"\}$", ""), F.lit(',"items":['), F.array_join("_items", ","), F.lit("]}"))
    path = F.concat(F.lit(f"{folder}/page-"), F.lpad(F.col("page").cast("string"), 6, "0"), F.lit(".json"))
    return pages.select(*by, "page", path.alias("path"), encoded(whole).alias("body"), "first_sequence", "last_sequence", "items")


def build_snapshot(messages: DataFrame, summaries: DataFrame, sections: dict[str, DataFrame], by: list[str], most_chunk: int = CHUNK_BYTES, most_items: int = PAGE_ITEMS, most_bytes: int = PAGE_BYTES) -> DataFrame:
    """by, path, body of all documents of the snapshots that messages name.

    messages: by, message_id, blocks (chunks.BLOCKS), sequence and further fields, generated_at
    among them if there is one; summaries: by, sequence and further fields; sections: for a document's name
    (errors, decisions, files) a table of by and its rows' fields, which need a column sequence to
    be sorted by. Snapshots without rows in a section have it empty. The index and the manifest
    (metadata.json) are derived from the bodies that they list.
    """
    of = messages.select(*by).distinct()
    split = split_messages(messages, by, most_chunk)
    chunks = split.select(*by, F.explode("chunks").alias("_c")).select(*by, "_c.*")
    fields = [c for c in split.columns if c not in (*by, "content", "chunks", "generated_at")]
    item = F.concat(F.regexp_replace(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), r"\}$", ""), F.lit(',"content":'), F.col("content"), F.lit("}"))
    pages = paged_documents(split.select(*by, "sequence", item.alias("item")), by, "messages/pages", "message_page", most_items, most_bytes)
    told = [c for c in summaries.columns if c not in by]
    summary_item = F.to_json(F.struct(*told), {"ignoreNullFields": "false"})
    summary_pages = paged_documents(summaries.select(*by, "sequence", summary_item.alias("item")), by, "change-summaries/pages", "change_summary_page", most_items, most_bytes)
    head = lambda name: [F.lit("1.0").alias("schema_version"), F.lit(name).alias("data_type"), *by]

    def listed(found: DataFrame, name: str) -> DataFrame:
        link = F.struct("page", "path", "first_sequence", "last_sequence", "items", *_digest_fields(F.col("body")))
        return found.groupBy(*by).agg(F.array_sort(F.collect_list(link)).alias(name))  # a row a page

    index = of.join(listed(pages, "pages"), by, "left").join(listed(summary_pages, "summary_pages"), by, "left")
    documents = [chunks, pages.select(*by, "path", "body"), summary_pages.select(*by, "path", "body")]
    documents.append(index.select(*by, F.lit("messages.json").alias("path"), encoded(F.to_json(F.struct(*head("messages"), *(F.coalesce(c, F.array()).alias(c) for c in ("pages", "summary_pages"))))).alias("body")))
    for name, rows in sections.items():
        kept = [c for c in rows.columns if c not in by]
        found = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sequence", F.struct(*kept).alias("row"))))["row"].alias("items"))
        whole = of.join(found, by, "left")
        made = F.to_json(F.struct(*head(name), F.coalesce("items", F.array()).alias("items")), {"ignoreNullFields": "false"})
        documents.append(whole.select(*by, F.lit(f"{name}.json").alias("path"), encoded(made).alias("body")))
    return reduce(DataFrame.unionByName, documents)


def with_manifest(documents: DataFrame, by: list[str]) -> DataFrame:
    """documents (by, path, body), as they were stored, and metadata.json of each snapshot: paths,
    sizes and hashes of the others."""
    link = F.struct("path", *_digest_fields(F.col("body")))
    found = documents.where(F.col("path") != LAST).groupBy(*by).agg(F.array_sort(F.collect_list(link)).alias("files"), F.sum(F.octet_length("body")).alias("total"))
    body = encoded(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit("metadata").alias("data_type"), *by, F.size("files").alias("file_count"), F.col("total").alias("byte_size"), "files")))
    return documents.where(F.col("path") != LAST).select(*by, "path", "body").unionByName(found.select(*by, F.lit(LAST).alias("path"), body.alias("body")))


LINK = "array<struct<path:string,byte_size:long,sha256:string>>"


def snapshot_faults(documents: DataFrame, by: list[str]) -> DataFrame:
    """by, path, fault, source of every link of manifest, index and pages that doesn't hold: missing (no such
    document), changed (other bytes), and unlisted (a document that the manifest lacks)."""
    content = F.from_json("body", f"pages {LINK}, summary_pages {LINK}, files {LINK}, items array<struct<content:struct<chunks:{LINK}>>>")
    none = F.array().cast(LINK)
    inner = F.flatten(F.transform(F.coalesce(content["items"], F.array().cast(f"array<struct<content:struct<chunks:{LINK}>>>")), lambda i: F.coalesce(i["content"]["chunks"], none)))
    links = F.concat(*(F.coalesce(content[c], none) for c in ("pages", "summary_pages", "files")), inner)
    told = documents.where((F.col("path") == LAST) | (F.col("path") == "messages.json") | F.col("path").startswith("messages/pages/")).select(*by, F.col("path").alias("source"), F.explode(links).alias("_l")).select(*by, "source", "_l.*")
    there = documents.select(*by, "path", *(c.alias(f"_{n}") for n, c in zip(("size", "hash"), (F.octet_length("body"), F.sha2("body", 256)), strict=True)))
    met = told.join(there, [*by, "path"], "left")
    fault = F.when(F.col("_hash").isNull(), "missing").when((F.col("_hash") != F.col("sha256")) | (F.col("_size") != F.col("byte_size")), "changed")
    wrong = met.withColumn("fault", fault).where("fault is not null").select(*by, "path", "fault", "source")
    listed = told.where(F.col("source") == LAST).select(*by, "path")
    extra = documents.where(F.col("path") != LAST).select(*by, "path").join(listed, [*by, "path"], "left_anti")
    return wrong.unionByName(extra.select(*by, "path", F.lit("unlisted").alias("fault"), F.lit(LAST).alias("source")))


def read_messages(documents: DataFrame, by: list[str]) -> DataFrame:
    """by, sequence, message_id and text of every message of stored snapshots, its blocks joined,
    wherever they are: in its page or in chunk documents."""
    blocks = "blocks array<struct<text:string>>"
    item = f"items array<struct<sequence:long,message_id:string,content:struct<kind:string,{blocks},chunks:{LINK}>>>"
    pages = documents.where(F.col("path").startswith("messages/pages/")).select(*by, F.explode(F.from_json("body", item)["items"]).alias("_i")).select(*by, "_i.*")
    text = lambda found: F.array_join(found["blocks"]["text"], "")
    whole = pages.where(F.col("content.kind") == "blocks").select(*by, "sequence", "message_id", text(F.col("content")).alias("text"))
    named = pages.where(F.col("content.kind") == "chunked_blocks").select(*by, "sequence", "message_id", F.posexplode("content.chunks").alias("_at", "_c")).select(*by, "sequence", "message_id", "_at", F.col("_c.path").alias("path"))
    stored = documents.where(F.col("path").startswith("messages/chunks/")).select(*by, "path", text(F.from_json("body", f"content struct<{blocks}>")["content"]).alias("text"))
    parts = named.join(stored, [*by, "path"]).groupBy(*by, "sequence", "message_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_at", "text")))["text"], "").alias("text"))
    return whole.unionByName(parts)
