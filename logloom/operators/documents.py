"""Documents of a snapshot: blocks, previews, references, and the manifest over all of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.keys import prefixed_id

from .dedup import first_by, number_occurrences

# Documents in the order in which they are written; all others between the last two.
FOLDERS = ("messages/chunks/", "messages/pages/", "messages/summaries/")
FILES = ("messages.json", "errors.json", "decisions.json", "files.json", "recent.json", "dashboard.json")
LAST = "metadata.json"


def write_rank(path: Column) -> Column:
    """A document's place: chunks, pages, summaries, the named files, others, and the manifest."""
    rank = F.when(F.lit(False), F.lit(0))
    for k, folder in enumerate(FOLDERS):
        rank = rank.when(path.startswith(folder), k)
    for k, name in enumerate(FILES, len(FOLDERS)):
        rank = rank.when(path == name, k)
    after = len(FOLDERS) + len(FILES)
    return rank.when(path == LAST, after + 1).otherwise(after)


def manifest(documents: DataFrame, by: list[str], path: str, body: str) -> DataFrame:
    """by and entries of every document but the manifest itself: array<struct<path, bytes, sha256>>
    by path; documents and bytes in all."""
    rows = documents.where(F.col(path) != LAST)
    entry = F.struct(F.col(path).alias("path"), F.octet_length(body).alias("bytes"), F.sha2(F.col(body), 256).alias("sha256"))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.count("*").alias("documents"), F.sum(F.octet_length(body)).alias("bytes"))


def valid_manifest(paths: Column, hashes: Column) -> Column:
    """Whether a commit's paths are sorted and distinct, and its hashes 64 lower-case hex digits."""
    fine = (F.size(paths) > 0) & (F.size(paths) == F.size(hashes)) & (F.array_sort(paths) == paths) & (F.size(F.array_distinct(paths)) == F.size(paths))
    return F.coalesce(fine & F.forall(hashes, lambda h: h.rlike("^[0-9a-f]{64}$")), F.lit(False))


def with_references(messages: DataFrame, references: DataFrame, by: list[str], ident: str, sources: str, path: str) -> DataFrame:
    """messages with referenced: the sorted distinct paths of the references that name them among
    their sources (an array); empty without any."""
    named = references.select(*by, F.explode(sources).alias(ident), F.col(path).alias("_path"))
    found = named.groupBy(*by, ident).agg(F.array_sort(F.collect_set("_path")).alias("referenced"))
    return messages.join(found, [*by, ident], "left").withColumn("referenced", F.coalesce("referenced", F.array().cast("array<string>")))


def own_mentions(named: DataFrame, mentions: DataFrame, by: list[str]) -> DataFrame:
    """named (a message and a reference that names it as a source, by the columns by) with mentions:
    those of this message, as sorted structs of the other columns. One that isn't mentioned, or has
    a null in by, stops the job. What is gathered is one message's alone."""
    rest = F.struct(*[c for c in mentions.columns if c not in by])
    found = mentions.groupBy(*by).agg(F.array_sort(F.collect_list(rest)).alias("_mentions"))
    fault = F.raise_error(F.lit("a reference doesn't mention its message"))
    return named.join(found, by, "left").select(*named.columns, F.when(F.col("_mentions").isNotNull(), F.col("_mentions")).otherwise(fault).alias("mentions"))


def turn_documents(turns: DataFrame, messages: DataFrame, by: list[str], ident: str, text: str, first: str, last: str, start: str) -> DataFrame:
    """turns with previews of the messages that first and last name; a turn without a start, or
    without its first message, is left out."""
    previews = messages.select(*by, F.col(ident).alias("_id"), F.col(text).alias("_text"))
    out = turns.where(F.col(start).isNotNull())
    for name, column in (("request", first), ("reply", last)):
        out = out.join(previews.select(*by, F.col("_id").alias(column), F.col("_text").alias(name)), [*by, column], "left")
    return out.where(F.col("request").isNotNull())


def first_warnings(warnings: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
    """Adds warning_id, made of the parts; of equal ones the first stays."""
    named = warnings.withColumn("warning_id", prefixed_id("warning", *[F.col(p) for p in parts]))
    return first_by(named, ["warning_id"], order)


def number_mentions(mentions: DataFrame, message: str, key: str, order: str) -> DataFrame:
    """Mentions once for each key of a message, numbered from 1 in the order given."""
    return number_occurrences(first_by(mentions, [message, key], [F.col(order)]), [message], [F.col(order)], "ordinal")


def distinct_paths(candidates: DataFrame, by: list[str], path: str, position: str) -> DataFrame:
    """Of paths that differ in case only the first seen, in order of position."""
    return first_by(candidates.withColumn("_folded", F.lower(path)), [*by, "_folded"], [F.col(position)]).drop("_folded")


def storage_mode(detail: Column, complete: Column, message: Column, most: int = 4000) -> Column:
    """How a document keeps an error's detail: inline while it is short, else by reference to its
    message, else as a preview; an incomplete one only as a preview. Null without detail."""
    return F.when(detail.isNull(), None).when(~complete, "preview_only").when(F.length(detail) <= most, "inline").when(message.isNotNull(), "message_reference").otherwise("preview_only")


def change_document(changes: DataFrame) -> DataFrame:
    """One struct a change: path, old_path, status (of index, worktree and commits), numstat of the
    three scopes, binary and scopes."""
    numstat = F.struct("staged", "unstaged", "committed_in_session")
    status = F.struct("index", "worktree", F.col("committed").alias("committed_in_session"))
    return changes.withColumn("document", F.struct("path", "old_path", status.alias("status"), numstat.alias("numstat"), "binary", "scopes"))


def visible(role: Column, kind: Column) -> Column:
    """What users see as conversation: chat of users and assistants."""
    return F.coalesce(role.isin("user", "assistant") & (kind == "chat"), F.lit(False))


def parts_of_kind(parts: Column, kind: str) -> Column:
    return F.filter(parts, lambda p: p["kind"] == kind)


def text_length(parts: Column) -> Column:
    """Characters of all parts' texts."""
    return F.aggregate(parts, F.lit(0), lambda n, p: n + F.coalesce(F.length(p["text"]), F.lit(0)))


def with_status(parts: Column, status: Column, duration: Column) -> Column:
    """parts (kind, text) with their status replaced by this one, at the end, and the duration."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    kept = F.filter(parts, lambda p: p["kind"] != "status")
    timed = F.when(duration.isNotNull(), F.array(part("duration_seconds", duration.cast("string")))).otherwise(F.slice(F.array(part("", F.lit(""))), 1, 0))
    return F.concat(kept, F.array(part("status", status)), timed)


def evidence_hash(*inputs: Column) -> Column:
    """A digest of named inputs that nulls and empty texts don't confuse."""
    return F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)


def content_blocks(messages: DataFrame, ident: str, text: str) -> DataFrame:
    """One row for each block of a message's text: ident, position (from 1), kind text or code,
    language, body, block_id. A text with an unclosed fence is one block."""
    fence = r"(?ms)^```([^\n`]*)\n(.*?)^```[ \t]*$\n?"
    whole = F.coalesce(F.col(text), F.lit(""))
    fences = F.regexp_count(whole, F.lit(r"(?m)^```"))
    codes = F.arrays_zip(F.regexp_extract_all(whole, F.lit(fence), 1).alias("language"), F.regexp_extract_all(whole, F.lit(fence), 2).alias("body"))
    between = F.split(F.regexp_replace(whole, fence, "\0"), "\0")
    closed = (fences % 2 == 0) & (2 * F.size(codes) == fences) & ~whole.contains("\0")
    none = F.lit(None).cast("string")
    def block(kind: str, language: Column, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), language.alias("language"), body.alias("body"))
    pairs = F.transform(between, lambda body, at: F.array(block("text", none, body), block("code", F.nullif(F.get(codes, at)["language"], F.lit("")), F.get(codes, at)["body"])))
    cut = F.filter(F.flatten(pairs), lambda b: b["body"].isNotNull() & ((b["kind"] == "code") | (b["body"] != "")))
    blocks = F.when(closed, cut).otherwise(F.array(block("text", none, whole)))
    rows = messages.select(ident, F.posexplode(blocks).alias("at", "b")).withColumn("position", F.col("at") + 1)
    return rows.select(ident, "position", "b.kind", "b.language", "b.body", prefixed_id("block", F.col(ident), F.col("position")).alias("block_id"))


def fitting_prefix(texts: DataFrame, text: str, most: int, name: str = "prefix") -> DataFrame:
    """Adds the longest prefix of whole characters whose JSON string takes at most `most` bytes."""
    def size(s: str) -> int:
        return len(json.dumps(s, ensure_ascii=False).encode("utf-8", "surrogatepass"))

    def fit(s: str | None) -> str | None:
        if s is None or size(s) <= most:
            return s
        low, high = 0, min(len(s), most)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(s[:middle]) <= most else (low, middle - 1)
        return s[:low]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, pa.array([fit(s) for s in batch[text].to_pylist()], pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{schema}, `{name}` string")


def last_pages(paged: DataFrame, by: list[str], page: str, shown: Column) -> DataFrame:
    """Rows of the newest `shown` pages of a group, as older ones are loaded on demand."""
    last = paged.groupBy(*by).agg(F.max(page).alias("_last"))
    return paged.join(last, by).where(F.col(page) > F.col("_last") - shown).drop("_last")


def of_category(messages: DataFrame, category: str, wanted: str) -> DataFrame:
    """The messages of a category, or all."""
    return messages if wanted == "all" else messages.where(F.col(category) == wanted)


def newest_first(rows: DataFrame, at: str, *then: str) -> DataFrame:
    """Sorted by time as text, newest first; those without time last."""
    return rows.orderBy(F.coalesce(F.col(at).cast("string"), F.lit("")).desc(), *then)


def merged_streams(*streams: DataFrame, at: str, ident: str) -> DataFrame:
    """The messages of several sessions in one order."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.orderBy(at, ident)


def health(services: DataFrame, name: str, fine: Column, free_bytes: Column, reserve: int = 1 << 30) -> DataFrame:
    """One row: status (ok, or degraded if a service isn't fine or has less than the reserve free),
    services, and the sorted names of those at fault."""
    bad = ~F.coalesce(fine, F.lit(False)) | F.coalesce(free_bytes < reserve, F.lit(False))
    return services.agg(F.when(F.count_if(bad) > 0, "degraded").otherwise("ok").alias("status"), F.count("*").alias("services"), F.array_sort(F.collect_set(F.when(bad, F.col(name)))).alias("at_fault"))


def unchecked_task(lines: DataFrame, by: list[str], line: str, text: str) -> DataFrame:
    """by and task: the first item of a task list that isn't ticked."""
    task = F.regexp_extract(text, r"^\s*-\s+\[ \]\s+(.*\S)\s*$", 1)
    return lines.withColumn("task", task).where("task != ''").groupBy(*by).agg(F.min_by("task", line).alias("task"))


def within_roots(candidates: DataFrame, roots: DataFrame, by: list[str], path: str, root: str, position: str) -> DataFrame:
    """by, path and root: the first candidate that is an allowed root or lies under one, with its
    longest root; paths meet without regard to case."""
    # every ancestor of a path is a key of its own, so that roots meet by equality
    parts = F.split(F.lower(F.regexp_replace(F.col(path), "/+$", "")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    named = roots.select(F.lower(F.regexp_replace(F.col(root), "/+$", "")).alias("_key"), F.col(root))
    met = candidates.withColumn("_key", F.explode(above)).join(named, "_key")
    return first_by(met, by, [F.col(position), F.length("_key").desc(), F.col(root)]).select(*by, path, root)


