"""File mentions in messages: spans found by rules of falling precedence, classified by their text
alone, and summed by path. No file system is asked; what exists is told by a table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from logloom.functions.keys import bound, prefixed_id, stripped

# Endings known to be of files, the heads of the list of attachments, the marks after
# which a folder ends, and the words that may follow a path without a space.
EXTENSIONS = (
    "bat c cfg cjs cmd cpp cs css csv doc docx gif go h hpp htm html ini java jpeg jpg js json jsonl jsx kt kts log markdown md mjs pdf php png "
    "ppt pptx ps1 py pyi rb rs scss sh sql svg toml ts tsv tsx txt webp xls xlsx xml yaml yml"
).split()
ATTACHED, REQUEST = "# Files mentioned by the user:", "## My request for "
AFTER_FOLDER = "、。）」』】をはにでとが"
CLOSING = ".,;、。）」』】"
PARTICLES, VERBS, COPULAS = "をはにでとが", "確認 参照 表示 修正 使用 作成 更新 削除 開 読".split(), ("です", "でした")

KINDS = ("unknown", "missing", "directory", "file")
#: How a mention is written, by the rule that finds it; other rules find plain text.
WRITTEN = {"attachment": "attachment", "link": "markdown_link", "inline_code": "inline_code"}

# A plain path starts where none is under way. A segment that turns out to be none is taken without
# its group, so that a long run of text is read once and not again from each of its characters.
_FREE = r"(?<![A-Za-z0-9_./\\-])"
_AT = r"(?::\d+(?::\d+)?)?"
_NAME = r"[^\s/\\:]+"
_BARE = "|".join(sorted((e for e in EXTENSIONS if e != "log"), key=len, reverse=True))

#: Layers of rules: (origin, pattern with group p, pattern of the lines within). The rules of a layer
#: read the same text; what they take is blank to the layers after it. Without an origin a span is
#: only taken.
LAYERS = [
    [("attachment", rf"(?ms)^{ATTACHED}\s*\n(?P<p>.*?)(?=^{REQUEST}|\Z)", r"(?m)^##\s+[^:\r\n]+:\s*(?P<p>[^\r\n]+?)\s*$")],
    [(None, r"(?ms)^[ \t]*(?P<p>```)[^\r\n]*\r?\n.*?(?:^[ \t]*```[ \t]*$|\Z)", None)],
    [
        ("link", r"\[[^\]\r\n]+(?:\]\((?P<p>[^)\r\n]+)\))?", None),
        ("inline_code", r"(?<!`)`(?P<p>[^`\r\n]+)`(?!`)", None),
        ("quoted", r"(?P<q>[\"'])(?P<p>(?:[A-Za-z]:\\|\\\\)[^\r\n]+?)(?P=q)", None),
    ],
    [
        ("unc", r"(?<!\w)(?P<p>\\\\[^\s\"<>|?*`]+)", None),
        ("drive", r"(?<!\w)(?P<p>[A-Za-z]:\\[^\s\"<>|?*`]+)", None),
        ("relative_file", rf"{_FREE}(?:(?P<p>(?:{_NAME}[\\/])+{_NAME}\.[A-Za-z0-9]{{1,12}}{_AT})|{_NAME})", None),
        ("relative_directory", rf"{_FREE}(?P<p>(?:[A-Za-z0-9_.-]+[\\/])+)(?=$|[\s{AFTER_FOLDER}])", None),
        ("bare_file", rf"(?i){_FREE}(?:(?P<p>[\w.-]+\.(?:{_BARE}){_AT})|[\w.-]+)", None),
    ],
]
_COMPILED = [[(o, re.compile(p), re.compile(within) if within else None) for o, p, within in layer] for layer in LAYERS]


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans, which may overlap, as spaces: places stay as they are."""
    pieces, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            start = max(start, at)
            pieces += [text[at:start], " " * (end - start)]
            at = end
    return "".join(pieces) + text[at:]


def find_spans(text: str) -> list[tuple[str, str, int]]:
    """(value, origin, place of its first character) of what a text names as files, rule by rule."""
    found, left = [], text
    for layer in _COMPILED:
        taken = []
        for origin, pattern, within in layer:
            spans = [m for m in pattern.finditer(left) if m["p"] is not None]
            taken += [m.span() for m in spans]
            if within:
                spans = [m for s in spans for m in within.finditer(left, *s.span("p"))]
            if origin:
                found += [(m["p"], origin, m.start("p")) for m in spans]
        left = blanked(left, taken)
    return found


@F.pandas_udf(ArrayType(StructType().add("value", StringType()).add("origin", StringType()).add("start", IntegerType())))
def candidates(text: pd.Series) -> pd.Series:
    """The spans of each text (find_spans); none of a null text."""
    return text.map(lambda t: [dict(zip(("value", "origin", "start"), s)) for s in find_spans(t)] if isinstance(t, str) else [])


def cleaned(value: Column) -> Column:
    """Without brackets, quotes and closing marks around it, and without words run on to a file."""
    bare = F.regexp_replace(F.regexp_replace(stripped(value), r"^[<>\"']+|[<>\"']+$", ""), f"[{CLOSING}]+$", "")
    words = rf"(?:[{PARTICLES}](?:{'|'.join(VERBS)})|{'|'.join(COPULAS)})"
    return F.regexp_replace(bare, rf"^(.+?\.[A-Za-z0-9]{{1,12}}{_AT}){words}.*$", "$1")


def split_location(value: Column) -> Column:
    """struct<path, line, column> of path:line:column; the letter of a drive is no path."""
    pattern, none = r"^(.+?):(\d+)(?::(\d+))?$", F.lit(None).cast("int")
    def number(k: int) -> Column:
        return F.regexp_extract(value, pattern, k).try_cast("int")
    located = F.struct(F.regexp_extract(value, pattern, 1).alias("path"), number(2).alias("line"), number(3).alias("column"))
    whole = F.struct(value.alias("path"), none.alias("line"), none.alias("column"))
    return F.when(value.rlike(r".:\d+$") & ~value.rlike(r"^[A-Za-z](:\d+){1,2}$"), located).otherwise(whole)


def steps(path: Column) -> Column:
    """The steps of an absolute path below its head, . and .. carried out; above the head is the head."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    def step(acc: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def extension_of(name: Column) -> Column:
    """What follows a name's last dot, in lower case; none of a name whose only dot leads it."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def absolute(path: Column) -> Column:
    """A path with slashes, its steps carried out below its head: //, a drive, / or none."""
    return bound(F.regexp_extract(path, r"^(//|[A-Za-z]:/|/)", 1), lambda head: F.concat(head, steps(F.substring(path, F.length(head) + 1, F.length(path)))))


def classify(path: Column, root: Column) -> Column:
    """struct<scope, path, name, extension, whole>: workspace and the path below the root, or external
    and only the name. whole is the absolute path, from which the others are told apart; it isn't
    for keeping. Null for an address, an anchor, and the root itself."""
    def slashed(p: Column) -> Column:
        return F.regexp_replace(p, r"\\", "/")
    def told(given: Column, top: Column, whole: Column) -> Column:
        inside = F.startswith(F.lower(whole), F.concat(F.lower(top), F.lit("/"))) & ~F.startswith(path, F.lit("\\\\"))
        none = (path == "") | path.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*://|#)") | (F.lower(whole) == F.lower(top))
        def named(relative: Column) -> Column:
            name = F.regexp_extract(F.coalesce(relative, given), r"([^/]*)/*$", 1)
            return bound(name, lambda n: F.when(n != "", F.struct(F.when(relative.isNotNull(), "workspace").otherwise("external").alias("scope"), relative.alias("path"), n.alias("name"), extension_of(n).alias("extension"), F.lower(whole).alias("whole"))))
        return F.when(~F.coalesce(none, F.lit(True)), bound(F.when(inside, F.substring(whole, F.length(top) + 2, F.length(whole))), named))
    def below(top: Column, given: Column) -> Column:
        joined = F.when(given.rlike("^(/|[A-Za-z]:/)"), given).otherwise(F.concat(top, F.lit("/"), given))
        return bound(absolute(joined), lambda whole: told(given, top, whole))
    return bound(F.regexp_replace(absolute(slashed(root)), "/$", ""), lambda top: bound(slashed(path), lambda given: below(top, given)))


def looks_local(path: Column) -> Column:
    """Whether a value can be a path: it has a separator or an ending and is no address."""
    return ~path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & (path.rlike(r"[/\\]") | (extension_of(path) != ""))


def file_mentions(messages: DataFrame, text: str, ident: str, root: str, tree: DataFrame | None = None) -> DataFrame:
    """One row a mention: ident, place (from 0, as found), origin, written, line, column, scope, path,
    name, extension, kind, whole_sha256.

    tree (path below the root, kind) tells what there is, without regard to case: a path that it
    lacks is missing; without a tree, and outside of the root, kinds are unknown. A missing bare
    name of no known ending is no mention. whole_sha256 tells external files of one name apart.
    Messages without text have no mentions; other columns of messages are left out.
    """
    rows = messages.select(ident, F.posexplode(candidates(F.col(text))).alias("place", "c"))
    written = F.coalesce(F.create_map(*(F.lit(x) for pair in WRITTEN.items() for x in pair))[F.col("c.origin")], F.lit("plain_text"))
    def told(at: Column) -> Column:
        return F.when((F.col("c.origin") == "attachment") | looks_local(at["path"]), F.struct(at.alias("at"), classify(at["path"], F.lit(root)).alias("file")))
    # a generator is a fence: what it makes is made once, and no condition on it is moved below it
    found = bound(bound(cleaned(F.col("c.value")), split_location), told)
    rows = rows.select(ident, "place", F.col("c.origin").alias("origin"), written.alias("written"), F.inline(F.filter(F.array(found), lambda f: f["file"].isNotNull())))
    kind = F.lit("unknown")
    if tree is not None:
        best = F.max_by("kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
        # a table of paths may repeat them: repeats go by hash before the texts are compared, which sorts
        known = tree.select(F.lower("path").alias("_known"), "kind").distinct().groupBy("_known").agg(best.alias("_kind"))
        rows = rows.join(known, (F.lower("file.path") == F.col("_known")) & (F.col("file.scope") == "workspace"), "left")
        kind = F.when(F.col("file.scope") == "workspace", F.coalesce("_kind", F.lit("missing"))).otherwise("unknown")
        doubtful = (kind == "missing") & ~F.col("file.extension").isin(*EXTENSIONS) & ~F.col("at.path").rlike(r"[/\\]") & F.col("written").isin("inline_code", "plain_text")
        rows = rows.where(~doubtful)
    return rows.select(
        ident, "place", "origin", "written", "at.line", "at.column", "file.scope", "file.path", "file.name", "file.extension",
        kind.alias("kind"), F.sha2("file.whole", 256).alias("whole_sha256"),
    )


def file_references(mentions: DataFrame, ident: str, workspace: Column | None = None) -> DataFrame:
    """One row a workspace path without regard to case: reference_id, path as first spelled (by ident,
    then place), name, extension, kind (the best: file, directory, missing, unknown), mentions and
    messages that have one.

    Mentions of one message that are written alike and tell the same line and column count once.
    Counts are summed in three steps, so that a file that most messages name is no hot group; the
    mentions themselves stay rows of their own (reference_ids gives them their file's id).
    """
    where = F.struct(F.col(ident), F.col("place"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spelled = F.struct("path", "name", "extension")
    once = mentions.where("scope = 'workspace'").groupBy(F.lower("path").alias("key"), ident, "line", "column", "written").agg(F.min(F.struct(where.alias("at"), spelled.alias("as"))).alias("first"), F.max(rank).alias("best"))
    each = once.groupBy("key", ident).agg(F.min("first").alias("first"), F.max("best").alias("best"), F.count("*").alias("n"))
    rows = each.groupBy("key").agg(F.min("first").alias("first"), F.max("best").alias("best"), F.sum("n").alias("mentions"), F.count("*").alias("messages"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("best").cast("int"))
    named = prefixed_id("file_ref", workspace if workspace is not None else F.lit(""), F.lit("workspace"), F.col("first.as.path"))
    return rows.select(named.alias("reference_id"), "first.as.path", "first.as.name", "first.as.extension", kind.alias("kind"), "mentions", "messages")


def external_files(mentions: DataFrame, ident: str, workspace: Column | None = None, parts: int | None = None) -> DataFrame:
    """One row a message and file outside of the workspace: reference_id, ident, ordinal (from 1, in
    the order of place), name, extension. A file named in two messages is two: nothing of its path
    is kept by which they could meet. parts: into how many partitions they are sorted; left to Spark
    it goes by compressed bytes, of which alike mentions have few."""
    # one shuffle, before which nothing is sorted: hardly two mentions of one file are to be merged
    rows = mentions.where("scope = 'external'").select(ident, "whole_sha256", "place", "name", "extension")
    rows = rows.repartition(parts, ident) if parts else rows.repartition(ident)
    nth = F.row_number().over(Window.partitionBy(ident, "whole_sha256").orderBy("place", "name", "extension"))
    rows = rows.withColumn("_nth", nth).where("_nth = 1").withColumn("ordinal", F.row_number().over(Window.partitionBy(ident).orderBy("place")))
    named = prefixed_id("file_ref", workspace if workspace is not None else F.lit(""), F.lit("external"), F.col(ident), F.col("ordinal"), F.col("name"))
    return rows.select(named.alias("reference_id"), ident, "ordinal", "name", "extension")


def reference_ids(mentions: DataFrame, references: DataFrame) -> DataFrame:
    """The mentions of workspace files with the reference_id of theirs."""
    ids = references.select(F.lower("path").alias("_key"), "reference_id")
    return mentions.where("scope = 'workspace'").withColumn("_key", F.lower("path")).join(ids, "_key").drop("_key", "whole_sha256")
