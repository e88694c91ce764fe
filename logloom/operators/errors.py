"""Errors: candidates of tool outputs, fingerprints, folding, resolution by later success, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.keys import digest, limit_text, normalized, stripped


def fold_errors(failures: DataFrame, fingerprint: list[str], order: list[str], message: str | None = None, rolled_back: str | None = None) -> DataFrame:
    """One row a fingerprint: n, first and last (structs of the order columns), the latest message,
    rolled_back (if every failure is)."""
    place = F.struct(*order)
    aggs = [F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")]
    if message:
        aggs.append(F.max_by(message, place).alias("message"))
    if rolled_back:
        aggs.append(F.bool_and(rolled_back).alias("rolled_back"))
    return failures.groupBy(*fingerprint).agg(*aggs)


def resolve_errors(events: DataFrame, operation: list[str], order: list[str], failed: Column, succeeded: Column) -> DataFrame:
    """Every failure with resolved_by: the first later success of its operation, as a struct of
    the order columns; null while open. A null operation never resolves."""
    after = Window.partitionBy(*operation).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    known = F.lit(True)
    for c in operation:
        known = known & F.col(c).isNotNull()
    by = F.first(F.when(succeeded, F.struct(*order)), ignorenulls=True).over(after)
    used = events.where(failed | succeeded)
    return used.withColumn("resolved_by", F.when(known, by)).where(failed)


def error_counts(errors: DataFrame, by: list[str]) -> DataFrame:
    """Per group: open, resolved, rolled_back (apart from both), critical (open) and total."""
    undone = F.coalesce(F.col("rolled_back"), F.lit(False))
    return errors.groupBy(*by).agg(
        F.count_if(~undone & (F.col("status") == "open")).alias("open"),
        F.count_if(~undone & (F.col("status") == "resolved")).alias("resolved"),
        F.count_if(undone).alias("rolled_back"),
        F.count_if(~undone & (F.col("status") == "open") & (F.col("severity") == "critical")).alias("critical"),
        F.count("*").alias("total"),
    )


def error_section(status: Column, rolled_back: Column) -> Column:
    """Where a list shows an error, in the order of the names."""
    names = F.when(F.coalesce(rolled_back, F.lit(False)), "rolled_back")
    for name in ("open", "resolved", "ignored"):
        names = names.when(status == name, name)
    return names.otherwise("unknown")


SECTION_ORDER = ("open", "resolved", "rolled_back", "ignored", "unknown")


def section_rank(section: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SECTION_ORDER)), section)


# The patterns that name failures, and the texts of their summaries.
EXIT_CODES = (r"(?im)^\s*Exit code:\s*(-?\d+)\s*$", r"(?im)^\s*Process exited with code\s+(-?\d+)\s*$")
TEST_FAILURE = r"(?m)^(?:FAIL|ERROR):\s+([^\s(]+)(?:\s+\(([^)]+)\))?"
TRACEBACK = "Traceback (most recent call last):"
TRACEBACK_FILE = r"(?m)^\s*File\s+[\"']([^\"']+)[\"'],\s+line\s+(\d+)"
EXCEPTION = r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception|Interrupt))(?::\s*(.*))?$"
FATAL = r"(?im)^fatal:\s*(.+)$"
SUMMARIES = {
    "test_failure": "テストが失敗しました: ",
    "python_exception": "Python例外が発生しました: ",
    "git_command_failure": "Gitコマンドが失敗しました: ",
    "command_failure": ("コマンドが終了コード", "で失敗しました。"),
    "patch_failure": "パッチの適用に失敗しました。",
    "mcp_failure": "MCPツールの実行に失敗しました: ",
    "turn_interrupted": "Codexのターンが中断されました: ",
}
SUMMARY_LENGTH, DETAIL_LENGTH = 500, 4000
CANDIDATE = "kind string, severity string, summary string, detail string, location_path string, location_line int, complete boolean"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def exit_code(text: Column) -> Column:
    """The exit code on a line of its own: the last of the first pattern, else of the second; null
    if none does."""
    return F.coalesce(*[_last(_all(text, p, 1)).try_cast("int") for p in EXIT_CODES])


def failure_detail(text: Column) -> Column:
    """From a traceback on, else a fatal line, else the last forty lines; null of a blank text."""
    bare = stripped(text)
    lines = F.split(bare, r"\r\n|[\n\r]")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 39, F.lit(1)), 40), "\n")
    trace, fatal = F.instr(bare, TRACEBACK), F.regexp_extract(bare, FATAL, 0)
    return F.when(bare == "", None).when(trace > 0, F.substring(bare, trace, F.length(bare))).when(fatal != "", fatal).otherwise(tail)


def test_failures(text: Column) -> Column:
    """array<struct<name, path, detail>> of each failed test: its case and name, its case if that is
    a path, and its block up to a rule of dashes or the next failure."""
    head = TEST_FAILURE.removeprefix("(?m)")
    block = rf"(?ms){head}.*?(?=\n-{{70}}|^(?:FAIL|ERROR):\s+[^\s(]|\z)"
    each = F.arrays_zip(_all(text, TEST_FAILURE, 1).alias("test"), _all(text, TEST_FAILURE, 2).alias("case"), _all(text, block, 0).alias("block"))

    def one(x: Column) -> Column:
        case = F.when(x["case"] != "", x["case"])
        path = F.when(case.contains("/") | case.contains("\\"), case)
        return F.struct(F.concat_ws(".", case, x["test"]).alias("name"), path.alias("path"), stripped(x["block"]).alias("detail"))

    return F.transform(each, one)


def candidate(kind: str, severity: Column, summary: Column, detail: Column, path: Column | None = None, line: Column | None = None, complete: bool = True) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), limit_text(summary, SUMMARY_LENGTH).alias("summary"), detail.alias("detail"), (none if path is None else path).cast("string").alias("location_path"), (none if line is None else line).cast("int").alias("location_line"), F.lit(complete).alias("complete"))


def failure_candidates(text: Column) -> Column:
    """array<struct<kind, severity, summary, detail, location_path, location_line, complete>> of a
    tool's output, by precedence: every failed test, else a Python exception, and of an exit code
    other than 0 a fatal line, else the failed command. Tests and exceptions under exit code 0, or
    none, are warnings; a fatal line alone says nothing."""
    code = exit_code(text)
    bad = F.coalesce(code, F.lit(0)) != 0
    severity = F.when(bad, "error").otherwise("warning")
    name, message = _last(_all(text, EXCEPTION, 1)), stripped(_last(_all(text, EXCEPTION, 2)))
    raised = F.concat(F.lit(SUMMARIES["python_exception"]), name, F.when(message != "", F.concat(F.lit(": "), message)).otherwise(""))
    fatal = F.regexp_extract(text, FATAL, 1)
    before, after = SUMMARIES["command_failure"]
    tests = F.transform(test_failures(text), lambda t: candidate("test_failure", severity, F.concat(F.lit(SUMMARIES["test_failure"]), t["name"]), t["detail"], t["path"]))
    error = F.lit("error")
    return (
        F.when(F.size(tests) > 0, tests)
        .when(text.contains(TRACEBACK) & name.isNotNull(), F.array(candidate("python_exception", severity, raised, text, _last(_all(text, TRACEBACK_FILE, 1)), _last(_all(text, TRACEBACK_FILE, 2)))))
        .when(bad & (fatal != ""), F.array(candidate("git_command_failure", error, F.concat(F.lit(SUMMARIES["git_command_failure"]), stripped(fatal)), F.regexp_extract(text, FATAL, 0))))
        .when(bad, F.array(candidate("command_failure", error, F.concat(F.lit(before), code.cast("string"), F.lit(after)), limit_text(failure_detail(text), DETAIL_LENGTH), complete=False)))
        .otherwise(F.array().cast(f"array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>"))
    )


def operation_key(kind: str, *parts: Column) -> Column:
    """What a later success must share with a failure to resolve it; null if a part is."""
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    return F.when(known, digest(F.lit(kind), *parts))


def patch_key(paths: Column) -> Column:
    """The operation key of a patch: its paths, sorted; null without any."""
    named = F.array_sort(F.filter(paths, lambda p: p.isNotNull()))
    return F.when(F.size(named) > 0, F.sha2(F.concat_ws("\0", F.lit("patch"), named), 256))


def fingerprint(workspace: Column, session: Column, payload: Column, kind: Column, operation: Column, call_id: Column, offset: Column, path: Column, line: Column, summary: Column) -> Column:
    """Equal for what counts as one error: a failure without an operation is its call's, or else
    its own."""
    own = F.coalesce(operation, F.concat(F.lit("call:"), F.when(call_id != "", call_id)), F.concat(F.lit("offset:"), offset.cast("string")))
    return digest(workspace, session, payload, kind, own, path, line, normalized(summary))


def ids_by_call(messages: DataFrame, by: list[str], call_ids: str, ident: str, order: str) -> DataFrame:
    """by, call_id, ids: the messages that name a call, in order."""
    named = messages.select(*by, F.explode(call_ids).alias("call_id"), F.struct(F.col(order).alias("at"), F.col(ident).alias("id")).alias("m"))
    return named.groupBy(*by, "call_id").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["id"]).alias("ids"))


def mark_rolled_back(rows: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """Adds rolled_back: whether the row's turn is."""
    undone = turns.where("rolled_back").select(*key).distinct().withColumn("_undone", F.lit(True))
    return rows.join(undone, key, "left").withColumn("rolled_back", F.coalesce("_undone", F.lit(False))).drop("_undone")


def fold_resolved(events: DataFrame, fingerprint: list[str], operation: list[str], order: list[str], failed: Column, succeeded: Column, ids: str | None = None, rolled_back: str | None = None) -> DataFrame:
    """One row a fingerprint: n, first and last (structs of the order columns), ids (distinct, in
    the order first seen), rolled_back (if every failure is), status and resolved_by. A recurrence
    opens an error again, so that only a success after the last failure resolves it."""
    place = F.struct(*order)
    rows = resolve_errors(events, operation, order, failed, succeeded)
    aggs = [F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.max_by("resolved_by", place).alias("resolved_by")]
    if ids:
        ordered = F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col(ids).alias("ids"))))
        aggs.append(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["ids"]))).alias("ids"))
    if rolled_back:
        aggs.append(F.bool_and(rolled_back).alias("rolled_back"))
    folded = rows.groupBy(*fingerprint).agg(*aggs)
    return folded.withColumn("status", F.when(F.col("resolved_by").isNull(), "open").otherwise("resolved"))


def list_order(status: Column, rolled_back: Column, last_at: Column, offset: Column) -> list[Column]:
    """Sort columns: what is open and not rolled back first, then the newest, then the furthest."""
    closed = (status != "open") | F.coalesce(rolled_back, F.lit(False))
    return [closed.asc(), last_at.desc_nulls_last(), offset.desc()]
