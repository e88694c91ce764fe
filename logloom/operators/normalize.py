"""Raw log records to one row type.

The mapping from a record's type and its payload's type to category and subtype, and the fields
that each may keep, are tables of fixed values; everything else in a payload is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.keys import bound, iso_instant
from logloom.functions.records import is_object, kind_of, seconds, strict_bool, strict_long, strict_text, variant_array

#: Fixed values: (record type, payload type or None) -> (category, subtype).
ROWS = {
    ("session_meta", None): ("session", "session_metadata"),
    ("turn_context", None): ("turn", "turn_context"),
    ("response_item", "message"): ("message", "chat_message"),
    ("response_item", "reasoning"): ("internal_context", "reasoning"),
    ("response_item", "function_call"): ("tool", "tool_call"),
    ("response_item", "custom_tool_call"): ("tool", "tool_call"),
    ("response_item", "function_call_output"): ("tool", "tool_output"),
    ("response_item", "custom_tool_call_output"): ("tool", "tool_output"),
    ("event_msg", "user_message"): ("message", "chat_message_event"),
    ("event_msg", "agent_message"): ("message", "chat_message_event"),
    ("event_msg", "task_started"): ("turn", "turn_status"),
    ("event_msg", "task_complete"): ("turn", "turn_status"),
    ("event_msg", "turn_aborted"): ("turn", "turn_status"),
    ("event_msg", "thread_rolled_back"): ("turn", "thread_rolled_back"),
    ("event_msg", "thread_settings_applied"): ("settings", "thread_settings"),
    ("event_msg", "token_count"): ("usage", "token_count"),
    ("event_msg", "patch_apply_end"): ("file_change", "patch_result"),
    ("event_msg", "web_search_end"): ("tool", "web_search_completed"),
    ("event_msg", "mcp_tool_call_end"): ("tool", "mcp_tool_completed"),
    ("event_msg", "context_compacted"): ("internal_context", "context_compacted"),
    ("world_state", None): ("internal_context", "world_state"),
    ("compacted", None): ("internal_context", "compacted"),
}

#: Attribute -> path in the payload, by the way it is read.
TEXTS = {
    "call_id": "$.call_id", "tool": "$.name", "namespace": "$.namespace", "call_status": "$.status", "reason": "$.reason", "cwd": "$.cwd", "model": "$.model",
    "effort": "$.effort", "timezone": "$.timezone", "source": "$.source", "originator": "$.originator", "server": "$.invocation.server", "mcp_tool": "$.invocation.tool",
    "branch": "$.git.branch", "commit": "$.git.commit_hash", "cli_version": "$.cli_version", "settings_cwd": "$.thread_settings.cwd", "settings_model": "$.thread_settings.model",
    "reasoning_effort": "$.thread_settings.reasoning_effort", "personality": "$.thread_settings.personality", "action_type": "$.action.type",
}
LONGS = {"started_ms": "$.started_at", "completed_ms": "$.completed_at", "duration_ms": "$.duration_ms", "first_token_ms": "$.time_to_first_token_ms", "num_turns": "$.num_turns"}
USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")

#: Subtype -> the attributes that its rows keep.
KEPT = {
    "session_metadata": "cwd source originator cli_version branch commit",
    "turn_context": "cwd model effort timezone",
    "tool_call": "call_id tool namespace call_status",
    "tool_output": "call_id",
    "turn_status": "reason started_ms completed_ms duration_ms first_token_ms",
    "thread_rolled_back": "num_turns",
    "thread_settings": "settings_cwd settings_model reasoning_effort personality",
    "patch_result": "call_id call_status",
    "web_search_completed": "call_id action_type",
    "mcp_tool_completed": "call_id server mcp_tool",
}

#: The field that a payload type has its content in, with the kind of its parts: a
#: text or an array of items, or texts that may be missing.
LISTS = {"message": ("content", "text"), "function_call_output": ("output", "tool_output"), "custom_tool_call_output": ("output", "tool_output")}
PLAIN = {
    "user_message": {"message": "text"}, "agent_message": {"message": "text"}, "function_call": {"arguments": "tool_input"}, "custom_tool_call": {"input": "tool_input"},
    "patch_apply_end": {"stdout": "stdout", "stderr": "stderr"},
}
IMAGES = ("input_image", "output_image")

PART = "struct<kind:string,text:string,source_type:string>"


def _table(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for key, value in pairs.items() for x in (F.lit(key), value)])


def content_parts(p: Column, kind: Column) -> Column:
    """array<struct<kind, text, source_type>> of the fields in which a payload type has content. A text
    is one part; of an array, texts and objects with a text are parts, images without one are
    references without text, anything else is left out (see normalization_issues)."""
    none = F.lit(None).cast("string")
    def part(of: Column, text: Column, source: Column = none) -> Column:
        return F.struct(of.alias("kind"), text.alias("text"), source.alias("source_type"))
    def of_item(v: Column) -> Column:
        source, text = strict_text(v, "$.type"), F.coalesce(strict_text(v, "$"), strict_text(v, "$.text"))
        return F.when(text.isNotNull(), part(named, text, source)).when(source.isin(*IMAGES), part(F.lit("image_reference"), none, source))
    def of_list(v: Column) -> Column:
        return F.when(kind_of(v, "$") == "STRING", F.array(part(named, strict_text(v, "$")))).otherwise(F.array_compact(F.transform(variant_array(v, "$"), of_item)))

    named = F.try_element_at(_table({k: F.lit(of) for k, (_, of) in LISTS.items()}), kind)
    value = F.coalesce(*[F.when(kind == k, F.try_variant_get(p, f"$.{field}", "variant")) for k, (field, _) in LISTS.items()])
    plain = [F.when(kind == k, F.when(strict_text(p, f"$.{field}").isNotNull(), part(F.lit(of), strict_text(p, f"$.{field}")))) for k, fields in PLAIN.items() for field, of in fields.items()]
    return F.when(kind.isin(*LISTS), bound(value, of_list)).otherwise(F.array_compact(F.array(*plain))).cast(f"array<{PART}>")


def patch_changes(p: Column) -> Column:
    """array<struct<path, type, move_path>> of a patch, by path; bodies are left out."""
    entries = F.map_entries(F.when(is_object(p, "$.changes"), F.try_variant_get(p, "$.changes", "map<string,variant>")))
    entries = F.filter(entries, lambda e: is_object(e["value"], "$"))
    rows = F.transform(entries, lambda e: F.struct(e["key"].alias("path"), strict_text(e["value"], "$.type").alias("type"), strict_text(e["value"], "$.move_path").alias("move_path")))
    return F.coalesce(F.array_sort(rows), F.array().cast("array<struct<path:string,type:string,move_path:string>>"))


def token_usage(p: Column) -> Column:
    """The five counts of the total usage, or else of the last."""
    def at(which: str) -> Column:
        return F.when(is_object(p, f"$.info.{which}"), F.struct(*[strict_long(p, f"$.info.{which}.{c}").alias(c) for c in USAGE]))
    return F.coalesce(at("total_token_usage"), at("last_token_usage"))


def normalize(records: DataFrame) -> DataFrame:
    """Rows of good records (columns of sources.jsonl.parse_lines) in the common row type. Records
    of an unknown payload type are left out; see unknown_payloads.

    A row has the fields of its subtype only, whatever else its payload holds; those of other
    subtypes are null, maps and arrays empty. A value of the wrong kind is as good as missing.
    """
    p, kind, subtype = F.col("payload"), F.col("source_payload_type"), F.col("subtype")
    types = F.when(F.col("record_type").isin("response_item", "event_msg"), strict_text(p, "$.type"))
    shape = _table({"\0".join(filter(None, key)): F.struct(F.lit(c).alias("category"), F.lit(s).alias("subtype")) for key, (c, s) in ROWS.items()})
    rows = records.where("issue is null").withColumn("source_payload_type", types)
    rows = rows.withColumn("_shape", F.try_element_at(shape, F.concat_ws("\0", "record_type", "source_payload_type"))).where("_shape is not null").withColumns({"category": F.col("_shape.category"), "subtype": F.col("_shape.subtype")})

    def of(value: Column, *subtypes: str) -> Column:
        return F.when(subtype.isin(*subtypes), value)
    def attributes(paths: dict[str, str], read) -> Column:
        kept = {name: of(read(p, path), *[s for s, names in KEPT.items() if name in names.split()]) for name, path in paths.items()}
        return F.map_filter(_table(kept), lambda k, v: v.isNotNull())

    item = F.col("record_type") == "response_item"
    said, turn = ("chat_message", "chat_message_event"), strict_text(p, "$.turn_id")
    own = strict_text(p, "$.id")
    fields = {
        "at": iso_instant(F.col("timestamp")),
        "source_id": F.when(item, own).otherwise(of(F.coalesce(strict_text(p, "$.session_id"), own), "session_metadata")),
        "turn_id": F.when(item, F.coalesce(turn, strict_text(p, "$.internal_chat_message_metadata_passthrough.turn_id"))).otherwise(of(turn, "turn_context", "chat_message_event", "turn_status", "patch_result")),
        "role": F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant").otherwise(F.coalesce(of(F.lit("tool"), "tool_call", "tool_output"), of(strict_text(p, "$.role"), "chat_message"))),
        "phase": of(strict_text(p, "$.phase"), *said),
        "content": F.coalesce(content_parts(p, kind), F.array().cast(f"array<{PART}>")),
        "texts": attributes(TEXTS, strict_text),
        "numbers": attributes(LONGS, strict_long),
        "succeeded": F.coalesce(of(strict_bool(p, "$.success"), "patch_result"), of(F.when(kind_of(p, "$.result.Ok").isNotNull(), True).when(kind_of(p, "$.result.Err").isNotNull(), False), "mcp_tool_completed")),
        "duration_s": of(seconds(p, "$.duration"), "mcp_tool_completed"),
        "changes": F.coalesce(of(patch_changes(p), "patch_result"), F.array().cast("array<struct<path:string,type:string,move_path:string>>")),
        "usage": of(token_usage(p), "token_count"),
        "n_results": of(F.when(kind_of(p, "$.results").startswith("ARRAY"), F.size(variant_array(p, "$.results"))), "web_search_completed"),
        "workspace_roots": F.coalesce(of(F.array_compact(F.transform(variant_array(p, "$.workspace_roots"), lambda v: strict_text(v, "$"))), "turn_context"), F.array().cast("array<string>")),
    }
    # the generator is a fence: what is read of a payload is read once, however often later steps name
    # it; conditions on what stands outside of it still go below
    outside = ("timestamp", "category", "subtype", F.col("record_type").alias("source_record_type"), "source_payload_type", F.col("path").alias("source_path"), "line_number", "start_offset", "end_offset")
    return rows.select(*outside, F.inline(F.array(F.struct(*[c.alias(name) for name, c in fields.items()]))))


def unknown_payloads(records: DataFrame) -> DataFrame:
    """Good records whose payload type has no row type: path, line_number, kind."""
    kind = strict_text(F.col("payload"), "$.type")
    known = [p for (r, p) in ROWS if p]
    rows = records.where(F.col("issue").isNull() & F.col("record_type").isin("response_item", "event_msg"))
    return rows.where(~F.coalesce(kind.isin(*known), F.lit(False))).select("path", "line_number", kind.alias("kind"))


def _issue(kind: str, field: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), field.alias("field"))


def _list_issues(v: Column) -> Column:
    """Of a value that should be a text or an array: its bad items, or itself."""
    read = lambda i: F.struct(F.coalesce(strict_text(i, "$"), strict_text(i, "$.text")).alias("text"), strict_text(i, "$.type").alias("source"), is_object(i, "$").alias("object"))
    bad = F.filter(F.transform(variant_array(v, "$"), read), lambda i: i["text"].isNull() & ~F.coalesce(i["source"].isin(*IMAGES), F.lit(False)))
    wrong = F.transform(bad, lambda i: F.when(i["object"], _issue("unsupported_content_item", i["source"])).otherwise(_issue("invalid_content_item", F.lit("content"))))
    taken = strict_text(v, "$").isNotNull() | F.coalesce(kind_of(v, "$").startswith("ARRAY"), F.lit(False))
    return F.when(taken, wrong).otherwise(F.array(_issue("invalid_content", F.lit("content"))))


def normalization_issues(records: DataFrame) -> DataFrame:
    """One row a fault of a good record: path, line_number, start_offset, kind, field.

    invalid_timestamp; unsupported_response_item and unsupported_event_message, with the payload
    type; invalid_content, invalid_content_item and unsupported_content_item (with the item's type),
    one for each bad item of an array; invalid_text with the field. An item is good if it is a text,
    an object with a text, or an image. A record can have several issues and still have a row.
    """
    p, record = F.col("payload"), F.col("record_type")
    kind = F.when(record.isin("response_item", "event_msg"), strict_text(p, "$.type"))
    late = F.when(iso_instant(F.col("timestamp")).isNull(), _issue("invalid_timestamp", F.lit("timestamp")))
    single, listed = [late], F.array().cast("array<struct<kind:string,field:string>>")
    for of, name in (("response_item", "unsupported_response_item"), ("event_msg", "unsupported_event_message")):
        known = [k for r, k in ROWS if r == of]
        single.append(F.when((record == of) & ~F.coalesce(kind.isin(*known), F.lit(False)), _issue(name, kind)))
    for (of, k) in ROWS:
        match = F.coalesce((record == of) & (kind == k), F.lit(False))
        if k in LISTS:
            listed = F.when(match, _list_issues(F.try_variant_get(p, f"$.{LISTS[k][0]}", "variant"))).otherwise(listed)
        for field in PLAIN.get(k, ()):
            found = kind_of(p, f"$.{field}")
            single.append(F.when(match & ~found.isin("STRING", "VOID"), _issue("invalid_text", F.lit(field))))
    rows = records.where("issue is null").select("path", "line_number", "start_offset", F.explode(F.concat(F.array_compact(F.array(*single)), listed)).alias("_i"))
    return rows.select("path", "line_number", "start_offset", "_i.kind", "_i.field")


def fingerprinted(rows: DataFrame) -> DataFrame:
    """Adds fingerprint: of a normalized row's meaning, its time included and its place in the log
    not; maps in the order of their keys."""
    texts = F.array_join(F.transform(F.array_sort(F.map_entries("texts")), lambda e: F.concat_ws("=", e["key"], e["value"])), "\1")
    numbers = F.array_join(F.transform(F.array_sort(F.map_entries("numbers")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "\1")
    rest = F.to_json(F.struct("category", "subtype", "source_record_type", "source_payload_type", "source_id", "turn_id", "role", "phase", "timestamp", "content", "changes", "usage", "succeeded", "duration_s", "n_results", "workspace_roots"), {"ignoreNullFields": "false"})
    return rows.withColumn("fingerprint", F.sha2(F.concat_ws("\2", texts, numbers, rest), 256))
