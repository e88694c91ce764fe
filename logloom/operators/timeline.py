"""The chat timeline of a session's normalized rows (with session_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.keys import content_digest, content_text, prefixed_id

from .documents import text_length
from .dedup import multiset_except, reference_repeats
from .joins import attach_latest
from .snapshot import display_mode, message_category

# The blocks that a client puts before a user's message; only complete ones at its
# very start go.
AUTOMATIC = (
    r"<recommended_plugins>[\s\S]*?</recommended_plugins>",
    r"# AGENTS\.md instructions[^\r\n]*\r?\n\s*<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>",
    r"<environment_context>[\s\S]*?</environment_context>",
)
# What tool messages say.
TOOL_RUN, TOOL_RESULT, UNKNOWN_TOOL = "ツールを実行: ", "ツール結果を受信", "不明なツール"


#: A row's place in its session, which may go over several files: by time, then file and offset.
PLACE = ("at", "source_path", "start_offset")


def placed(rows: DataFrame) -> DataFrame:
    """rows with their place as one value that sorts."""
    return rows.withColumn("place", F.struct(*PLACE))


def without_prefixes(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A(?:\s*(?:{'|'.join(AUTOMATIC)})\s*)+", "")


def without_prefix_parts(parts: Column) -> Column:
    """parts (kind, text, ...) without automatic blocks at their start: a text that holds nothing
    else goes, and then the next is looked at."""
    bare = F.transform(parts, lambda p: F.struct((p["kind"] == "text").alias("plain"), without_prefixes(p["text"]).alias("text")))
    # parts go as long as they are plain and were emptied by it
    emptied = F.transform(F.arrays_zip(parts.alias("p"), bare.alias("b")), lambda x: x["b"]["plain"] & (x["b"]["text"] == "") & (x["p"]["text"] != ""))
    gone = F.coalesce(F.array_position(F.transform(emptied, lambda e: F.coalesce(e, F.lit(False))), F.lit(False)), F.lit(0))
    first = F.when(gone > 0, gone).otherwise(F.size(parts) + 1).cast("int")
    rest = F.slice(parts, first, F.greatest(F.size(parts) - first + 1, F.lit(0)))
    return F.transform(rest, lambda p, at: F.when((at == 0) & (p["kind"] == "text"), p.withField("text", without_prefixes(p["text"]))).otherwise(p))


def chat_messages(rows: DataFrame) -> DataFrame:
    """Messages in order: session_id, message_id, sequence, turn_id, at, role, message_type, phase,
    content (parts of kind and text), text, display_mode, category, duplicate_of,
    occurrence_count.

    A message event repeats a message of the log of the same role, phase and content, and only
    counts where the log has fewer equal ones in the session. Automatic blocks go from the start
    of a user's message, and the message with them if nothing is left. A developer text that came
    before becomes an empty reference to its first. Tool calls are messages with the status of
    their last completion; an output without its call is one of its own.
    """
    place = [F.col(c) for c in PLACE]
    part = "array<struct<kind:string,text:string>>"
    slim = F.transform(F.filter("content", lambda p: p["text"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"))).cast(part)
    said = rows.where(F.col("category") == "message").withColumn("digest", content_digest(F.col("content")))
    primary = said.where("subtype = 'chat_message'")
    events = multiset_except(said.where("subtype = 'chat_message_event'"), primary, ["session_id", "role", "phase", "digest"], place)
    both = primary.unionByName(events).where("role in ('user', 'assistant', 'developer')").withColumn("content", slim)
    cut = F.when(F.col("role") == "user", without_prefix_parts(F.col("content"))).otherwise(F.col("content"))
    both = both.withColumn("_cut", cut)
    emptied = (F.col("role") == "user") & (F.col("_cut") != F.col("content")) & ~F.exists("_cut", lambda p: p["text"] != "")
    both = both.where(~F.coalesce(emptied, F.lit(False))).withColumn("content", F.col("_cut")).drop("_cut")
    both = both.withColumn("message_id", F.coalesce("source_id", prefixed_id("msg", F.col("session_id"), F.col("source_path"), F.col("start_offset"))))
    both = both.withColumns({"digest": content_digest(F.col("content")), "message_type": F.when(F.col("role") == "developer", "developer_instruction").otherwise("chat")})
    developer = reference_repeats(both.where("role = 'developer'"), ["session_id", "digest"], place, "message_id")
    again = F.col("duplicate_of").isNotNull()
    developer = developer.withColumns({"content": F.when(again, F.array().cast(part)).otherwise(F.col("content")), "message_type": F.when(again, "developer_instruction_reference").otherwise(F.col("message_type"))})
    others = both.where("role != 'developer'").withColumns({"duplicate_of": F.lit(None).cast("string"), "occurrence_count": F.lit(1).cast("long")})
    kept = ["session_id", "message_id", "turn_id", "at", "role", "message_type", "phase", "content", "duplicate_of", "occurrence_count", "source_path", "start_offset"]
    out = developer.select(*kept).unionByName(others.select(*kept)).unionByName(tool_messages(rows).select(*kept))
    w = Window.partitionBy("session_id").orderBy(*place)
    out = out.withColumns({"sequence": F.row_number().over(w), "text": content_text(F.col("content"))})
    mode = display_mode(F.col("role"), F.col("phase"), text_length(F.col("content")))
    return out.select("session_id", "message_id", "sequence", "turn_id", "at", "role", "message_type", "phase", "content", "text", mode.alias("display_mode"), message_category(F.col("role"), F.col("phase")).alias("category"), "duplicate_of", F.coalesce("occurrence_count", F.lit(1)).alias("occurrence_count"))


def tool_messages(rows: DataFrame) -> DataFrame:
    """Messages of tool calls and of outputs without a call before them, in the columns that the
    timeline takes: a text, the status of the last completion with its duration, the call's id."""
    none = F.lit(None).cast("string")
    tools = placed(rows).withColumn("call_id", F.try_element_at("texts", F.lit("call_id")))
    calls = tools.where("subtype = 'tool_call'")
    ends = tools.where("call_id is not null and subtype in ('tool_output', 'mcp_tool_completed', 'patch_result')").select("session_id", "call_id", "place", "succeeded", F.col("duration_s").cast("string").alias("duration"))
    heads = calls.where("call_id is not null").select("session_id", "call_id", F.col("place").alias("call_place"))
    met = attach_latest(ends, heads, ["session_id", "call_id"], "place", "call_place", ["call_place"], "semi")
    status = F.when(F.col("succeeded"), "succeeded").when(~F.col("succeeded"), "failed").otherwise("result_received")
    durations = F.transform(F.array_sort(F.collect_list(F.when(F.col("duration").isNotNull(), F.struct("place", "duration")))), lambda x: x["duration"])
    last = met.groupBy("session_id", "call_id", "call_place").agg(F.max_by(status, "place").alias("status"), durations.alias("durations"))
    joined = calls.join(last, (calls.session_id == last.session_id) & (calls.call_id == last.call_id) & (calls.place == last.call_place), "left").drop(last.session_id, last.call_id, last.call_place)
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    ident = F.when(F.col("call_id").isNotNull(), F.array(part("call_id", F.col("call_id")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    name = F.coalesce(F.try_element_at("texts", F.lit("tool")), F.lit(UNKNOWN_TOOL))
    said = F.array(part("text", F.concat(F.lit(TOOL_RUN), name)))
    timed = F.transform(F.coalesce("durations", F.array().cast("array<string>")), lambda d: part("duration_seconds", d))
    state = lambda value: F.array(part("status", value))
    called = joined.withColumn("content", F.when(F.col("status").isNull(), F.concat(said, state(F.lit("started")), ident)).otherwise(F.concat(said, ident, state(F.col("status")), timed)))
    orphans = orphan_outputs(rows).withColumn("content", F.concat(F.array(part("text", F.lit(TOOL_RESULT))), state(F.lit("result_received")), ident))
    fields = ["session_id", "source_id", "turn_id", "at", "content", "source_path", "start_offset"]
    both = called.select(*fields).unionByName(orphans.select(*fields))
    made = prefixed_id("msg", F.col("session_id"), F.lit("tool_summary"), F.col("source_path"), F.col("start_offset"))
    return both.withColumns({"message_id": F.coalesce("source_id", made), "role": F.lit("tool"), "message_type": F.lit("tool_summary"), "phase": none, "duplicate_of": none, "occurrence_count": F.lit(1).cast("long")})


def tool_calls(rows: DataFrame) -> DataFrame:
    """Every tool call with its last completion: session_id, call_id, tool, called_at, status
    (result_received, succeeded, failed or called), n_completions."""
    tools = placed(rows).withColumn("call_id", F.try_element_at("texts", F.lit("call_id"))).where("call_id is not null")
    calls = tools.where("subtype = 'tool_call'").select("session_id", "call_id", F.try_element_at("texts", F.lit("tool")).alias("tool"), F.col("at").alias("called_at"), F.col("place").alias("call_place"))
    ends = tools.where("subtype in ('tool_output', 'mcp_tool_completed', 'patch_result')").select("session_id", "call_id", "place", "subtype", "succeeded")
    attached = attach_latest(ends, calls, ["session_id", "call_id"], "place", "call_place", ["call_place"], "semi")
    status = F.when(F.col("subtype") == "tool_output", "result_received").when(F.col("succeeded"), "succeeded").otherwise("failed")
    last = attached.groupBy("session_id", "call_id", "call_place").agg(F.max_by(status, "place").alias("status"), F.count("*").alias("n_completions"))
    out = calls.join(last, ["session_id", "call_id", "call_place"], "left")
    return out.select("session_id", "call_id", "tool", "called_at", F.coalesce("status", F.lit("called")).alias("status"), F.coalesce("n_completions", F.lit(0)).alias("n_completions"))


def orphan_outputs(rows: DataFrame) -> DataFrame:
    """Outputs without an earlier call of their id; they stand for themselves."""
    tools = placed(rows).withColumn("call_id", F.try_element_at("texts", F.lit("call_id")))
    calls = tools.where("subtype = 'tool_call'").select("session_id", "call_id", F.col("place").alias("call_place"))
    return attach_latest(tools.where("subtype = 'tool_output'"), calls, ["session_id", "call_id"], "place", "call_place", ["call_place"], "anti")


def turn_rows(rows: DataFrame) -> DataFrame:
    """Turn events for operators.turns: session_id, turn_id, PLACE, kind, num_turns."""
    kind = F.when(F.col("source_payload_type") == "task_started", "start").when(F.col("source_payload_type") == "task_complete", "complete").when(F.col("source_payload_type") == "turn_aborted", "abort").when(F.col("subtype") == "thread_rolled_back", "rollback")
    found = rows.where("category = 'turn'").withColumn("kind", kind).where("kind is not null")
    return found.select("session_id", "turn_id", *PLACE, "kind", F.coalesce(F.try_element_at("numbers", F.lit("num_turns")), F.lit(0)).cast("int").alias("num_turns"))
