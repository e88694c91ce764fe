"""Reading, normalizing and resuming session logs."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import normalize, timeline, turns
from logloom.sources import jsonl, vcs
from logloom.streaming import incremental


def line(kind, payload, at="2026-01-01T00:00:00Z"):
    return json.dumps({"timestamp": at, "type": kind, "payload": payload}, ensure_ascii=False) + "\n"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8", newline="") as f:
        f.write("".join(lines))


USER = {"type": "message", "role": "user", "id": "m1", "content": [{"type": "input_text", "text": "héllo"}]}


def test_offsets_tails_and_issues(spark, tmp_path):
    log = tmp_path / "live" / "a.jsonl"
    write(log, line("response_item", USER), "{broken\n", line("odd", {}), '{"timestamp": 1, "type": "event_msg", "payload": {}}\n', line("event_msg", {"type": "task_started"})[:-1])
    records, cursors = jsonl.read_log(spark, str(tmp_path / "live"))
    rows = records.orderBy("line_number").collect()
    assert [r.issue for r in rows] == [None, "malformed_json", "unknown_record_type", "invalid_record"]
    data = log.read_bytes()
    assert rows[0].end_offset == data.index(b"\n") + 1 == rows[1].start_offset
    cursor = cursors.first()
    assert (cursor.offset, cursor.line_number) == (data.rindex(b"\n") + 1, 4)
    kept = spark.createDataFrame(cursors.collect(), jsonl.CURSORS)
    write(log, "\n", line("response_item", USER))
    records, _ = jsonl.read_log(spark, str(tmp_path / "live"), cursors=kept)
    assert [(r.line_number, r.issue) for r in records.orderBy("line_number").collect()] == [(5, None), (6, None)]
    changed = log.read_bytes().replace(b"broken", b"BROKEN")
    log.write_bytes(changed)
    files = jsonl.resume(jsonl.find_files(spark, str(tmp_path / "live")), kept)
    assert files.first().reason == "prefix_changed"
    log.write_bytes(changed[:9])
    assert jsonl.resume(jsonl.find_files(spark, str(tmp_path / "live")), kept).first().reason == "file_truncated"


def test_every_payload_type_normalizes(spark, tmp_path):
    log = tmp_path / "live" / "a.jsonl"
    for (kind, payload), _ in normalize.ROWS.items():
        write(log, line(kind, {"type": payload} if payload else {"id": "x"}))
    write(log, line("event_msg", {"type": "never_seen"}))
    records, _ = jsonl.read_log(spark, str(tmp_path / "live"))
    rows = normalize.normalize(records)
    assert rows.count() == len(normalize.ROWS)
    assert {(r.category, r.subtype) for r in rows.collect()} == set(normalize.ROWS.values())
    assert [r.kind for r in normalize.unknown_payloads(records).collect()] == ["never_seen"]


def test_strict_kinds(spark, tmp_path):
    log = tmp_path / "live" / "a.jsonl"
    write(log, line("event_msg", {"type": "thread_rolled_back", "num_turns": True}), line("event_msg", {"type": "thread_rolled_back", "num_turns": 2}), line("response_item", {"type": "message", "role": 5, "content": "plain"}))
    write(log, line("event_msg", {"type": "patch_apply_end", "call_id": "c", "success": False, "stderr": "no", "changes": {"b": {"type": "update"}, "a": {"type": "add", "move_path": "z"}}}))
    write(log, line("event_msg", {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 7}}}))
    rows = normalize.normalize(jsonl.read_log(spark, str(tmp_path / "live"))[0]).orderBy("line_number").collect()
    assert "num_turns" not in rows[0].numbers and rows[1].numbers["num_turns"] == 2
    assert rows[2].role is None and [p.text for p in rows[2].content] == ["plain"]
    assert [(c.path, c.move_path) for c in rows[3].changes] == [("a", "z"), ("b", None)] and rows[3].succeeded is False
    assert rows[4].usage.input_tokens == 7 and rows[4].usage.output_tokens is None


def test_rows_have_the_fields_of_their_shape(spark, tmp_path):
    """Every payload holds every field; a row keeps those of its own subtype."""
    log, everything = tmp_path / "live" / "a.jsonl", {
        "id": "i", "session_id": "s", "turn_id": "t", "role": "user", "phase": "p", "content": ["c", {"type": "input_image"}, {"type": "my_image", "text": "i"}, {"type": "my_image"}], "message": "m", "output": "o", "arguments": "a", "input": "n",
        "stdout": "out", "stderr": "", "success": True, "result": {"Err": None}, "duration": {"secs": 1, "nanos": 500_000_000}, "changes": {"x": {"type": "add"}, "y": 3}, "results": [1, 2], "workspace_roots": ["/w", 4, None, "/v"], "num_turns": 2,
        "call_id": "k", "name": "sh", "namespace": "ns", "status": "done", "reason": "r", "cwd": "/c", "model": "mo", "effort": "high", "timezone": "UTC", "source": "cli", "originator": "me", "cli_version": "1", "git": {"branch": "b", "commit_hash": "h"},
        "invocation": {"server": "sv", "tool": "tl"}, "thread_settings": {"cwd": "/d", "model": 5}, "action": {"type": "search"}, "started_at": 1, "completed_at": 2, "duration_ms": True, "time_to_first_token_ms": 4, "info": {"last_token_usage": {"input_tokens": 7}},
    }
    for kind, payload in normalize.ROWS:
        write(log, line(kind, everything | ({"type": payload} if payload else {})))
    got = {(r.source_record_type, r.source_payload_type): r for r in normalize.normalize(jsonl.read_log(spark, str(tmp_path / "live"))[0]).collect()}
    assert len(got) == len(normalize.ROWS)
    parts = {k[1]: [(c.kind, c.text, c.source_type) for c in r.content] for k, r in got.items() if r.content}
    assert parts == {
        "message": [("text", "c", None), ("image_reference", None, "input_image"), ("text", "i", "my_image")], "user_message": [("text", "m", None)], "agent_message": [("text", "m", None)], "function_call": [("tool_input", "a", None)],
        "custom_tool_call": [("tool_input", "n", None)], "function_call_output": [("tool_output", "o", None)], "custom_tool_call_output": [("tool_output", "o", None)], "patch_apply_end": [("stdout", "out", None), ("stderr", "", None)],
    }
    texts = {r.subtype: dict(r.texts) for r in got.values() if r.texts}
    assert texts == {
        "session_metadata": {"cwd": "/c", "source": "cli", "originator": "me", "cli_version": "1", "branch": "b", "commit": "h"}, "turn_context": {"cwd": "/c", "model": "mo", "effort": "high", "timezone": "UTC"},
        "tool_call": {"call_id": "k", "tool": "sh", "namespace": "ns", "call_status": "done"}, "tool_output": {"call_id": "k"}, "turn_status": {"reason": "r"}, "thread_settings": {"settings_cwd": "/d"}, "patch_result": {"call_id": "k", "call_status": "done"},
        "web_search_completed": {"call_id": "k", "action_type": "search"}, "mcp_tool_completed": {"call_id": "k", "server": "sv", "mcp_tool": "tl"},
    }
    assert {r.subtype: dict(r.numbers) for r in got.values() if r.numbers} == {"turn_status": {"started_ms": 1, "completed_ms": 2, "first_token_ms": 4}, "thread_rolled_back": {"num_turns": 2}}
    assert {r.subtype: r.workspace_roots for r in got.values() if r.workspace_roots} == {"turn_context": ["/w", "/v"]}
    assert {r.subtype: (r.succeeded, r.duration_s) for r in got.values() if r.succeeded is not None} == {"patch_result": (True, None), "mcp_tool_completed": (False, 1.5)}
    assert {r.subtype: [c.path for c in r.changes] for r in got.values() if r.changes} == {"patch_result": ["x"]}
    assert {r.subtype: r.n_results for r in got.values() if r.n_results is not None} == {"web_search_completed": 2} and [r.subtype for r in got.values() if r.usage] == ["token_count"]
    assert {r.source_id for k, r in got.items() if k[0] == "response_item"} == {"i"} and got["session_meta", None].source_id == "s" and got["turn_context", None].source_id is None
    assert {r.subtype for k, r in got.items() if k[0] != "response_item" and r.turn_id} == {"turn_context", "chat_message_event", "turn_status", "patch_result"}
    assert {k[1]: r.role for k, r in got.items() if r.role} == {"message": "user", "user_message": "user", "agent_message": "assistant"} | dict.fromkeys(("function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output"), "tool")
    assert {r.subtype for r in got.values() if r.phase} == {"chat_message", "chat_message_event"}


def test_timeline_suppresses_events_that_repeat_messages(spark, tmp_path):
    log = tmp_path / "live" / "a.jsonl"
    say = lambda text: {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}
    write(log, line("response_item", say("<environment_context>x</environment_context>\nhi")), line("response_item", say("same")), line("event_msg", {"type": "user_message", "message": "same"}), line("event_msg", {"type": "user_message", "message": "only here"}))
    write(log, line("response_item", {"type": "function_call", "call_id": "c1", "name": "sh"}), line("response_item", {"type": "function_call_output", "call_id": "c1", "output": "ok"}), line("response_item", {"type": "function_call_output", "call_id": "zz", "output": "?"}))
    write(log, line("event_msg", {"type": "task_started", "turn_id": "t1"}), line("event_msg", {"type": "task_complete", "turn_id": "t1"}), line("event_msg", {"type": "thread_rolled_back", "num_turns": 1}))
    rows = normalize.normalize(jsonl.read_log(spark, str(tmp_path / "live"))[0]).withColumn("session_id", F.lit("s"))
    chat = timeline.chat_messages(rows).orderBy("sequence").collect()
    assert [r.text for r in chat if r.role != "tool"] == ["hi", "same", "only here"]
    assert [(r.sequence, r.role, [tuple(p) for p in r.content]) for r in chat if r.role == "tool"] == [
        (4, "tool", [("text", "ツールを実行: sh"), ("call_id", "c1"), ("status", "result_received")]), (5, "tool", [("text", "ツール結果を受信"), ("status", "result_received"), ("call_id", "zz")]),
    ]
    assert [(r.call_id, r.status) for r in timeline.tool_calls(rows).collect()] == [("c1", "result_received")]
    assert timeline.orphan_outputs(rows).count() == 1
    events = timeline.turn_rows(rows)
    assert [r.status for r in turns.turn_lifecycle(events, "session_id", ["start_offset"], "kind").collect()] == ["completed"]
    undone = turns.roll_back(events.withColumn("push", F.col("kind").isin("complete", "abort").cast("int")), "session_id", ["start_offset"], "push", "num_turns")
    assert [r.rolled_back for r in undone.where("push = 1").collect()] == [True]


def test_prefixes_go_part_by_part(spark):
    kinds = "array<struct<kind:string,text:string>>"
    env, plug = "<environment_context>x</environment_context>", "<recommended_plugins>\ny\n</recommended_plugins>\n"
    cases = [
        ([("text", f" {env}\n{plug}hi")], ["hi"]), ([("text", env), ("text", f"{plug}more"), ("text", env)], ["more", env]), ([("text", env)], []), ([("text", "# AGENTS.md instructions for d\n<INSTRUCTIONS>a</INSTRUCTIONS> go")], ["go"]),
        ([("image", env), ("text", env)], [env, env]), ([("text", "<environment_context>open")], ["<environment_context>open"]), ([("text", f"say {env}")], [f"say {env}"]), ([("text", ""), ("text", env)], ["", env]), ([], []),
    ]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], f"k int, c {kinds}")
    got = {r.k: [p.text for p in r.c] for r in df.select("k", timeline.without_prefix_parts(F.col("c")).alias("c")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_developer_references_and_phases(spark, tmp_path):
    log = tmp_path / "live" / "a.jsonl"
    say = lambda role, text, **more: {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]} | more
    write(log, line("response_item", say("developer", "rules")), line("response_item", say("developer", "rules")), line("response_item", say("assistant", "same", phase="final_answer")), line("event_msg", {"type": "agent_message", "message": "same", "phase": "commentary"}))
    rows = normalize.normalize(jsonl.read_log(spark, str(tmp_path / "live"))[0]).withColumn("session_id", F.lit("s"))
    chat = timeline.chat_messages(rows).orderBy("sequence").collect()
    assert [(r.message_type, r.phase, len(r.content), r.occurrence_count) for r in chat] == [("developer_instruction", None, 1, 2), ("developer_instruction_reference", None, 0, 1), ("chat", "final_answer", 1, 1), ("chat", "commentary", 1, 1)]
    assert chat[1].duplicate_of == chat[0].message_id and chat[3].display_mode == "collapsed"


def test_session_index_takes_the_last_meta(spark, tmp_path):
    write(tmp_path / "live" / "a.jsonl", line("session_meta", {"id": "old"}), line("session_meta", {"id": "new"}))
    write(tmp_path / "archive" / "b.jsonl", line("session_meta", {"id": "new"}, "2025-01-01T00:00:00Z"))
    records, _ = jsonl.read_log(spark, str(tmp_path / "live"), str(tmp_path / "archive"))
    row = jsonl.session_index(records).collect()
    assert len(row) == 1 and row[0].session_id == "new" and row[0].n_files == 2 and row[0].current_path.endswith("a.jsonl")


def test_runs_in_steps_equal_one_run(spark, tmp_path):
    lines = [line("response_item", USER | {"id": f"m{k}"}) for k in range(3)] + [line("event_msg", {"type": "agent_message", "message": "again"})] * 2
    session = F.lit("s")
    for k, text in enumerate(lines):
        write(tmp_path / "steps" / "a.jsonl", text)
        if k % 2:
            incremental.run_once(spark, str(tmp_path / "steps"), str(tmp_path / "state1"), session=session)
    incremental.run_once(spark, str(tmp_path / "steps"), str(tmp_path / "state1"), session=session)
    write(tmp_path / "whole" / "a.jsonl", *lines)
    incremental.run_once(spark, str(tmp_path / "whole"), str(tmp_path / "state2"), session=session)
    one, two = (sorted((r.start_offset, r.identity) for r in incremental.rows_of(spark, str(tmp_path / s)).collect()) for s in ("state1", "state2"))
    assert one == two and len(one) == 5


def test_streaming_upsert_counts_a_repeated_batch_once(spark, tmp_path):
    write_batch = incremental.upsert_batch(str(tmp_path / "out"), ["id"])
    batch = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    write_batch(batch, 0)
    write_batch(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_later_batches_win(spark, tmp_path):
    out, small = str(tmp_path / "out"), str(tmp_path / "small")
    write_batch = incremental.upsert_batch(out, ["id"])
    write_batch(spark.createDataFrame([(1, "old"), (2, None)], "id int, v string"), 0)
    write_batch(spark.createDataFrame([(1, "new"), (3, "x")], "id int, v string"), 1)
    want = [(1, "new"), (2, None), (3, "x")]
    assert sorted((r.id, r.v) for r in incremental.latest_rows(spark, out, ["id"]).collect()) == want
    incremental.compact_batches(spark, out, small, ["id"])
    assert sorted((r.id, r.v) for r in incremental.latest_rows(spark, small, ["id"]).collect()) == want


@pytest.mark.parametrize("code, states", [("??", ("none", "untracked", False)), ("AA", ("conflicted", "conflicted", True)), ("MU", ("conflicted", "conflicted", True)), ("T ", ("type_changed", "none", False)), (" D", ("none", "deleted", False)), ("AM", ("added", "modified", False))])
def test_status_codes(code, states):
    assert vcs.parse_status(f"{code} dir/with space\0".encode()) == [("dir/with space", None, *states)]


def test_status_of_moves_and_odd_names():
    out = vcs.parse_status("RM to/x\0from/y\0 C new\0old\0M  line\nfeed\0A  back\\slash\0".encode())
    assert out == [("to/x", "from/y", "renamed", "modified", False), ("new", "old", "none", "copied", False), ("line\nfeed", None, "modified", "none", False), ("back/slash", None, "added", "none", False)]
    assert vcs.parse_status(b"") == vcs.parse_status(None) == []


@pytest.mark.parametrize("parser, data", [
    (vcs.parse_status, b"M  cut"), (vcs.parse_status, b"M:x\0"), (vcs.parse_status, b"R  only\0"), (vcs.parse_status, b"XY x\0"), (vcs.parse_status, b"M  ../x\0"), (vcs.parse_status, b"M  C:/x\0"), (vcs.parse_status, b"M  \xff\0"), (vcs.parse_status, b"M  /\0"),
    (vcs.parse_names, b"Q\0x\0"), (vcs.parse_names, b"C075\0x\0"), (vcs.parse_names, b"M\0x"), (vcs.parse_numstat, b"1\t-\tx\0"), (vcs.parse_numstat, b"-1\t2\tx\0"), (vcs.parse_numstat, b"1\t2\t\0x\0"), (vcs.parse_numstat, b"1 2 x\0"),
])
def test_malformed_output_is_refused(parser, data):
    with pytest.raises(vcs.Malformed):
        parser(data)


def test_names_and_numbers():
    assert vcs.parse_names(b"T\0t\0C075\0from\0to\0D\tgone\0") == [("t", None, "type_changed"), ("to", "from", "copied"), ("gone", None, "deleted")]
    assert vcs.parse_numstat(b"12\t0\tsrc/m.py\0-\t-\tlogo.bin\x000\t7\t\0was\0is\0") == [("src/m.py", None, 12, 0, False), ("logo.bin", None, None, None, True), ("is", "was", 0, 7, False)]


def test_malformed_outputs_are_rows(spark):
    df = spark.createDataFrame([("a", bytearray(b"1\t2\tx\0")), ("b", bytearray(b"?\0")), ("c", None)], "id string, out binary")
    assert [(r.id, r.issue) for r in vcs.malformed(df, "out", vcs.parse_numstat, vcs.NUMSTAT).collect()] == [("b", "invalid_record")]
    assert [r.id for r in vcs.with_changes(df, "out", vcs.parse_numstat, vcs.NUMSTAT, "c").collect()] == ["a"]


def test_vcs_rows(spark):
    df = spark.createDataFrame([(bytearray(b"1\t2\tx\0-\t-\ty\0"),)], "out binary")
    rows = vcs.with_changes(df, "out", vcs.parse_numstat, vcs.NUMSTAT, "c").select("c.*", vcs.line_state(F.col("c.binary"), F.col("c.added")).alias("state")).collect()
    assert [(r.path, r.state) for r in rows] == [("x", "measured"), ("y", "binary")]


def test_each_bad_item_is_an_issue(spark, tmp_path):
    log = tmp_path / "live" / "a.jsonl"
    say = lambda content: line("response_item", {"type": "message", "role": "user", "content": content})
    write(log, say(["a", 5, {"type": "audio"}, {"text": 7}, None, {"type": "input_image", "text": "seen"}, {"type": "input_image"}, ["x"]]), say({"text": "x"}), say(None), say([]), say("fine"))
    write(log, line("event_msg", {"type": "user_message", "message": 5}), line("event_msg", {"type": "user_message", "message": None}), line("event_msg", {"type": "user_message"}), line("event_msg", {"type": "patch_apply_end", "stdout": 1, "stderr": []}))
    write(log, line("response_item", {"type": "strange"}), line("event_msg", {"type": 3}), line("event_msg", {"type": "message"}), '{"timestamp": "yesterday", "type": "response_item", "payload": {"type": "message", "content": [0]}}\n')
    records, _ = jsonl.read_log(spark, str(tmp_path / "live"))
    got = sorted((r.line_number, r.kind, r.field) for r in normalize.normalization_issues(records).collect() if r.field is not None)
    assert got == sorted([
        (1, "invalid_content_item", "content"), (1, "invalid_content_item", "content"), (1, "invalid_content_item", "content"), (1, "unsupported_content_item", "audio"), (2, "invalid_content", "content"), (3, "invalid_content", "content"), (6, "invalid_text", "message"),
        (9, "invalid_text", "stderr"), (9, "invalid_text", "stdout"), (10, "unsupported_response_item", "strange"), (12, "unsupported_event_message", "message"), (13, "invalid_content_item", "content"), (13, "invalid_timestamp", "timestamp"),
    ])
    assert sorted((r.line_number, r.kind) for r in normalize.normalization_issues(records).where("field is null").collect()) == [(1, "unsupported_content_item"), (11, "unsupported_event_message")]
