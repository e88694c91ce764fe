"""Byte-range source, keyed state, publishing and outbox."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.keys import sum_of_hex
from logloom.operators import dedup, publish, timeline, turns
from logloom.sources import ranges
from logloom.streaming import incremental, outbox, stateful


# --- byte ranges ---


class Counted:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += len(self.data[at : at + n])
        return self.data[at : at + n]


def plain_lines(data, begin):
    out, at = [], begin
    while (end := data.find(b"\n", at)) >= 0:
        out.append((at, end + 1, data[at : end + 1]))
        at = end + 1
    return out


def test_ranges_give_every_line_once(monkeypatch):
    rnd = random.Random(7)
    for _ in range(300):
        monkeypatch.setattr(ranges, "RANGE", rnd.choice([1, 3, 10, 50]))
        monkeypatch.setattr(ranges, "BLOCK", rnd.choice([1, 2, 7, 1000]))
        data = b"".join(bytes(rnd.choice(b"ab\r") for _ in range(rnd.randrange(12))) + b"\n" for _ in range(rnd.randrange(20))) + b"tail" * rnd.randrange(2)
        starts = [0] + [e for _, e, _ in plain_lines(data, 0)]
        begin = rnd.choice(starts)
        got = [x for part in ranges.ranges_of("p", "new", begin, len(data)) for x in ranges.lines_of(Counted(data), part)]
        assert got == plain_lines(data, begin)
        assert ranges.last_line_end(Counted(data), len(data), 0) == starts[-1]


def read(spark, tmp_path, name, cursors=None):
    lines, after = ranges.read_lines(spark, str(tmp_path / "live"), str(tmp_path / name), cursors)
    kept = spark.createDataFrame(after.collect(), ranges.CURSORS)
    return sorted((r.path.rsplit("/", 1)[1], r.line_number, r.start_offset, r.raw, r.reason) for r in lines.collect()), kept


def test_reads_resume_number_lines_and_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 16)
    live = tmp_path / "live"
    live.mkdir()
    (live / "a.jsonl").write_bytes(b"\xef\xbb\xbfone\r\n\ntwo is a line longer than a range\nthree")
    (live / "b.jsonl").write_bytes(b"x\n")
    rows, cursors = read(spark, tmp_path, "1")
    assert [r[:4] for r in rows] == [("a.jsonl", 1, 0, "one"), ("a.jsonl", 3, 9, "two is a line longer than a range"), ("b.jsonl", 1, 0, "x")]
    with (live / "a.jsonl").open("ab") as f:
        f.write(b" more\nfour\n")
    rows, cursors = read(spark, tmp_path, "2", cursors)
    assert rows == [("a.jsonl", 4, 43, "three more", "resume"), ("a.jsonl", 5, 54, "four", "resume")]
    rows, cursors = read(spark, tmp_path, "3", cursors)
    assert rows == [] and {r.path.rsplit("/", 1)[1]: (r.offset, r.line_number) for r in cursors.collect()} == {"a.jsonl": (59, 5), "b.jsonl": (2, 1)}
    (live / "a.jsonl").write_bytes((live / "a.jsonl").read_bytes().replace(b"one", b"ONE") + b"five\n")
    (live / "b.jsonl").write_bytes(b"y")
    rows, cursors = read(spark, tmp_path, "4", cursors)
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [("a.jsonl", 1, "ONE", "prefix_changed"), ("a.jsonl", 3, "two is a line longer than a range", "prefix_changed"), ("a.jsonl", 4, "three more", "prefix_changed"), ("a.jsonl", 5, "four", "prefix_changed"), ("a.jsonl", 6, "five", "prefix_changed")]
    assert {r.path.rsplit("/", 1)[1]: r.offset for r in cursors.collect()} == {"a.jsonl": 64, "b.jsonl": 0}


def test_a_sparse_file_of_three_gigabytes_is_read_behind_its_cursor_alone(spark, tmp_path):
    live = tmp_path / "live"
    live.mkdir()
    size = 3 << 30
    with (live / "big.jsonl").open("wb") as f:
        f.write(b"first\n")
        f.seek(size - 1)
        f.write(b"\nlast\n")
    data = Counted(b"")
    fs, _ = ranges.file_system(str(live))
    with fs.open_input_file(str(live / "big.jsonl")) as file:
        data.read_at = lambda n, at: (setattr(data, "read", data.read + n), file.read_at(n, at))[1]
        heads = ranges.probes(data, size)
        part = ranges.LogRange("p", "resume", 0, size, size + 5, True, size + 5)
        assert list(ranges.lines_of(data, part)) == [(size, size + 5, b"last\n")]
        assert data.read <= 2 * ranges.PROBE + 5
    cursors = spark.createDataFrame([(str(live / "big.jsonl"), size, 2, *heads)], ranges.CURSORS)
    rows, after = read(spark, tmp_path, "1", cursors)
    assert rows == [("big.jsonl", 3, size, "last", "resume")] and after.first().offset == size + 5


def test_no_folder_is_no_line(spark, tmp_path):
    rows, cursors = read(spark, tmp_path, "1")
    assert rows == [] and cursors.count() == 0


def test_streams_take_up_where_they_were(spark, tmp_path):
    live = tmp_path / "live"
    live.mkdir()
    for k in range(3):
        with (live / "a.jsonl").open("ab") as f:
            f.write(b"line %d\nhalf" % k if k < 2 else b" done\n")
        stream = ranges.stream_lines(spark, str(live))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination()
        assert query.exception() is None
    want = ["line 0", "halfline 1", "half done"]
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("start_offset").collect()
    assert [r.raw for r in rows] == want


def test_following_logs_equals_runs_over_them(spark, tmp_path):
    live = tmp_path / "live"
    live.mkdir()
    say = lambda k, **more: json.dumps({"timestamp": f"2026-01-01T00:00:{k:02d}Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "password=hunter2abc"}]} | more})
    steps = [[say(1, id="m1"), say(2)], [say(2), "{broken", say(1, id="m1", role="assistant")], [say(3, id="m2")]]
    for lines in steps:
        with (live / "a.jsonl").open("a") as f:
            f.write("\n".join(lines) + "\n")
        incremental.follow(spark, str(live), str(tmp_path / "followed"), F.lit("s"))
    data = (live / "a.jsonl").read_bytes()  # a changed prefix is read again, and nothing counts twice
    (live / "a.jsonl").write_bytes(data.replace(b'{"timestamp": ', b'{"timestamp" :', 1))
    incremental.follow(spark, str(live), str(tmp_path / "followed"), F.lit("s"))
    incremental.run_once(spark, str(live), str(tmp_path / "state"), session=F.lit("s"))
    got, want = (sorted((r.start_offset, r.identity, r.fingerprint, r.content[0].text) for r in rows.collect()) for rows in (spark.read.parquet(str(tmp_path / "followed" / "rows")), incremental.rows_of(spark, str(tmp_path / "state"))))
    assert got == want and len(got) == 4 and "hunter2" not in str(got)


def test_rows_that_were_not_masked_stop_the_job(spark):
    plain = spark.createDataFrame([([("text", "password=hunter2abc")],), (None,)], "content array<struct<kind:string,text:string>>")
    with pytest.raises(Exception, match="isn't masked"):
        incremental.checked(plain).collect()
    half = spark.createDataFrame([([("text", "x", [1]), ("text", "y", None)],)], "content array<struct<kind:string,text:string,redactions:array<int>>>")
    with pytest.raises(Exception, match="isn't masked"):
        incremental.checked(half).collect()
    fine = half.withColumn("content", F.slice("content", 1, 1))
    assert [r.is_masked for r in incremental.checked(fine).collect()] == [True]


# --- identities and turns ---


def test_identities_keep_rows_of_one_id_and_two_kinds(spark):
    rows = spark.createDataFrame([("s", "i", "event", "a", "f1", 1), ("s", "i", "item", "a", "f2", 2), ("s", "i", "event", "a", "f3", 3), ("s", "", "event", "a", "f1", 4), ("s", "", "event", "a", "f1", 5)], "s string, id string, kind string, payload string, fp string, at int")
    out = dedup.dedup_records(rows, "s", "id", "fp", ["at"], [F.col("at")], ("kind", "payload")).orderBy("at").collect()
    assert [(r.duplicate, r.conflict) for r in out] == [(False, False), (False, False), (True, True), (False, False), (False, False)]


def in_batches(spark, tmp_path, rows, schema, cuts, build, mode, each):
    """Feeds rows to a stream in the given cuts, one file a batch."""
    source = tmp_path / "in"
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("overwrite").parquet(str(source / f"{k:03d}"))
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        query = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(each).trigger(availableNow=True).start()
        query.awaitTermination()


def test_streamed_identities_equal_one_run(spark, tmp_path):
    rnd = random.Random(11)
    schema = "s string, id string, kind string, fp string, path string, offset long, at long"
    rows = [(rnd.choice("ab"), rnd.choice([None, "", "1", "2"]), rnd.choice("xy"), rnd.choice(["f", "g"]), "p", k, k) for k in range(40)]
    replay = rows[10:20]
    fed = rows[:25] + replay + rows[25:]
    found = []
    build = lambda df: stateful.stream_identities(df, "s", "id", "fp", "path", "offset", "at", ("kind",))
    in_batches(spark, tmp_path, fed, schema, [12, 25, 35], build, "append", lambda df, n: found.extend(df.collect()))
    kept = sorted((r.s, r.offset, r.identity) for r in found if not r.duplicate)
    whole = dedup.dedup_records(spark.createDataFrame(rows, schema), "s", "id", "fp", ["path", "offset"], [F.col("at"), F.col("path"), F.col("offset")], ("kind",)).collect()
    assert kept == sorted((r.s, r.offset, r.identity) for r in whole if not r.duplicate)
    first = {}
    for r in found:
        first.setdefault((r.s, r.offset), r)
    assert {k: (r.identity, r.duplicate, r.conflict) for k, r in first.items()} == {(r.s, r.offset): (r.identity, r.duplicate, r.conflict) for r in whole}
    assert len(found) == len(fed)


def some_events(seed, n):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), k // 2, rnd.choice(["p", "q"]), k, rnd.choice(["t1", "t2", "t3", "t4", None]), rnd.choice(["start", "start", "complete", "abort", "rollback", "other"]), rnd.choice([None, 0, 1, 2, -1]), rnd.choice([None, "why"])) for k in range(n)]


EVENTS = "s string, at long, path string, offset long, turn string, kind string, n long, reason string"


@pytest.mark.parametrize("cuts", [[7, 30, 44], [20, 22]])
def test_streamed_turns_equal_one_run(spark, tmp_path, cuts):
    rows = sorted(some_events(len(cuts), 60), key=lambda r: (r[1], r[2], r[3]))
    latest = {}
    order = ["at", "path", "offset"]
    build = lambda df: stateful.stream_turns(df, "s", order, "turn", "kind", "n", "reason")
    in_batches(spark, tmp_path, rows, EVENTS, cuts, build, "update", lambda df, n: latest.update({(r.s, r.turn_id): r for r in df.collect()}))
    whole = turns.turns_by_id(spark.createDataFrame(rows, EVENTS), "s", order, "turn", "kind", "n", "reason").collect()
    assert sorted(map(repr, latest.values())) == sorted(map(repr, whole))


def test_sessions_over_two_files_go_by_time(spark):
    def row(path, offset, at, subtype, kind, call=None, role=None, text=None):
        parts = [] if text is None else [("text", text)]
        return ("s", path, offset, at, "turn" if kind else "message" if text else "tool", subtype, kind, "t1", None, {"call_id": call, "tool": "sh"} if call else {}, {}, True, 1.5, role, None, parts)

    schema = "session_id string, source_path string, start_offset long, at long, category string, subtype string, source_payload_type string, turn_id string, source_id string, texts map<string,string>, numbers map<string,long>, succeeded boolean, duration_s double, role string, phase string, content array<struct<kind:string,text:string>>"
    rows = [row("z", 900, 1, "tool_call", None, "c"), row("a", 10, 2, "tool_output", None, "c"), row("z", 950, 0, "chat_message", None, role="user", text="first"), row("a", 0, 3, "chat_message", None, role="user", text="last"), row("z", 1000, 4, "turn", "task_started"), row("a", 50, 5, "turn", "task_complete")]
    df = spark.createDataFrame(rows, schema)
    chat = timeline.chat_messages(df).orderBy("sequence").collect()
    assert [r.text.split("\n")[0] for r in chat] == ["first", "ツールを実行: sh", "last"]
    assert [(r.status, r.n_completions) for r in timeline.tool_calls(df).collect()] == [("result_received", 1)]
    assert timeline.orphan_outputs(df).count() == 0
    made = turns.turns_by_id(timeline.turn_rows(df), "session_id", list(timeline.PLACE), "turn_id", "kind", "num_turns").collect()
    assert [(r.turn_id, r.status, r.start_at, r.end_at) for r in made] == [("t1", "completed", 1, 2)]


# --- sums, publishing, outbox ---


def test_sums_of_digests_equal_integers(spark):
    rnd = random.Random(5)
    for n in (0, 1, 2, 200):
        values = [rnd.choice([rnd.getrandbits(256), (1 << 256) - 1, 0]) for _ in range(n)]
        df = spark.createDataFrame([(f"{v:064x}",) for v in values] + [(None,)], "h string").repartition(3)
        assert df.agg(sum_of_hex(F.col("h"))).first()[0] == f"{sum(values) % (1 << 256):064x}"


def documents(spark, snapshot, *names):
    body = lambda name: publish.encode_json({"schema_version": "1.0", "data_type": name, "snapshot_id": snapshot, "generated_at": "now", "workspace_id": "w"})
    return spark.createDataFrame([(f"{n}.json", body(n)) for n in names], "path string, body string")


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert publish.publish(documents(spark, "s1", "a"), root, "w", "s1") == 1
    assert publish.publish(documents(spark, "s1", "a"), root, "w", "s1") == 1  # current already
    with pytest.raises(publish.Conflict):
        publish.publish(documents(spark, "s2", "a"), root, "w", "s2", expected=0)
    verify = publish.verify_version
    # another writer moves the pointer between this one's look at it and its own move
    def late(*args):
        monkeypatch.setattr(publish, "verify_version", verify)
        publish.publish(documents(spark, "s3", "a"), root, "w", "s3", expected=1)
        verify(*args)

    monkeypatch.setattr(publish, "verify_version", late)
    with pytest.raises(publish.Conflict):
        publish.publish(documents(spark, "s2", "a", "b"), root, "w", "s2", expected=1)
    assert publish.current(spark, root).first().snapshot == "s3" and publish.read_current(spark, root, "w").count() == 1


def test_what_is_stored_otherwise_is_refused(spark, tmp_path):
    docs = documents(spark, "s1", "a", "b")
    wanted = publish.manifest_digest(publish.manifest_of(docs))
    docs.withColumn("body", F.when(F.col("path") == "b.json", F.concat("body", F.lit(" "))).otherwise(F.col("body"))).write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError):
        publish.verify_version(spark, str(tmp_path / "v"), wanted)


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["claim", "store", "check", "ready", "deliver", "committed", "done"])
def test_an_outbox_that_is_lost_at_any_step_delivers_once(spark, tmp_path, monkeypatch, step):
    root, had = str(tmp_path), {}
    once, verify = outbox.create_once, outbox.verify_version
    armed = [True]

    def lose(at):
        if armed[0] and at == step:
            armed[0] = False
            raise Lost

    def create(spark, path, text):
        kind = path.rsplit("/", 2)[1]
        if kind in ("claims", "ready", "done"):
            lose({"claims": "claim", "ready": "ready", "done": "done"}[kind])
        made = once(spark, path, text)
        if kind == "claims":
            lose("store")
        return made

    def check(*args):
        verify(*args)
        lose("check")

    def deliver(item, docs):
        lose("deliver")
        had.setdefault(item["delivery_id"], []).append((item["snapshot"], sorted(r.path for r in docs.collect())))
        lose("committed")

    monkeypatch.setattr(outbox, "create_once", create)
    monkeypatch.setattr(outbox, "verify_version", check)
    for snapshot in ("s1", "s2"):
        while True:
            try:
                outbox.enqueue(documents(spark, snapshot, "a", "b"), root, "w", snapshot)
                break
            except Lost:
                pass
    sent = []
    while True:
        try:
            number = outbox.send_next(spark, root, deliver)
        except Lost:
            continue
        if number is None:
            break
        sent.append(number)
    assert len(had) == 2 and sent == sorted(sent)
    assert [x[0] for x in had.values()] == [("s1", ["a.json", "b.json"]), ("s2", ["a.json", "b.json"])]
    assert outbox.pending(spark, root).count() == 0


def test_a_tampered_item_is_not_sent(spark, tmp_path):
    number = outbox.enqueue(documents(spark, "s1", "a"), str(tmp_path), "w", "s1")
    documents(spark, "s1", "b").write.mode("overwrite").parquet(f"{tmp_path}/items/{number:020d}")
    with pytest.raises(ValueError):
        outbox.send_next(spark, str(tmp_path), lambda item, docs: pytest.fail("sent"))
    for bad in (documents(spark, "s", "a").limit(0), documents(spark, "s", "a", "a")):
        with pytest.raises(ValueError):
            outbox.enqueue(bad, str(tmp_path), "w", "s")
    assert json.loads(spark.read.text(f"{tmp_path}/ready/*.json").first()[0])["number"] == number
