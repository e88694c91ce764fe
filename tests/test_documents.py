"""Files, summaries, decisions, chunks and publication."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import documents, files, publish, summaries


def test_mentions_and_scopes(spark):
    text = "See [x](src/a.py) and `lib/b.py:10:2`, not http://e.org/c.py\n```\nsrc/hidden.py\n```\nalso ../../etc/passwd.txt and C:\\work\\src\\A.py or notes.md"
    rows = files.file_mentions(spark.createDataFrame([("m1", text)], "id string, text string"), "text", "id", "C:/work")
    got = {(r.origin, r.scope, r.path, r.line, r.extension) for r in rows.collect()}
    assert got == {("link", "workspace", "src/a.py", None, "py"), ("inline_code", "workspace", "lib/b.py", 10, "py"), ("relative_file", "external", None, None, "txt"), ("drive", "workspace", "src/A.py", None, "py"), ("bare_file", "workspace", "notes.md", None, "md")}
    refs = {r.path.lower(): r.mentions for r in files.file_references(rows, "id").collect()}
    assert refs == {"src/a.py": 2, "lib/b.py": 1, "notes.md": 1}


def test_summaries_and_next_tasks(spark):
    rows = [
        ("t1", 1, "修正しました。\n- 解析器を追加", "completed"), ("t2", 1, "## 結果: 解析器を修正しました。 ほか\n```\nテスト完了\n```\n- 解析器を追加\n- テストが通過", "completed"),
        ("t3", 1, "途中で失敗しました。", "failed"), ("t3b", 1, "途中で失敗しました。", "in_progress"), ("t4", 2, "次の作業は「文書を書く」です", "completed"), ("t4", 1, "Next task: old", "completed"),
    ]
    df = spark.createDataFrame(rows, "t string, at int, text string, status string")
    out = {r.t: r.s for r in df.select("t", summaries.explicit_summary(F.col("text"), F.col("status")).alias("s")).where("t != 't4'").collect()}
    assert out["t2"].title == "解析器を修正しました" and out["t2"].summary == "結果: 解析器を修正しました。" and out["t2"].highlights == ["解析器を追加"] and out["t2"].verification == ["テストが通過"] and out["t2"].confidence == "high"
    assert out["t1"] is None or out["t1"].summary != "修正しました。"  # a generic phrase alone tells nothing
    assert out["t3"].summary == "途中で失敗しました。" and out["t3"].confidence == "medium" and out["t3b"] is None
    cached = spark.createDataFrame([("t1", "from cache")], "t string, task string")
    tasks = {r.t: (r.task, r.route) for r in summaries.next_task(df, ["t"], "at", "text", cached).collect()}
    assert tasks == {"t1": ("from cache", "cache"), "t2": (None, "fallback"), "t3": (None, "fallback"), "t3b": (None, "fallback"), "t4": ("文書を書く", "explicit")}


def test_decisions(spark):
    text = "- 待ち時間は60秒にします。遅いため、ポーリングを採用しません。Rustを使います\nスレッドを検討中です。キャッシュは不要です！"
    row = spark.createDataFrame([(text,)], "t string").select(summaries.decision_proposals(F.col("t")).alias("d"), summaries.states_decision(F.col("t")).alias("y"), summaries.states_decision(F.lit("案Aを採用します")).alias("n")).first()
    assert [(d.topic, d.choice, d.status, d.reason, d.title) for d in row.d] == [
        ("待ち時間", "60秒", "adopted", None, "待ち時間: 60秒"), ("ポーリング", "ポーリング", "rejected", "遅いため", "ポーリング"), ("rust", "Rust", "adopted", None, "Rust"), ("キャッシュ", "キャッシュ", "rejected", None, "キャッシュ"),
    ]
    assert row.y and not row.n


def test_seeded_decisions_go_on_from_history(spark):
    from logloom.operators import versions

    schema = "topic string, choice string, at int"
    old, new = spark.createDataFrame([("t", "60", 9)], schema), spark.createDataFrame([("t", "60", 1), ("t", "120", 2)], schema)
    both = summaries.seeded_decisions(old, new, ["at"])
    out = versions.supersede_chain(both, "topic", ["choice"], ["place"], "at").orderBy("version").collect()
    assert [(r.choice, r.n_sources) for r in out] == [("60", 2), ("120", 1)] and out[1].supersedes == out[0].decision_id


def test_routes_and_validation(spark):
    row = spark.range(1).select(
        summaries.combined_eligibility(F.lit("in_progress"), F.lit(True), F.lit(True), F.lit(False), F.lit(True), F.lit(False)).alias("a"),
        summaries.combined_eligibility(F.lit("completed"), F.lit(True), F.lit(None).cast("boolean"), F.lit(True), F.lit(True), F.lit(False)).alias("b"),
        summaries.combined_eligibility(F.lit("completed"), F.lit(True), F.lit(True), F.lit(False), F.lit(True), F.lit(False)).alias("c"),
        summaries.short_nonchange(F.array(F.lit("はい。"), F.lit("ok !")), F.lit(False), F.lit(False), ["はい", "ok"]).alias("d"),
        summaries.short_nonchange(F.array(F.lit("はい。")), F.lit(True), F.lit(False), ["はい"]).alias("e"),
    ).first()
    assert tuple(row) == ("turn_in_progress", "inference_input_not_masked", None, True, False)
    items = spark.createDataFrame([("g", 1, "aaaa"), ("g", 2, "漢字"), ("g", 3, "b"), ("h", 1, None)], "g string, at int, text string")
    out = {r.g: (r.texts, r.left_out) for r in summaries.bounded_prompt(items, ["g"], [F.col("at")], "text", 10).collect()}
    assert out["g"] == (["aaaa", "漢字"], 1)
    results = spark.createDataFrame([([("adopted", "t", "d", None, "k", ["m1"]), ("maybe", "t", "d", None, "k", []), ("rejected", "t", " ", None, "k", []), ("rejected", "t", "d", None, "k", ["m9"])],)], "r array<struct<status:string,title:string,description:string,reason:string,topic:string,evidence:array<string>>>")
    assert [x.status for x in results.select(summaries.valid_results(F.col("r"), F.array(F.lit("m1"))).alias("r")).first().r] == ["adopted"]
    turns, none = spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t string, summary string"
    routed = summaries.summary_route(turns, spark.createDataFrame([("a", "x")], none), spark.createDataFrame([("a", "y"), ("b", "z")], none), ["t"])
    assert {r.t: (r.summary, r.route) for r in routed.collect()} == {"a": ("x", "cache"), "b": ("z", "explicit"), "c": (None, "pending")}


def test_blocks_and_prefixes(spark):
    from logloom.operators import documents

    rows = [("a", "x\n```py\n1\n```\ny"), ("b", "open\n```py\n1"), ("c", ""), ("d", None), ("e", "```\n\n```")]
    found = documents.content_blocks(spark.createDataFrame(rows, "id string, text string"), "id", "text").orderBy("id", "position").collect()
    assert [(r.id, r.kind, r.language, r.body) for r in found] == [("a", "text", None, "x\n"), ("a", "code", "py", "1\n"), ("a", "text", None, "y"), ("b", "text", None, "open\n```py\n1"), ("e", "code", None, "\n")]
    assert len({r.block_id for r in found}) == len(found)
    texts = ["", "plain", "漢字" * 30, 'q"' * 40, None, "\n" * 50]
    fitted = documents.fitting_prefix(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 40).collect()
    for r in fitted:
        if r.t is not None:
            best = max((k for k in range(len(r.t) + 1) if len(json.dumps(r.t[:k], ensure_ascii=False).encode()) <= 40), default=0)
            assert r.prefix == r.t[:best]
    assert [r.prefix for r in fitted if r.t is None] == [None]


@given(st.text(max_size=300), st.integers(4, 40))
def test_chunks_join_to_the_text(text, most):
    text = text.encode("utf-8", "replace").decode()
    parts = publish.split_utf8(text, most)
    assert "".join(parts) == text and all(len(p.encode()) <= most for p in parts)


def test_chunked_rows_and_fences(spark):
    df = spark.createDataFrame([(1, "漢字\n" * 50), (2, None), (3, "")], "id int, text string")
    rows = publish.chunked(df, "text", 64).orderBy("id", "part").collect()
    assert "".join(r.text for r in rows if r.id == 1) == "漢字\n" * 50 and {r.id for r in rows} == {1, 3}
    text = spark.createDataFrame([("a\n```py\nx\n```\nb",), ("a\n```py\nx",)], "t string").select(publish.fenced_blocks(F.col("t")).alias("b")).collect()
    assert [(b.kind, b.language, b.body) for b in text[0].b] == [("text", None, "a\n"), ("code", "py", "x\n"), ("text", None, "b")]
    assert [b.kind for b in text[1].b] == ["text"]


def document(**more):
    return publish.encode_json({"schema_version": "1.0", "data_type": "x", "snapshot_id": "s1", "generated_at": "now", "workspace_id": "w"} | more)


def test_issues(spark):
    rows = [("ok.json", document()), ("../x.json", document()), ("A.json", document()), ("a.json", document()), ("bad.json", "{"), ("twice.json", '{"a": 1, "a": 2}'), ("v.json", document(schema_version="2.0")), ("id.json", document(snapshot_id="other")), ("m.json", json.dumps({"schema_version": "1.0"}))]
    found = {r.path: r.issue for r in publish.document_issues(spark.createDataFrame(rows, "path string, body string"), "path", "body", "w", "s1").collect()}
    assert found == {"../x.json": "unsafe_path", "A.json": "case_collision", "a.json": "case_collision", "bad.json": "bad_json", "twice.json": "bad_json", "v.json": "wrong_version", "id.json": "wrong_identity", "m.json": "missing_field"}


def test_publication_and_receipts(spark, tmp_path):
    root = str(tmp_path)
    for name in ("s1", "s2"):
        publish.publish(spark.createDataFrame([("a.json", document(snapshot_id=name))], "path string, body string"), root, "w", name)
    assert publish.current(spark, root).collect()[0].snapshot == "s2"
    assert json.loads(publish.read_current(spark, root, "w").first().body)["snapshot_id"] == "s2"
    with pytest.raises(ValueError):
        publish.publish(spark.createDataFrame([("a.json", "{")], "path string, body string"), root, "w", "s3")
    receipts = spark.createDataFrame([("d1", "h1")], "delivery_id string, body_sha256 string")
    incoming = spark.createDataFrame([("d1", "h1"), ("d1", "hX"), ("d2", "h2"), ("d2", "h2")], "delivery_id string, body_sha256 string")
    assert sorted((r.delivery_id, r.body_sha256, r.state) for r in publish.receive(receipts, incoming).collect()) == [("d1", "h1", "repeated"), ("d1", "hX", "conflict"), ("d2", "h2", "new")]


def test_own_mentions_are_of_the_message_and_must_exist(spark):
    mentions = spark.createDataFrame([("c", 1, 5), ("c", 1, 2), ("c", 2, 9), ("d", 1, 7), ("d", None, 8)], "conv string, message int, line int")
    named = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "conv string, message int, line string")
    got = documents.own_mentions(named, mentions, ["conv", "message"]).collect()
    assert sorted((r.conv, r.message, r.line, [m.line for m in r.mentions]) for r in got) == [("c", 1, "x", [2, 5]), ("c", 2, "y", [9])]
    assert documents.own_mentions(named.limit(0), mentions, ["conv", "message"]).count() == 0
    for conv, message in (("c", 3), ("d", None)):
        with pytest.raises(Exception, match="doesn't mention its message"):
            documents.own_mentions(spark.createDataFrame([(conv, message)], "conv string, message int"), mentions, ["conv", "message"]).collect()
