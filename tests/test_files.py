"""File references: spans, classification, sums."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.operators import files

PIECES = ["src/a.py", "`", "```\n", "\n", " ", "[x](", ")", "'", '"', "C:\\w\\b.md", "\\\\s\\t\\c.txt", "日本", "data.csv", "docs/sub/", ":12", ":3", ".", "-", "# Files mentioned by the user:\n", "## n: C:/w/a b.py\n", "## My request for it:\n", "http://e.org/x.py", "/", "x", "](", "<", ">"]


def plain_spans(text):
    """The same spans by one mark a character and one search from every place."""
    def blank(taken):
        return "".join(" " if k in taken else c for k, c in enumerate(left))
    free = r"(?<![A-Za-z0-9_./\\-])"
    any_ = "|".join(sorted((e for e in files.EXTENSIONS if e != "log"), key=len, reverse=True))
    rules = [
        [("attachment", r"(?ms)^# Files mentioned by the user:\s*\n(.*?)(?=^## My request for |\Z)")], [(None, r"(?ms)^[ \t]*(```)[^\r\n]*\r?\n.*?(?:^[ \t]*```[ \t]*$|\Z)")],
        [("link", r"\[[^\]\r\n]+\]\(([^)\r\n]+)\)"), ("inline_code", r"(?<!`)`([^`\r\n]+)`(?!`)"), ("quoted", r"\"((?:[A-Za-z]:\\|\\\\)[^\r\n]+?)\"|'((?:[A-Za-z]:\\|\\\\)[^\r\n]+?)'")],
        [
            ("unc", r"(?<!\w)(\\\\[^\s\"<>|?*`]+)"), ("drive", r"(?<!\w)([A-Za-z]:\\[^\s\"<>|?*`]+)"), ("relative_file", free + r"((?:[^\s/\\:]+[\\/])+[^\s/\\:]+\.[A-Za-z0-9]{1,12}(?::\d+(?::\d+)?)?)"),
            ("relative_directory", free + r"((?:[A-Za-z0-9_.-]+[\\/])+)(?=$|[\s、。）」』】をはにでとが])"), ("bare_file", r"(?i)" + free + rf"([\w.-]+\.(?:{any_})(?::\d+(?::\d+)?)?)"),
        ],
    ]
    found, left = [], text
    for layer in rules:
        taken = set()
        for origin, pattern in layer:
            at, regex = 0, re.compile(pattern)
            while at <= len(left):
                m = regex.match(left, at)
                if m is None:
                    at += 1
                    continue
                taken |= set(range(*m.span()))
                group = m.lastindex
                if origin == "attachment":
                    place = m.start(1)
                    for line in m[1].splitlines(keepends=True):
                        one = re.match(r"##\s+[^:\r\n]+:\s*([^\r\n]+?)\s*$", line)
                        if one:
                            found.append((one[1], origin, place + one.start(1)))
                        place += len(line)
                elif origin:
                    found.append((m[group], origin, m.start(group)))
                at = max(m.end(), at + 1)
        left = blank(taken)
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_spans_equal_a_search_from_every_place(text):
    assert files.find_spans(text) == plain_spans(text)


def test_long_texts_are_read_once():
    begin = time.monotonic()
    for unit in ("あ", "[", "`", "a.b", "'", "(", " "):
        assert files.find_spans(unit * 200_000) == []
    assert files.find_spans("a/" * 200_000 + " ")[0][1:] == ("relative_directory", 0)
    assert time.monotonic() - begin < 30  # looked at from each character they take hours


def test_places_are_kept():
    text = "# Files mentioned by the user:\n\n## a: C:/w/a b.py\n## z: /y/z.md\n\n## My request for it:\nsee [k](<src/a.py>) and x.json"
    assert [(v, o, text[s : s + len(v)] == v) for v, o, s in files.find_spans(text)] == [("C:/w/a b.py", "attachment", True), ("/y/z.md", "attachment", True), ("<src/a.py>", "link", True), ("x.json", "bare_file", True)]


def test_cleaned_located_classified(spark):
    values = {
        "<src/a.py>": ("src/a.py", None, None), "src/a.py.": ("src/a.py", None, None), "日本/x.pyを確認してください": ("日本/x.py", None, None), "a.md:3:4です": ("a.md", 3, 4), "C:5": ("C:5", None, None), "C:5:6": ("C:5:6", None, None), "x:1:2:3": ("x:1", 2, 3), "「": ("「", None, None),
        "\u3000b.py、": ("b.py", None, None), "": ("", None, None),
    }
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("at", files.split_location(files.cleaned(F.col("v"))))
    assert {r.v: (r.at.path, r.at.line, r.at["column"]) for r in df.collect()} == values
    paths = {
        "src/./x/../A.py": ("workspace", "src/A.py", "A.py", "py"), "../../etc/p.txt": ("external", None, "p.txt", "txt"), "../Work/b.md": ("workspace", "b.md", "b.md", "md"), "C:\\WORK\\x": ("workspace", "x", "x", ""), "C:/work": None, "C:/work/": None, ".": None,
        "C:/workshop/x.c": ("external", None, "x.c", "c"), "\\\\srv\\share\\d.TXT": ("external", None, "d.TXT", "txt"), "/etc/.profile": ("external", None, ".profile", ""), "https://e.org/a.py": None, "#top": None, "": None, "a/b.tar.gz/": ("workspace", "a/b.tar.gz", "b.tar.gz", "gz"),
        "../../../../../q.py": ("external", None, "q.py", "py"),
    }
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "p string").withColumn("f", files.classify(F.col("p"), F.lit("C:/work")))
    got = {r.p: r.f and (r.f.scope, r.f.path, r.f.name, r.f.extension) for r in df.collect()}
    assert got == paths | {None: None}


def test_references_and_externals(spark):
    rows = [(1, "Open Docs/a.md and `docs/a.md:3`, docs/A.md. Foo.Bar `plain.word` /x/s.txt /x/s.txt /z/s.txt"), (2, "docs/a.md src/new.py"), (3, None), (4, "")]
    messages = spark.createDataFrame(rows, "id long, body string").withColumn("path", F.lit("clash"))
    tree = spark.createDataFrame([("docs/a.md", "missing"), ("DOCS/a.md", "file")], "path string, kind string")
    found = files.file_mentions(messages, "body", "id", "/w", tree).cache()
    refs = {r.path: (r.kind, r.mentions, r.messages, r.extension) for r in files.file_references(found, "id").collect()}
    # code comes before plain text; of message 1 the two plain ones count once
    assert refs == {"docs/a.md": ("file", 3, 2, "md"), "src/new.py": ("missing", 1, 1, "py")}
    out = sorted((r.id, r.ordinal, r.name) for r in files.external_files(found, "id").collect())
    assert out == []  # a plain absolute path without a drive is none; in code or a link it is
    linked = files.file_mentions(spark.createDataFrame([(1, "[s](/x/s.txt) `/x/s.txt` [t](/z/s.txt)")], "id long, body string"), "body", "id", "/w")
    assert sorted((r.id, r.ordinal, r.name) for r in files.external_files(linked, "id").collect()) == [(1, 1, "s.txt"), (1, 2, "s.txt")]
    assert files.file_references(found.limit(0), "id").count() == 0
    ids = files.reference_ids(found, files.file_references(found, "id"))
    assert ids.count() == 5 and ids.select("reference_id").distinct().count() == 2


def test_no_task_has_all_mentions(spark, tmp_path, monkeypatch):
    from logloom.plans import files as plans

    rows = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))  # one split
    monkeypatch.setattr(plans, "TEXTS_A_TASK", 200, raising=False)
    monkeypatch.setattr(plans, "SORTED_A_TASK", 500, raising=False)
    found = plans.mentions(spark, str(tmp_path)).where("scope = 'external'").groupBy(F.spark_partition_id()).count().collect()
    out = plans.external_files(spark, str(tmp_path))
    sorted_ = out.groupBy(F.spark_partition_id()).count().collect()
    for counts, most in ((found, 400), (sorted_, 800)):
        assert sum(r["count"] for r in counts) == 2000 and max(r["count"] for r in counts) <= most
    assert "partial_min" not in out._jdf.queryExecution().executedPlan().toString()  # which sorts a split before its shuffle


def test_external_files_of_repeated_idents(spark):
    rows = [(1, p, "external", n, n[-1:], w) for p, n, w in ((3, "B.c", "x"), (1, "b.C", "x"), (2, "z", "y"), (1, "a.C", "x"))] + [(1, 0, "workspace", "n", "", "q")]
    found = spark.createDataFrame(rows, "id int, place int, scope string, name string, extension string, whole_sha256 string")
    for parts in (None, 3):
        got = sorted((r.ordinal, r.name, r.extension) for r in files.external_files(found, "id", parts=parts).collect())
        assert got == [(1, "a.C", "C"), (2, "z", "z")]
