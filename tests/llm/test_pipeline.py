"""Every stage on the stage before it, against brute force; and the guard around the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from logloom.llm.common import materialise, table

from .test_near_duplicates import brute_lines, least, linked, shingles

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf), name)
        kept[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == before.columns
    clean = {r.doc_id: r.text for r in kept["toxicity"]}
    assert 0.8 * 200 <= len(clean) <= 200
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == brute_lines(sorted(clean.items()), 5, 80)
    sets = {r.doc_id: shingles(r.text, 5) for r in kept["line_dedup"]}
    roots = least(sets, linked(sets, 80))
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i, root in roots.items() if i == root}
    texts = {r.doc_id: r.text for r in kept["near_duplicates"]}
    assert kept["mixing"] and all(texts[r.doc_id] == r.text for r in kept["mixing"])
    assert sorted(r.doc_id for r in kept["encoding"]) == sorted(r.doc_id for r in kept["mixing"])
    assert all(r.n_tokens == len(r.ids) for r in kept["encoding"])


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "logloom"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-r", tmp_path / "logloom" / "llm"], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, pipeline = said.stdout.split()
    assert int(n) > 40 and pipeline == "False"


def odd_documents(spark):
    rows = [(1, "one two three four five six seven\nand a line\n\nand a line"), (2, None), (3, ""), (4, " \n\t "), (None, "no id at all here"), (1, "one two three four five six seven\nand a line\n\nand a line"), (5, "word " * 20_000), (6, "a <|endoftext|> b c"), (7, "one two three four five six seven eight")]
    full = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if t is None else len(t), "clash", 0.5, 3) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, `rate` string, score double, line int")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(name, stage, spark, sf):
    docs = odd_documents(spark)
    out = stage(spark, docs, sf)
    rows = out.collect()
    texts = {r.text for r in docs.collect()}
    if name != "encoding":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if name in ("near_duplicates", "encoding"):
        assert {r.text for r in rows} <= texts
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "5", "6", "7", "None"]
    if name in ("line_dedup", "encoding"):
        assert len(rows) == 9
    if name == "toxicity":
        assert {str(r.doc_id) for r in rows} <= {"1", "2", "3", "4", "5", "6", "7", "None"}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(name, stage, spark, sf):
    assert stage(spark, odd_documents(spark).limit(0), sf).collect() == []
