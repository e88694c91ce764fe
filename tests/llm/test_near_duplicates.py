import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from logloom.llm import near_duplicates, setjoin


def shingles(text, k):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(sets, percent):
    """Pairs of keys whose sets link, by comparing all."""
    return [(a, b) for (a, x), (b, y) in combinations(sets.items(), 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]


def least(keys, pairs):
    root = {k: k for k in keys}
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


def copies(seed, n, edits):
    """A chain of near copies, exact copies and strangers."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rnd.randint(0, edits)):
            text[rnd.randrange(len(text))] = word()
        out.append(" ".join(text) if k % 5 else " ".join(word() for _ in range(rnd.randint(1, 80))))
        if k % 7 == 0:
            base = text
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK_UNITS", block)
    texts = copies(2, 70, 2) + copies(3, 30, 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = {i: shingles(t, 3) for i, t in enumerate(texts)}
    want = least(sets, linked(sets, 90))
    got = near_duplicates.ngram_components(docs, 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def brute_lines(rows, k, percent):
    lines = {(i, n): shingles(line, k) for i, t in rows for n, line in enumerate(t.split("\n"))}
    gone = {b for _, b in ((min(p), max(p)) for p in linked(lines, percent))}
    return {i: "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


@pytest.mark.parametrize("block", [4096, 5])
def test_lines_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK_UNITS", block)
    rnd, pool = random.Random(4), copies(5, 60, 2)
    rows = [(i, "\n".join(rnd.choice([*pool, "short line", "", " "]) for _ in range(rnd.randint(1, 6)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.dedup_lines(docs, 5, 80)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, 5, 80)


def test_group_filters_lose_nothing():
    rnd = np.random.default_rng(7)
    for percent in (50, 80, 90):
        join = setjoin.Join(3, percent)
        sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
        sets += [np.unique(np.append(s, rnd.integers(0, 60))) for s in sets[:40]]
        keyed = {k: frozenset(s.tolist()) for k, s in enumerate(sets)}
        pairs = linked(keyed, percent)
        want = least(keyed, pairs)
        assert setjoin.link_components(join, sets).tolist() == [want[k] for k in range(len(sets))]
        later = {max(p) for p in pairs}
        assert setjoin.link_earlier(join, sets).tolist() == [k in later for k in range(len(sets))]


def test_chain_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "src long, dst long")
    found = defaultdict(set)
    for r in setjoin.components(edges).collect():
        found[r.component].add(r.node)
    assert found == {0: set(range(41)), 100: {100, 101}}


def test_odd_rows(odd_docs, no_docs):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_duplicates.ngram_components(odd_docs).collect())
    by = {(i, c) for i, _, c in got}
    assert len(got) == 10 and ("None", None) in by
    assert {("1", 1), ("6", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5), ("8", 8)} <= by
    kept = near_duplicates.drop_near_duplicates(odd_docs, 3, 90).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "1", "2", "3", "4", "5", "7", "8", "None"])
    lines = near_duplicates.dedup_lines(odd_docs, 5, 80)
    assert lines.columns == odd_docs.columns
    text = {(r.doc_id, r.text, r.n_chars) for r in lines.where("doc_id in (1, 2, 3, 4, 6) or doc_id is null").collect()}
    assert text == {(1, "One two three four five six seven", 33), (2, None, 0), (3, "", 0), (4, " \n\t ", 4), (6, "", 0), (None, "no id at all here", 17)}
    assert near_duplicates.ngram_components(no_docs).count() == near_duplicates.dedup_lines(no_docs).count() == near_duplicates.drop_near_duplicates(no_docs).count() == 0


@given(st.lists(st.one_of(st.text(alphabet="aAbZ \t\n\r\x0b\x0cé", max_size=40), st.text(alphabet="ab ", min_size=60, max_size=400)), max_size=6))
def test_word_hashes(texts):
    units = [t.encode() for t in texts]
    hashed, size = setjoin.hash_words(units)
    words = [w for u in units for w in setjoin.words(u)]
    assert size.tolist() == [len(setjoin.words(u)) for u in units]
    assert len(hashed) == len(words) and len(set(zip(words, hashed.tolist(), strict=True))) == len(set(words)) == len(set(hashed.tolist()))


def test_survivors_are_rows_and_not_ids(spark, odd_docs):
    a, b, c = ("one two three four five six " + w for w in ("seven", "eight", "nine"))
    far, away = "nothing of that is in here at all", "nor does this text have a copy"
    rows = [(2, a), (5, a), (5, far), (5, far), (7, b), (7, b), (7, away), (8, None), (8, None), (8, ""), (9, b), (9, c), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (str(r[0]), str(r[1]))
    all_rows = near_duplicates.drop_near_duplicates(docs, 3, 90).collect()
    assert sorted(map(key, all_rows)) == sorted(map(key, [(2, a), (5, far), (5, far), (7, b), (7, b), (7, away), (8, None), (8, None), (8, ""), (9, c), (None, a), (None, a)]))
    single = near_duplicates.drop_near_duplicates(docs, 3, 90, keep_repeats=False).collect()
    assert sorted(map(key, single)) == sorted(map(key, [(2, a), (5, far), (7, b), (7, away), (8, None), (8, ""), (9, c), (None, a), (None, a)]))
    kept = near_duplicates.drop_near_duplicates(odd_docs, 3, 90, keep_repeats=False)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "None"])


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    rows = [(1, "a text that comes twice with one id", "en", "s", 35)] * 2 + [(2, "another text which comes only once", "en", "s", 34)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.line_dedup(spark, docs, ""), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
