"""Changes merged by path against dictionaries."""

import random

from logloom.operators import changes

NUMSTAT = "g string, path string, added int, deleted int, binary boolean, state string"


def last(rows, order=lambda r: r[1:]):
    """{(group, folded path): row}, the greatest row of each; rows begin with group and path."""
    best = {}
    for row in rows:
        if row[1] is not None:
            key = row[0], row[1].lower()
            best[key] = max(best.get(key, row), row, key=order)
    return best


def plain(status, staged, unstaged, names, committed):
    tree, log = last(status), last(names)
    counts = [last(c, lambda r: (r[1], not r[4], r[2], r[3])) for c in (staged, unstaged, committed)]
    out = set()
    for key in tree.keys() | log.keys():
        index, worktree = tree[key][3:5] if key in tree else ("none", "none")
        scopes = (["staged"] if index not in ("none", "untracked") else []) + (["worktree"] if worktree != "none" or index == "untracked" else [])

        def entry(found, here, scope, known=True, index=index, worktree=worktree):
            if known and found:
                return "binary" if found[4] else "measured", found[2], found[3]
            state = "not_applicable" if scope not in here else "not_inspected" if known and "untracked" in (index, worktree) and scope != "committed_in_session" else "failed"
            return state, None, None

        logged = ["committed_in_session"] if key in log else []
        row = (tree if key in tree else log)[key]
        out.add((key[0], row[1], index, worktree, log[key][3] if key in log else "none", tuple(logged + scopes), entry(counts[0].get(key), scopes, "staged", key in tree), entry(counts[1].get(key), scopes, "worktree", key in tree), entry(counts[2].get(key), logged, "committed_in_session")))
    return out


def test_merged_changes_equal_dictionaries(spark):
    rng = random.Random(3)
    path = lambda: rng.choice(["a/X", "A/x", "a/x", "b", "B", "ä", "c d", "", "e"])
    group = lambda: rng.choice(["g", "h", None])
    states = ("none", "modified", "untracked", "deleted")
    tables = {
        "status": [(group(), path(), "", rng.choice(states), rng.choice(states)) for _ in range(14)], "names": [(group(), path(), "", rng.choice(("added", "renamed"))) for _ in range(10)],
        **{k: [(group(), path(), rng.randrange(9), rng.randrange(9), rng.random() < 0.4, "clash") for _ in range(12)] for k in ("staged", "unstaged", "committed")},
    }
    types = {"status": "g string, path string, old_path string, index string, worktree string", "names": "g string, path string, old_path string, status string"}
    for empty in ((), ("status",), ("names",), ("staged", "unstaged", "committed"), tuple(tables)):
        given = {k: [] if k in empty else v for k, v in tables.items()}
        dfs = {k: spark.createDataFrame(v + [(None,) * len(v[0])] if v else [], types.get(k, NUMSTAT)) for k, v in given.items()}
        got = changes.merged_changes(*(dfs[k] for k in ("status", "staged", "unstaged", "names", "committed")), ["g"]).collect()
        rows = [(r.g, r.path, r["index"], r.worktree, r.committed, tuple(r.scopes), tuple(r.staged), tuple(r.unstaged), tuple(r.committed_in_session)) for r in got]
        assert len(rows) == len(set(rows)) and set(rows) == plain(**given), empty
        for r in got:
            kinds = {r.staged.state, r.unstaged.state, r.committed_in_session.state}
            assert r.binary == (True if "binary" in kinds else False if "measured" in kinds else None)


def test_merged_changes_shuffle_once(spark):
    one = spark.createDataFrame([("g", "a", "", "modified", "none")], "g string, path string, old_path string, index string, worktree string")
    names = one.selectExpr("g", "path", "old_path", "'added' as status")
    counts = one.selectExpr("g", "path", "1 as added", "1 as deleted", "false as binary")
    plan = changes.merged_changes(one, counts, counts, names, counts, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and "Join" not in plan
