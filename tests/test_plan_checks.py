"""Plan consistency (R07): literal plans."""

import pytest

from repolens.operators import plan_checks as PC

OPS = "project_id string, step_id long, seq long, type string, path string, new_path string, description string"


def issues(spark, ops, steps=None, files=None, project="p", fold=False):
    rows = [(project, s, i, t, path, new, d) for i, (s, t, path, new, d) in enumerate(ops)]
    steps = steps or [(s, "cleanup") for s in sorted({o[0] for o in ops})]
    st = spark.createDataFrame([(project, s, r) for s, r in steps], "project_id string, step_id long, rule string")
    fl = None if files is None else spark.createDataFrame([(project, f) for f in files], "project_id string, path string")
    out = PC.plan_issues(st, spark.createDataFrame(rows, OPS), fl, fold)
    assert out.columns == PC.COLS
    return sorted((r.kind, r.severity, r.step_id, r.path, r.other_step, r.n) for r in out.collect())


def test_a_sound_plan_has_no_issue(spark):
    ops = [(1, "CREATE", "src/a/new.ts", None, "new"), (1, "MODIFY", "src/a/hub.ts", None, "Extract parts"), (2, "MODIFY", "src/a/new.ts", None, "fill")]
    assert issues(spark, ops, [(1, "hub-splitter"), (2, "cleanup")], ["src/a/hub.ts"]) == []


def test_order(spark):
    ops = [(1, "MODIFY", "a.ts", None, "x"), (2, "CREATE", "a.ts", None, "x"), (3, "MODIFY", "a.ts", None, "x"), (4, "CREATE", "b.ts", None, ""), (4, "DELETE", "b.ts", None, "")]
    assert issues(spark, ops) == [("create_and_delete", "ERROR", 4, "b.ts", None, None), ("created_later", "ERROR", 1, "a.ts", 2, None), ("no_consumer_update", "INFO", 4, "b.ts", None, None)]


@pytest.mark.parametrize("other, lost", [
    ((1, "MODIFY", "src/user.ts", None, "Update IMPORT path"), False),      # same step, speaks of imports
    ((2, "MODIFY", "src/user.ts", None, "Update import path"), True),       # another step, does not name the file
    ((2, "MODIFY", "src/user.ts", None, "now uses old-name.ts here"), False),  # names the file, any step
    ((1, "MODIFY", "src/old-name.ts", None, "import"), True),               # the moved file itself
    ((2, "MODIFY", "src/user.ts", None, "now uses Old-name.ts"), True),     # case counts
    ((2, "CREATE", "src/user.ts", None, "old-name.ts"), True),
])
def test_orphans(spark, other, lost):
    found = issues(spark, [(1, "MOVE", "src/old-name.ts", "lib/old-name.ts", "Move"), other])
    assert found == ([("no_consumer_update", "WARNING", 1, "src/old-name.ts", None, None)] if lost else [])


def test_a_path_counts_by_its_last_move(spark):
    ops = [(1, "MOVE", "a.ts", "b/a.ts", ""), (3, "DELETE", "a.ts", None, ""), (1, "MODIFY", "c.ts", None, "imports")]
    assert issues(spark, ops) == [("no_consumer_update", "INFO", 3, "a.ts", None, None)]


def test_mentions_are_substrings(spark):
    names = ["a", "ab.ts", "a-very-long-file-name.ts", "a-very-long-other.ts", "é.ts", ""]
    texts = ["xab.tsx", "the a-very-long-file-name.ts!", "plain", "", "ünd é.ts", "a-very-long-"]
    df = spark.createDataFrame([("p", n) for n in names], "project_id string, name string")
    tf = spark.createDataFrame([("p", t) for t in texts] + [("q", "a-very-long-other.ts")], "project_id string, text string")
    assert {r.name for r in PC.mentioned(df, tf).collect()} == {n for n in names if any(n in t for t in texts)}
    assert PC.mentioned(df.limit(0), tf).count() == 0


def test_splits(spark):
    ops = [(1, "CREATE", "src/a/x.ts", None, ""), (1, "CREATE", "src/a/y.ts", None, ""),
           (2, "CREATE", "src/a/z.ts", None, ""), (2, "MODIFY", "lib/user.ts", None, "Update path"),
           (3, "CREATE", "src/a/v.ts", None, ""), (3, "MODIFY", "lib/user.ts", None, "REFACTOR it"),
           (4, "CREATE", "src/a/w.ts", None, ""), (4, "MODIFY", "src/a/hub.ts", None, "x"),
           (5, "CREATE", "src/b/w.ts", None, "")]
    steps = [(k, "hub-splitter") for k in (1, 2, 3, 4)] + [(5, "cleanup")]
    assert issues(spark, ops, steps) == [("hub_not_changed", "WARNING", 1, None, None, 2), ("hub_not_changed", "WARNING", 2, None, None, 1),
                                         ("no_consumer_change", "ERROR", 1, None, None, 2)]


def test_collisions_scope_and_empty_steps(spark):
    ops = [(1, "CREATE", "a.ts", None, ""), (2, "CREATE", "a.ts", None, ""), (3, "MOVE", "x.ts", "t.ts", ""), (4, "MOVE", "y.ts", "t.ts", ""), (5, "CREATE", "t.ts", None, ""),
           (6, "MODIFY", "gone.ts", None, "import"), (3, "MODIFY", "k.ts", None, "import"), (4, "MODIFY", "k.ts", None, "import")]
    steps = [(k, "cleanup") for k in range(1, 8)]
    assert issues(spark, ops, steps, ["x.ts", "k.ts"]) == [
        ("created_and_moved_to", "ERROR", 5, "t.ts", 3, 2), ("created_twice", "ERROR", 1, "a.ts", None, 2), ("moved_to_twice", "ERROR", 3, "t.ts", None, 2),
        ("no_operation", "WARNING", 7, None, None, None), ("unknown_path", "WARNING", 4, "y.ts", None, None), ("unknown_path", "WARNING", 6, "gone.ts", None, None)]


def test_folded_paths(spark):
    df = spark.createDataFrame([("p", k, k, "CREATE", p, None, "") for k, p in enumerate(["src/./A.ts", "SRC//a.ts", "src\\a.ts", "./src/a.ts/", "src/.a.ts"])], OPS)
    assert [(r.path, r.n) for r in PC.collision_issues(df, fold=True).collect()] == [("src/a.ts", 4)]
    assert PC.collision_issues(df).count() == 0


def test_verdicts(spark):
    st = spark.createDataFrame([("p", 1, "x"), ("q", 1, "x")], "project_id string, step_id long, rule string")
    found = PC.plan_issues(st, spark.createDataFrame([("p", 1, 0, "CREATE", "a", None, ""), ("p", 1, 1, "CREATE", "a", None, "")], OPS))
    out = {r.project_id: (r.errors, r.warnings, r.infos, r.valid) for r in PC.plan_verdicts(st, found).collect()}
    assert out == {"p": (1, 0, 0, False), "q": (0, 1, 0, True)}
