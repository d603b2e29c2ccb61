"""Texts are searched once, references meet one row per name."""

from repolens.operators import references
from repolens.plans import structure

SF_SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_searched_once(spark):
    assert "regexp_extract_all" not in _plan(structure.q_resolve(spark, SF_SMALL))


def test_references_are_not_grouped_again(spark):
    files = spark.createDataFrame([("p", "a/b.ts"), ("p", "a/b.ts"), ("p", "a/b.tsx"), ("p", "a/b/index.ts"), (None, "a/c.ts"), ("p", None)], "project_id string, path string")
    refs = spark.createDataFrame([("p", "a/x.ts", "./b"), ("p", "a/x.ts", "./b"), ("p", "a/x.ts", "./b/index"), (None, "a/x.ts", "./c"), ("p", None, "./a/b"), ("p", "a/x.ts", "fs"), ("p", "a/x.ts", None)],
                                 "project_id string, src string, raw string")
    out = references.resolve_references(refs, files)
    assert _plan(out).count("Join") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("p", "a/x.ts", "./b", "a/b.ts"), ("p", "a/x.ts", "./b/index", "a/b/index.ts"), (None, "a/x.ts", "./c", "a/c"),
        ("p", None, "./a/b", "a/b"), ("p", "a/x.ts", "fs", "fs")], key=str)


def test_keywords_keep_what_stands_before_them(spark):
    text = "xexport { a } from './no';\n.require('./no')\n$import './no'\nexport { a } from './e';\n;require('./r')\nimport './i'"
    files = spark.createDataFrame([("p", "a.ts", text), ("p", None, text), ("p", "b.ts", None)], "project_id string, path string, content string")
    assert sorted(r.raw for r in references.extract_references(files).collect()) == ["./e", "./i", "./r"]
