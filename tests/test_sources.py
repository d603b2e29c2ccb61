"""Sources, sinks and the smaller graph joins."""

import os

from pyspark.sql import functions as F

from repolens.operators import graph, references
from repolens.sources import files as S01
from repolens.sources import gitlog, store


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_read_files_ignores_and_extensions(spark, scratch):
    _write(scratch, "proj1/src/a.ts", "import x from './b';\n")
    _write(scratch, "proj1/src/b.ts", "export const b = 1;")
    _write(scratch, "proj1/node_modules/lib/index.js", "x")
    _write(scratch, "proj1/dist/out.js", "x")
    _write(scratch, "proj1/README.md", "# readme")
    _write(scratch, "proj2/app/main.py", "import os\n")
    df = S01.read_files(spark, scratch)
    got = sorted((r.project_id, r.path, r.bytes) for r in df.collect())
    assert got == [("proj1", "src/a.ts", 21), ("proj1", "src/b.ts", 19), ("proj2", "app/main.py", 10)]


def test_ignore_pattern_expansion():
    assert S01.normalize_ignore(["vendor"]) == ["vendor", "vendor/**", "**/vendor", "**/vendor/**"]
    import re
    rx = re.compile(S01.glob_to_regex("**/node_modules/**"))
    assert rx.match("node_modules/x.js") and rx.match("a/node_modules/b/c.js") and not rx.match("a/b.js")


def test_commit_log_parser_literal(spark):
    dump = ("abcdef1|Ann|2024-03-04T10:00:00+00:00|fix: a | b\n\n3\t1\tsrc/a.ts\n-\t-\tbin.png\n"
            "2\t0\tsrc/{old => new}.ts\n\nbeef0042|Bo|2024-03-05T11:00:00+00:00|feat\n\n5\t5\tsrc/b.ts\n")
    t = spark.createDataFrame([("p", dump)], "project_id string, value string")
    rows = sorted((r.commit_id, r.author, r.path, r.additions, r.deletions)
                  for r in gitlog.parse_commit_log(t).collect())
    assert rows == [("abcdef1", "Ann", "src/a.ts", 3, 1), ("beef0042", "Bo", "src/b.ts", 5, 5)]


def test_write_snapshot_round_trip(spark, scratch):
    analysis = spark.createDataFrame([("p1", 80.0), ("p2", 60.0)], "project_id string, overall double")
    ap = spark.createDataFrame([("p1", "God Class", "CRITICAL", "a.ts")],
                               "project_id string, name string, severity string, location string")
    edges = spark.createDataFrame([("p1", "a.ts", "b.ts"), ("p2", "c.ts", "d.ts")],
                                  "project_id string, src string, dst string")
    bid = store.write_snapshot(analysis, ap, edges, scratch, batch_id="b1")
    heads = store.read_store(spark, scratch, "analyses")
    assert heads.count() == 2 and bid == "b1"
    kids = store.complete_children(spark, scratch, "anti_patterns")
    assert [r.analysis_id for r in kids.collect()] == ["b1:p1"]


def test_rules_table_and_latest_decisions(spark):
    r = store.rules_df(spark, {"quality_gates": {"min_overall_score": 70},
                               "boundaries": {"allow_circular_dependencies": False,
                                              "banned_imports": ["lodash", {"from": "ui/", "to": "db/"}]}})
    assert sorted(x.rule for x in r.collect()) == ["banned_import", "banned_import", "min_overall_score",
                                                    "no_circular"]
    import datetime as dt
    d = spark.createDataFrame([("p", "adr-1", "t", "proposed", dt.datetime(2024, 1, 1), 1),
                               ("p", "adr-1", "t", "accepted", dt.datetime(2024, 1, 2), 2)],
                              "project_id string, decision_id string, title string, status string, "
                              "updated_at timestamp, record_id long")
    assert store.latest_decisions(d).first().status == "accepted"


def test_aliases_file_dependencies_affected_scope(spark):
    refs = spark.createDataFrame([("p", "src/a.ts", "@/x/y"), ("p", "src/a.ts", "react")],
                                 "project_id string, src string, raw string")
    al = spark.createDataFrame([("p", 1, "@/", "src/"), ("p", 0, "@/x/", "lib/x/")],
                               "project_id string, pos int, prefix string, target string")
    got = sorted(r.raw for r in references.apply_aliases(refs, al).collect())
    assert got == ["lib/x/y", "react"]
    e = graph.build_edges(spark.createDataFrame([("p", "a", "b"), ("p", "c", "b"), ("p", "b", "d")],
                                                "project_id string, src string, dst string"))
    chosen = spark.createDataFrame([("p", "b")], "project_id string, path string")
    deps = sorted((r.direction, r.other) for r in graph.file_dependencies(e, chosen).collect())
    assert deps == [("imported_by", "a"), ("imported_by", "c"), ("imports", "d")]
    scope = sorted((r.path, r.reason) for r in graph.affected_scope(
        spark.createDataFrame([("p", "b"), ("p", "a")], "project_id string, path string"), e).collect())
    assert scope == [("a", "changed"), ("b", "changed"), ("c", "importer")]


def test_export_history_in_blocks(spark):
    import datetime as dt
    import json
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    projects = spark.createDataFrame([("p", "P", day(0)), ("q", None, day(1))], "project_id string, name string, created_at timestamp")
    analyses = spark.createDataFrame([("p", f"a{k}", day(k), 50.0 + k, 1.0, 2.0, 3.0, 4.0) for k in range(25)]
                                     + [("gone", "x", day(0), 1.0, 1.0, 1.0, 1.0, 1.0)],
                                     "project_id string, analysis_id string, ts timestamp, overall double, modularity double, "
                                     "coupling double, cohesion double, layering double")
    trends = spark.createDataFrame([("p", "God Class", "HIGH", 3, "s", "t"), ("p", "Hub", "LOW", 9, "s", "t")],
                                   "project_id string, name string, severity string, occurrences bigint, first_seen string, last_seen string")
    rows = store.export_history(projects, analyses, trends, block=10).collect()
    doc = {}
    for r in sorted(rows, key=lambda r: r.block):
        assert len(json.loads(r.doc)) == r.items <= 10
        doc.setdefault((r.project_id, r.section), []).extend(json.loads(r.doc))
    assert doc["p", "project"] == [{"project_id": "p", "name": "P", "created_at": "2024-01-01 00:00:00"}]
    assert doc["q", "project"][0]["name"] is None
    assert [x["analysis_id"] for x in doc["p", "analyses"]] == [f"a{k}" for k in reversed(range(25))]
    assert [x["overall"] for x in doc["p", "score_history"]] == [50.0 + k for k in range(25)]
    assert [x["name"] for x in doc["p", "anti_pattern_trends"]] == ["Hub", "God Class"]
    assert set(doc) == {("p", "project"), ("q", "project"), ("p", "analyses"), ("p", "score_history"), ("p", "anti_pattern_trends")}


def test_commit_log_round_trip_splits_a_project(spark, scratch):
    """Months are folders, large months several files, and a file is read by
    several tasks; a plain dump without separators gives the same rows."""
    import glob
    import os
    from pyspark.sql import functions as F
    changes = spark.range(3000).select(
        F.lit("p").alias("project_id"), F.col("id").cast("string").alias("commit_id"), F.lit("Ann | B").alias("author"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, cast(id % 3 as int))").alias("ts"),
        F.concat(F.lit("src/f"), F.col("id") % 7, F.lit(".ts")).alias("path"), F.col("id").alias("additions"), F.lit(1).cast("bigint").alias("deletions"))
    changes = changes.withColumn("author", F.lit("Ann"))
    folder = os.path.join(scratch, "log")
    gitlog.write_commit_log(changes, folder, commits_per_file=400)
    assert len(glob.glob(folder + "/project_id=p/month=*")) == 3
    assert len(glob.glob(folder + "/project_id=p/month=*/*.txt")) >= 9
    want = sorted(tuple(r) for r in changes.select(F.sha1("commit_id"), "ts", "path", "additions").collect())
    got = gitlog.read_commit_log(spark, folder, gitlog.SEPARATOR).select("commit_id", "ts", "path", "additions")
    assert sorted(tuple(r) for r in got.collect()) == want
    plain = os.path.join(scratch, "plain")
    gitlog.write_commit_log(changes, plain, separator="\n")
    got = gitlog.read_commit_log(spark, plain).select("commit_id", "ts", "path", "additions")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_manifest_line_formats(spark):
    from repolens.sources.manifests import read_manifests
    files = spark.createDataFrame([
        ("p", "requirements.txt", "flask==2.0.1\nrequests>=2.0\n# comment\nnumpy\n"),
        ("p", "svc/go.mod", "module x\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n)\n"),
        ("p", "web/package.json", '{"dependencies": {"react": "^18.0.0"}, "devDependencies": {"jest": "29"}}'),
        ("p", "bad/package.json", "{not json")], "project_id string, path string, content string")
    got = sorted((r.dep_name, r.dep_version, r.is_dev) for r in read_manifests(files).collect())
    assert got == [("flask", "==2.0.1", False), ("github.com/gin-gonic/gin", "v1.9.0", False),
                   ("jest", "29", True), ("numpy", None, False), ("react", "^18.0.0", False),
                   ("requests", ">=2.0", False)]
