"""Unit cases on small literal tables (meaning taken from the reference's
own test cases: scorer ladders, cycle shapes, regression special cases)."""

import itertools

import pytest
from pyspark.sql import functions as F

from repolens.operators import cycles, detect, forecast, graph, history, refactor, references, score


def edges_df(spark, rows, project="p"):
    return graph.build_edges(spark.createDataFrame([(project, a, b) for a, b in rows], "project_id string, src string, dst string"))


def files_df(spark, paths, project="p"):
    return spark.createDataFrame([(project, p) for p in paths], "project_id string, path string")


def test_modularity_ladder(spark):
    # 10 files, 15 edges -> 1.5 edges per file < 2 -> 100
    paths = [f"src/f{i}.ts" for i in range(10)]
    e = edges_df(spark, [(paths[i % 10], paths[(i * 3 + 1) % 10]) for i in range(15)])
    m = score.modularity(e, files_df(spark, paths)).first()
    avg = e.count() / 10
    expect = 100 if avg < 2 else 85 if avg < 4 else 70 if avg < 6 else 50 if avg < 9 else 30
    assert m["modularity"] == expect


def test_empty_graph_scores(spark):
    e = edges_df(spark, [])
    f = files_df(spark, ["a.ts"])
    s = score.score(e, f, detect.shotgun_surgery(e)).first()
    assert (s["modularity"], s["coupling"], s["cohesion"], s["layering"]) == (100, 50, 50, 100)
    assert s["overall"] == int(100 * 0.4 + 50 * 0.25 + 50 * 0.2 + 100 * 0.15 + 0.5)


def test_cohesion_same_top_dir(spark):
    e = edges_df(spark, [("core/a.ts", "core/b.ts"), ("core/b.ts", "core/c.ts"), ("x.ts", "y.ts")])
    c = score.cohesion(e, files_df(spark, ["core/a.ts", "core/b.ts", "core/c.ts", "x.ts", "y.ts"])).first()
    assert c["cohesion"] == 100


def test_isolated_file_never_lowers_modularity(spark):
    paths = [f"m/f{i}.ts" for i in range(6)]
    e = edges_df(spark, [(paths[i], paths[(i + 1) % 6]) for i in range(6)] * 2)
    base = score.modularity(e, files_df(spark, paths)).first()["modularity"]
    more = score.modularity(e, files_df(spark, paths + ["m/isolated.ts"])).first()["modularity"]
    assert more >= base


def test_scc_three_node_cycle_and_self_loop(spark):
    e = edges_df(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("d", "f")])
    m = cycles.scc_members(e).collect()
    got = sorted((r["scc_id"], r["path"]) for r in m)
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("e", "e")]


def _brute_scc(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    out = set()
    for a in nodes:
        comp = {b for b in nodes if b in reach[a] and a in reach[b]}
        if len(comp) > 1 or (a, a) in edges:
            out.add((min(comp), a))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scc_matches_brute_force(spark, seed):
    import random
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(25)]
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(40)})
    got = sorted((r["scc_id"], r["path"]) for r in cycles.scc_members(edges_df(spark, edges)).collect())
    assert got == _brute_scc(edges)


def test_scc_independent_of_partitioning(spark):
    edges = [(f"a{i}", f"a{(i + 1) % 7}") for i in range(7)] + [("b1", "b2"), ("b2", "b1")]
    e1 = edges_df(spark, edges)
    e2 = e1.repartition(5)
    r1 = sorted(tuple(r) for r in cycles.scc_members(e1).collect())
    r2 = sorted(tuple(r) for r in cycles.scc_members(e2).collect())
    assert r1 == r2


def test_shotgun_threshold_and_exemptions(spark):
    src = "src/hub.ts"
    e = edges_df(spark, [(src, f"src/t{i}.ts") for i in range(5)]
                 + [("tests/x.ts", f"src/t{i}.ts") for i in range(6)]
                 + [("src/index.ts", f"src/t{i}.ts") for i in range(6)])
    rows = detect.shotgun_surgery(e).collect()
    assert [r["location"] for r in rows] == [src]


def test_reference_forms(spark):
    ts = """import a from './a';
import { b } from './b';
import * as n from './n';
import d, { e } from './d';
import f, * as g from "./f";
import type { T } from './t';
import type U from './u';
import {
  h,
} from './h';
import './side';
export * from './all';
export * as ns from './ns';
export { x, y as z } from './x';
export type { V } from './v';
const r = require('./r'), p = import('./p');
export const q = 1; // we import things
foo.require('./no');
"""
    go = """package main
import "fmt"
import str "strings"
import (
\t"os" // (system)
\tjs "encoding/json"
\t_ "github.com/x/y"
)
var s = "not/this"
"""
    rust = """use std::fs;
pub use crate::a::b as c;
pub(crate) use super::d::{e, f};
mod m { use self::g::*; }
// use the::comment;
fn f() { reuse::x(); }
"""
    files = spark.createDataFrame([("p", "a.ts", ts), ("p", "a.go", go), ("p", "a.rs", rust)], "project_id string, path string, content string")
    got = sorted((r["src"], r["raw"], r["kind"]) for r in references.extract_references(files).collect())
    made = {"import": "./a ./b ./n ./d ./f ./t ./u ./h ./side", "export": "./all ./ns ./x ./v", "require": "./r", "dynamic": "./p"}
    want = [("a.ts", raw, kind) for kind, raws in made.items() for raw in raws.split()]
    want += [("a.go", raw, "import") for raw in ("fmt", "strings", "os", "encoding/json", "github.com/x/y")]
    want += [("a.rs", raw, "use") for raw in ("std::fs", "crate::a::b", "super::d", "self::g")]
    assert got == sorted(want)


def test_resolve_references(spark):
    files = spark.createDataFrame([
        ("p", "src/a.ts", "import { b } from './b';\nimport x from '../lib';\nimport fs from 'fs';"),
        ("p", "src/b.tsx", ""), ("p", "lib/index.js", ""), ("p", "src/c.ts", "import('./missing')")],
        "project_id string, path string, content string")
    r = references.resolve_references(references.extract_references(files), files)
    got = sorted((x["src"], x["raw"], x["dst"]) for x in r.collect())
    assert got == [("src/a.ts", "../lib", "lib/index.js"), ("src/a.ts", "./b", "src/b.tsx"),
                   ("src/a.ts", "fs", "fs"), ("src/c.ts", "./missing", "src/missing")]


def test_internal_edges_drop_builtins(spark):
    e = edges_df(spark, [("src/a.ts", "fs"), ("src/a.ts", "node:path"), ("src/a.ts", "src/b.ts")])
    assert [r["dst"] for r in references.internal_edges(e).collect()] == ["src/b.ts"]


def test_wls_special_cases(spark):
    s = spark.createDataFrame([("one", 0.0, 50.0, None), ("flat", 1.0, 60.0, None), ("flat", 1.0, 70.0, None),
                               ("line", 0.0, 10.0, 1.0), ("line", 1.0, 12.0, 1.0), ("line", 2.0, 14.0, 1.0)],
                              "key string, x double, y double, w double")
    r = {x["key"]: x for x in forecast.wls(s).collect()}
    assert (r["one"]["slope"], r["one"]["intercept"], r["one"]["r2"], r["one"]["slope_se"]) == (0.0, 50.0, 1.0, None)
    assert (r["flat"]["slope"], r["flat"]["intercept"], r["flat"]["r2"]) == (0.0, 65.0, 0.0)
    assert (r["line"]["slope"], r["line"]["intercept"], r["line"]["r2"]) == (2.0, 10.0, 1.0)
    assert r["line"]["significant"] is True


def test_decay_forecast_needs_three_points(spark):
    s = spark.createDataFrame([("a", 0.0, 80.0, None), ("a", 1.0, 70.0, None),
                               ("b", 0.0, 80.0, None), ("b", 1.0, 70.0, None), ("b", 2.0, 60.0, None)],
                              "key string, x double, y double, w double")
    r = forecast.decay_forecast(s).collect()
    assert [x["key"] for x in r] == ["b"]
    assert r[0]["weeks_to_threshold"] == 2 and r[0]["current"] == 60.0


CHANGES = "project_id string, commit_id string, author string, ts timestamp, path string, additions long, deletions long"


def test_change_coupling_pairs_whole_commits(spark):
    import datetime
    ts = datetime.datetime(2024, 1, 1)
    rows = [("p", f"c{c}", "dev", ts, f"m/f{f:02d}", 1, 0) for c in range(3) for f in range(30)]
    rows += [("p", "c0", "dev", ts, "m/rare", 1, 0), ("p", "c1", "dev", ts, "m/rare", 1, 0)]
    ch = spark.createDataFrame(rows, CHANGES)
    pairs = {(r["file_a"], r["file_b"]): r["cochanges"] for r in history.change_coupling(ch).collect()}
    assert len(pairs) == 30 * 29 // 2 and set(pairs.values()) == {3} and ("m/f28", "m/f29") in pairs
    # the limits are there for who asks for them
    assert history.change_coupling(ch, max_files=10).count() == 45
    assert history.change_coupling(ch, top=7).count() == 7


def test_daily_trend_reads_the_whole_history(spark):
    import datetime
    day = datetime.datetime(2020, 1, 1)
    rows = [("p", day + datetime.timedelta(days=i), float(50 + (i if i < 100 else 200 - i) / 4)) for i in range(500)]
    out = forecast.daily_trend(spark.createDataFrame(rows, "project_id string, ts timestamp, overall double")).first()
    assert out["n"] == 500 and out["slope_per_day"] < 0


def test_rules_apply_to_their_own_project(spark):
    from repolens.operators import rules
    from repolens.streaming.jobs import check_snapshots
    analyses = spark.createDataFrame([(1, "a", 40.0), (2, "b", 40.0)], "analysis_id long, project_id string, overall double")
    ap = spark.createDataFrame([(1, "HIGH"), (2, "CRITICAL")], "analysis_id long, severity string")
    table = [("a", "min_overall_score", 60.0, None, None), ("*", "max_critical_anti_patterns", 0.0, None, None)]
    schema = "project_id string, rule string, threshold double, from_pattern string, to_pattern string"
    out = {(r.project_id, r.analysis_id, r.rule) for r in check_snapshots(analyses, ap, spark.createDataFrame(table, schema)).collect()}
    assert out == {("a", 1, "quality_gates.min_overall_score"), ("b", 2, "quality_gates.max_critical_anti_patterns")}
    banned = [("*", "banned_import", None, None, f"x{i}/") for i in range(10)] + [("a", "banned_import", None, None, f"y{i}/") for i in range(10)]
    edges = edges_df(spark, [("m/a.ts", "x3/b.ts"), ("m/a.ts", "y4/c.ts")])
    project = edges.first()["project_id"]
    mine = [(project if p == "a" else p, *rest) for p, *rest in banned] + [("other", "banned_import", None, None, "b.ts")]
    assert rules.banned_references(edges, spark.createDataFrame(mine, schema)).count() == 2


def test_python_standard_library_table():
    from repolens.operators.references import python_stdlib
    names = python_stdlib()
    assert len(names) == 201
    assert {"distutils", "imp", "test", "cgi", "telnetlib", "os", "_thread"} <= set(names)
    assert not {"zoneinfo", "this", "graphlib", "_abc"} & set(names)


def test_folders_at_the_project_root(spark):
    from repolens.functions import paths
    df = spark.createDataFrame([("dist/a.js",), ("build/b.js",), ("src/dist.js",), ("api/a.ts",), ("models/m.ts",), ("ui/u.ts",)], "path string")
    out = {r.path: (r.own, r.layer) for r in df.select("path", paths.is_own_file(F.col("path")).alias("own"), paths.layer(F.col("path")).alias("layer")).collect()}
    assert out == {"dist/a.js": (False, None), "build/b.js": (False, None), "src/dist.js": (True, None),
                   "api/a.ts": (True, "API"), "models/m.ts": (True, "Data"), "ui/u.ts": (True, "UI")}


def test_cycles_raise_when_rounds_run_out(spark):
    import pytest
    from repolens.operators import cycles
    edges = edges_df(spark, [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)])
    with pytest.raises(RuntimeError):
        cycles.scc_members(edges, max_rounds=3)
    assert cycles.scc_members(edges).count() == 12


def test_weekly_timeline_zero_filled(spark):
    import datetime
    ch = spark.createDataFrame([("p", "c1", "a", datetime.datetime(2024, 3, 6), "x/a", 3, 1)],
                               "project_id string, commit_id string, author string, ts timestamp, path string, additions long, deletions long")
    t = history.weekly_timeline(ch, "2024-03-07", weeks=4).orderBy("week").collect()
    assert [str(r["week"]) for r in t] == ["2024-02-12", "2024-02-19", "2024-02-26", "2024-03-04"]
    assert [r["churn"] for r in t] == [0, 0, 0, 4]


def test_dead_files_and_dot_variants(spark):
    e = edges_df(spark, [("pkg/main.py", "pkg.util")])
    f = files_df(spark, ["pkg/main.py", "pkg/util.py", "pkg/lonely.py", "pkg/__init__.py"])
    dead = sorted(r["path"] for r in refactor.dead_files(f, e).collect())
    assert dead == ["pkg/lonely.py"]


def test_js_rounding_half_up(spark):
    from repolens.functions.core import js_round
    r = spark.range(1).select(js_round(F.lit(-2.5)).alias("a"), js_round(F.lit(2.5)).alias("b")).first()
    assert (r["a"], r["b"]) == (-2, 3)
