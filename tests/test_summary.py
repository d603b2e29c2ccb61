"""Project summaries (C04) and entry points (P14) on literal projects."""

from __future__ import annotations

import json
import random
import re

from repolens.operators import summary as S

FILES = "project_id string, path string, content string"
NODES = "project_id string, path string"


def _summary(spark, files, nodes):
    got = S.project_summary(spark.createDataFrame(files, FILES), spark.createDataFrame(nodes, NODES))
    return {r.project_id: r for r in got.collect()}


def test_descriptions_in_order_of_preference(spark):
    readme = "# Title\n\n[![badge](x)]\n<p>html paragraph that is long</p>\n---\n![picture](a.png) with a long caption\nshort\n   A real paragraph of this readme.  \nMore of it follows here.\n"
    nodes = [(p, "src/a.ts") for p in "abcde"] + [("a", "b.py"), ("a", "c.py"), ("a", "x.unknown")]
    got = _summary(spark, [("a", "package.json", "{broken"), ("b", "package.json", json.dumps({"description": "  Said.  "})), ("b", "README.md", readme),
                           ("c", "package.json", json.dumps({"description": "   "})), ("c", "README.md", readme),
                           ("d", "README.md", "# only a title"), ("e", "README.md", None)], nodes)
    assert got["a"].description == "Project a: 4 files in Python, TypeScript"
    assert got["b"].description == "Said."
    assert got["c"].description == "A real paragraph of this readme."
    assert got["d"].description == "Project d: 1 files in TypeScript" == got["e"].description.replace(" e:", " d:")


def test_keywords_and_stack(spark):
    pkg = {"keywords": ["API", "src", "z", "Extra", 7], "dependencies": {"react": "1", "@nestjs/core": "1", "@stripe/js": "1", "left-pad": "1"},
           "devDependencies": {"stripe": "1", "@stripe/react-x": "1", "jest": "1", "ts-jest": "1"}}
    got = _summary(spark, [("p", "package.json", json.dumps(pkg))], [("p", "src/billing/a.ts"), ("p", "src/billing/b.ts"), ("p", "lib/x.ts")])["p"]
    words = got.keywords.split(",")
    assert words[:2] == ["api", "extra"]
    assert "billing" in words and "typescript" in words and not {"src", "z", "lib"} & set(words)
    # @nestjs/core and react stand as frameworks already, @stripe/react-x comes after stripe
    assert got.stack == "TypeScript,NestJS,React,@stripe/js,stripe,jest,ts-jest"
    many = {"keywords": [f"word{i}" for i in range(40)]}
    assert len(_summary(spark, [("p", "package.json", json.dumps(many))], [("p", "a.ts")])["p"].keywords.split(",")) == S.MAX_KEYWORDS


def test_purposes_against_the_joined_text(spark):
    rnd = random.Random(5)
    words = ["api", "rest", "graph", "controller", "route", "command", "line", "page", "screen", "component", "ui", "shop", "nothing", "q", "react native", "ecommerce"]
    rows, want = [], {}
    for k in range(150):
        texts = sorted(rnd.choice(words) + str(rnd.randrange(3)) for _ in range(rnd.randrange(1, 5)))
        rnd.shuffle(texts)
        rows += [(f"p{k}", 0, i, t) for i, t in enumerate(texts)]
        whole = " ".join(texts)
        want[f"p{k}"] = [label for pattern, label in S.PURPOSES if re.search(pattern, whole)]
    df = spark.createDataFrame(rows, "project_id string, section int, place int, text string").repartition(4)
    assert {r.project_id: r.found for r in S.purposes(df).collect()} == want


def test_no_purpose_falls_back_to_languages(spark):
    assert _summary(spark, [], [("p", "Q.java")])["p"].purpose == "Project in Java"


def test_entry_points_in_order(spark):
    files = [("p", "package.json", json.dumps({"workspaces": ["packages/*"], "bin": {"one": "bin/1.js", "two": "bin/2.js"}, "main": "bin/1.js"})),
             ("p", "packages/b/package.json", json.dumps({"bin": "cli.js", "main": "lib.js"})), ("p", "packages/a/package.json", json.dumps({"main": "index.js"})),
             ("p", "other/package.json", json.dumps({"main": "not-a-workspace.js"})), ("q", "package.json", "{broken")]
    nodes = [("p", "main.go"), ("p", "src/cli.ts"), ("p", "src/other.ts"), ("p", "bin/1.js"), ("q", "x/manage.py"), ("r", "src/none.ts")] + [("s", f"bin/{i:02}.ts") for i in range(12)]
    got = {}
    for r in sorted(S.entry_points(spark.createDataFrame(files, FILES), spark.createDataFrame(nodes, NODES)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.project_id, []).append((r.source, r.entry))
    assert got["p"] == [("workspace", "packages/a/index.js"), ("workspace", "packages/b/cli.js"), ("workspace", "packages/b/lib.js"),
                        ("manifest", "bin/1.js"), ("manifest", "bin/2.js"), ("path", "main.go"), ("path", "src/cli.ts")]
    assert got["q"] == [("path", "x/manage.py")] and "r" not in got
    assert [e for _, e in got["s"]] == [f"bin/{i:02}.ts" for i in range(S.MAX_ENTRY_POINTS)]


def test_empty_tables(spark):
    files, nodes = spark.createDataFrame([], FILES), spark.createDataFrame([], NODES)
    assert S.project_summary(files, nodes).count() == 0 and S.entry_points(files, nodes).count() == 0
