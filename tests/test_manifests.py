"""Manifest formats (S03), workspaces (S04), frameworks and stack (C05, C06):
literal files."""

import re

import pytest
from pyspark.sql import functions as F

from repolens.operators import frameworks as FW
from repolens.sources import manifests as M

FILES = "project_id string, path string, content string"
PYPROJECT = '''[project]
name = "x"
dependencies = [
  "fastapi>=0.1,<2",  # web
  "uvicorn[standard] ~= 1.0",
  "plain",
]
[project.optional-dependencies]
dev = ["pytest>=7", "black"]
docs = [
 "sphinx==5"]
[tool.poetry.dependencies]
python = "^3.11"
django = "^4.2"
sqlalchemy = { version = "2.0", extras = ["x"] }
[tool.poetry.group.test.dependencies]
hypothesis = "*"
[tool.black]
line-length = 100
'''
CASES = {
    "pyproject.toml": (PYPROJECT, [("fastapi", ">=0.1,<2", False), ("uvicorn[standard]", "~= 1.0", False), ("plain", None, False), ("pytest", ">=7", True), ("black", None, True),
                                   ("sphinx", "==5", True), ("django", "^4.2", False), ("sqlalchemy", "2.0", False), ("hypothesis", "*", True)]),
    "Cargo.toml": ('[package]\nname = "a"\n[dependencies]\naxum = "0.7"\nserde = { version = "1.0", features = ["derive"] }\n[dev-dependencies]\nrocket="0.5"\n',
                   [("axum", "0.7", False), ("serde", "1.0", False), ("rocket", "0.5", True)]),
    "pom.xml": ('<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId>me</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>web</artifactId>'
                '<version>3.1</version></dependency><dependency><artifactId>junit</artifactId><scope>test</scope></dependency></dependencies></project>', [("web", "3.1", False), ("junit", None, True)]),
    "a/pom.xml": ("<broken", []),
    "build.gradle.kts": ("dependencies {\n  implementation(\"io.ktor:ktor:2.3\")\n  testImplementation 'org.junit:junit:4.13'\n  api 'a:b'\n}", [("ktor", "2.3", False), ("junit", "4.13", True), ("b", None, False)]),
    "Gemfile": ("gem 'rails', '~> 7.0'\n# gem 'no'\ngroup :development, :test do\n  gem 'rspec'\nend\ngem \"puma\", \">= 5\"\n", [("rails", "~> 7.0", False), ("rspec", None, True), ("puma", ">= 5", False)]),
    "pubspec.yaml": ("name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  shelf: ^1.4.0\ndev_dependencies:\n  test: any\nother:\n  a: b\n", [("flutter", None, False), ("shelf", "^1.4.0", False), ("test", "any", True)]),
    "Pipfile": ('[packages]\nflask = "*"\n[dev-packages]\npylint = "==2"\n', [("flask", "*", False), ("pylint", "==2", True)]),
    "setup.py": ("setup(name='x', install_requires=['tornado>=6', 'peewee'], tests_require=['mocha'])", [("tornado", ">=6", False), ("peewee", None, False), ("mocha", None, True)]),
    "requirements/base.txt": ("aiohttp==3.8\n# c\nkoa\n", [("aiohttp", "==3.8", False), ("koa", None, False)]),
    "package.json": ('{"dependencies": {"a": "1"}, "devDependencies": {"b": "^2"}}', [("a", "1", False), ("b", "^2", True)]),
    "b/package.json": ("{broken", []),
    "notes.txt": ("flask==1", []),
}


def test_formats(spark):
    df = spark.createDataFrame([("p", k, v[0]) for k, v in CASES.items()] + [("p", "c/package.json", None)], FILES)
    out = {}
    for r in M.read_manifests(df).collect():
        out.setdefault(r.manifest, []).append((r.dep_name, r.dep_version, r.is_dev))
    assert {k: sorted(v, key=str) for k, v in out.items()} == {k: sorted(v[1], key=str) for k, v in CASES.items() if v[1]}


def test_globs(spark):
    cases = {"packages/*": (["packages/a"], ["packages", "packages/a/b", "packages/.a", "xpackages/a"]), "apps/**": (["apps", "apps/a", "apps/a/b"], ["apps/.x", "appsx"]),
             "tools/{a,b}": (["tools/a", "tools/b"], ["tools/c", "tools/a,b"]), "libs/core": (["libs/core"], ["libs/core/x"]), "**": (["a", "a/b"], [".a", "a/.b"]),
             "*/x?": (["p/xy"], ["p/x", "p/xyz"]), "a.b/*+": (["a.b/c+"], ["aXb/c+", "a.b/c"]), "**/z": (["z", "a/z", "a/b/z"], ["a/zz", ".a/z"]), "p/**/q": (["p/q", "p/a/b/q"], ["pq", "p/a"])}
    found = {r.g: r.r for r in spark.createDataFrame([(g,) for g in cases], "g string").select("g", M.glob_regex(F.col("g")).alias("r")).collect()}
    for glob, (yes, no) in cases.items():
        assert [p for p in yes + no if re.match(found[glob], p)] == yes, glob


def test_workspaces(spark):
    rows = [("p", "package.json", '{"workspaces": ["./packages/*/", "apps/**", "missing/*"]}'), ("p", "packages/a/package.json", '{"name": "@p/a", "version": "2.0.0", "description": "d"}'),
            ("p", "packages/b/package.json", "{}"), ("p", "packages/c/readme.md", "x"), ("p", "packages/a/deep/package.json", '{"name": "deep"}'), ("p", "apps/x/y/package.json", '{"name": "y"}'),
            ("p", "other/package.json", '{"name": "o"}'), ("q", "package.json", '{"workspaces": {"packages": ["libs/*"]}}'), ("q", "libs/l/package.json", '{"name": "l"}'),
            ("q", "packages/a/package.json", '{"name": "not mine"}'), ("r", "package.json", "{broken"), ("r", "packages/a/package.json", "{}"), ("s", "package.json", '{"name": "s"}')]
    out = sorted((r.project_id, r.path, r.name, r.version, r.description) for r in M.workspaces(spark.createDataFrame(rows, FILES)).collect())
    assert out == [("p", "apps/x/y", "y", "0.0.0", ""), ("p", "packages/a", "@p/a", "2.0.0", "d"), ("p", "packages/b", "packages/b", "0.0.0", ""), ("q", "libs/l", "l", "0.0.0", "")]


def test_workspaces_meet_by_an_equi_join(spark):
    plan = M.workspaces(spark.createDataFrame([("p", "package.json", "{}")], FILES))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


DEPS = "project_id string, manifest string, dep_name string, dep_version string, is_dev boolean"


def test_frameworks(spark):
    rows = [("p", "package.json", "express", "^4.18.2", False), ("p", "package.json", "jest", "~29", True), ("p", "package.json", "lodash", "1", False), ("p", "requirements.txt", "FastAPI", ">=0.100", False),
            ("p", "web/pom.xml", "spring-boot-starter", "3", False), ("p", "web/pom.xml", "spring-boot-starter-web", "3", False), ("q", "go.mod", "github.com/labstack/echo/v4", "v4.1", False),
            ("q", "go.mod", "golang.org/x/gorilla/mux", "v1", False), ("r", "Gemfile", "rails", "~> 7.0.1", False), ("r", "Gemfile", "rspec", None, True), ("s", "build.gradle", "ktor-server", "2", False),
            ("t", "package.json", "Express", "1", False), ("u", "Cargo.toml", "axum", "0.7", False), ("u", "pubspec.yaml", "flutter", None, False), ("v", "requirements.txt", "uvicorn[standard]", "1", False)]
    out = {(r.project_id, r.name): (r.category, r.version, r.confidence, r.rank) for r in FW.frameworks(spark.createDataFrame(rows, DEPS)).collect()}
    assert out == {("p", "Express"): ("web", "4.18.2", 0.95, 1), ("p", "FastAPI"): ("web", "0.100", 0.95, 2), ("p", "Spring Boot"): ("web", None, 0.85, 3), ("p", "Jest"): ("test", "29", 0.95, 4),
                   ("q", "Echo"): ("web", None, 0.9, 1), ("r", "Ruby on Rails"): ("web", "7.0.1", 0.95, 1), ("r", "RSpec"): ("test", None, 0.9, 2), ("s", "Ktor"): ("web", None, 0.9, 1),
                   ("u", "Axum"): ("web", None, 0.85, 2), ("u", "Flutter"): ("web", None, 0.95, 1)}


def test_scanner_frameworks(spark):
    rows = [("p", "package.json", '{"dependencies": {"react": "1", "react-dom": "1"}, "devDependencies": {"hono": "1"}}'), ("p", "a/node_modules/x/package.json", '{"dependencies": {"vue": "1"}}'),
            ("p", "pom.xml", "<artifactId>spring-boot-x"), ("q", "pom.xml", "spring-core"), ("q", "sub/go.mod", "module"), ("r", "go.mod", ""), ("r", "requirements.txt", "django==1\nflask"), ("s", "Gemfile", "gem 'rails'")]
    out = sorted((r.project_id, r.framework) for r in FW.scanner_frameworks(spark.createDataFrame(rows, FILES)).collect())
    assert out == [("p", "Hono"), ("p", "React"), ("p", "Spring Boot"), ("q", "Spring"), ("r", "Django"), ("r", "Flask"), ("r", "Go"), ("s", "Ruby on Rails")]


@pytest.mark.parametrize("paths, structure", [
    (["src/domain/a.ts", "src/infrastructure/b.ts"], "clean-architecture"), (["a/Domain/x", "a/application/x", "a/presentation/x"], "clean-architecture"), (["a/domain/x", "a/application/x"], "flat"),
    (["a/models/x", "a/views/x", "a/controllers/x"], "mvc"), (["a/features/x"], "modular"), (["x/packages/a/b"], "monorepo"), (["a/b/c/d"], "unknown"), (["a.ts"], "flat")])
def test_structure(spark, paths, structure):
    df = spark.createDataFrame([("p", p) for p in paths], "project_id string, path string")
    assert [r.structure for r in FW.project_structure(df).collect()] == [structure]


def test_stack(spark):
    files = spark.createDataFrame([("p", "a/b.py"), ("p", "x.TSX"), ("p", "db/schema.sql"), ("q", "m.dart"), ("r", "notes")], "project_id string, path string")
    found = spark.createDataFrame([("p", "React"), ("r", "Express.js")], "project_id string, framework string")
    out = {r.project_id: (r.primary_language, r.languages, r.frameworks, r.has_backend, r.has_frontend, r.has_mobile, r.has_database) for r in FW.stack_profile(files, found).collect()}
    assert out == {"p": ("Python", "Python,TypeScript", "React", True, True, False, True), "q": ("Dart", "Dart", "", False, False, True, False), "r": ("Unknown", "", "Express.js", True, False, False, False)}
