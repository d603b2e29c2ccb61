"""Package manifests to dependency rows.

``files``: (project_id, path, content).  Output: (project_id, manifest,
dep_name, dep_version, is_dev).  Each file gives one array of dependencies,
by the format that its name says, and all arrays go through one explode:
JSON by ``from_json``, XML by ``from_xml``, TOML and YAML by cutting the text
into its sections first, the line formats by ``regexp_extract_all``.  A
manifest that does not parse gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.core import basename

JSON_SCHEMA = ("dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, "
               "require MAP<STRING,STRING>, `require-dev` MAP<STRING,STRING>")
POM_SCHEMA = ("dependencies STRUCT<dependency: ARRAY<STRUCT<groupId: STRING, artifactId: STRING, version: STRING, scope: STRING>>>")
REQUIREMENT_LINE = r"(?m)^([A-Za-z0-9_.\-\[\]]+)[ \t]*((?:[=<>!~]=?|@)[ \t]*[^\s;#]+)?"
GO_REQUIRE = r"(?m)^\s*(?:require\s+)?([a-z0-9.\-]+\.[a-z]{2,}/[^\s]+)\s+(v[^\s]+)"
GRADLE_LINE = r"(?m)^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompile|[cC]ompileOnly|[rR]untimeOnly|[kK]apt))[\s(]+['\"][^:'\"]+:([^:'\"]+)(?::([^'\"]+))?['\"]"
GEM_LINE = r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"
TOML_LINE = r"(?m)^\s*\"?([A-Za-z0-9_.\-]+)\"?\s*=\s*(?:\"([^\"]*)\"|\{[^}\n]*?\bversion\s*=\s*\"([^\"]*)\"|\{|true)"
YAML_LINE = r"(?m)^  ([A-Za-z0-9_]+):[ \t]*([^\s#][^\n#]*)?$"
QUOTED_SPEC = r"[\"']([A-Za-z0-9_.\-]+(?:\[[^\]\"']*\])?)[ \t]*([^\"';]*)"

_DEP = "array<struct<name:string,version:string,dev:boolean>>"
_TOML_PLAIN = ["dependencies", "tool.poetry.dependencies", "packages"]
_TOML_DEV = ["dev-dependencies", "build-dependencies", "tool.poetry.dev-dependencies", "dev-packages"]


def _dep(name: Column, version: Column, dev) -> Column:
    version = F.when(F.trim(version) != "", F.trim(version))
    return F.struct(name.alias("name"), version.alias("version"), (F.lit(dev) if isinstance(dev, bool) else dev).alias("dev"))


def _none() -> Column:
    return F.array().cast(_DEP)


def _found(text: Column, pattern: str, dev, name: int = 1, versions: tuple = (2,)) -> Column:
    """Dependencies by a pattern: the group of the name, and those of the
    version of which the first that is not empty counts."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), g) for g in (name, *versions)]
    return F.transform(F.arrays_zip(*groups), lambda z: _dep(z["0"], F.concat(*[z[str(k + 1)] for k in range(len(versions))]), dev))


def _map(parsed: Column, field: str, dev: bool) -> Column:
    entries = F.coalesce(F.map_entries(parsed.getField(field)), F.array().cast("array<struct<key:string,value:string>>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(dev).alias("dev")))


def _json(content: Column) -> Column:
    m = F.from_json(content, JSON_SCHEMA)
    return F.concat(_map(m, "dependencies", False), _map(m, "devDependencies", True), _map(m, "require", False), _map(m, "require-dev", True))


def _pom(content: Column) -> Column:
    m = F.from_xml(content, POM_SCHEMA, {"rowTag": "project"})
    return F.transform(F.coalesce(m["dependencies"]["dependency"], F.array()), lambda d: _dep(d["artifactId"], d["version"], F.coalesce(d["scope"] == "test", F.lit(False))))


def _in_sections(content: Column, cut: str, each) -> Column:
    """``each`` (an array of dependencies) of every section of the text."""
    return F.flatten(F.transform(F.split(content, cut), each))


def _toml(content: Column) -> Column:
    def section(text):
        header = F.regexp_extract(text, r"^[ \t]*\[+[ \t]*([^\]\n]+?)[ \t]*\]", 1)
        body = F.regexp_replace(text, r"^[ \t]*\[[^\n]*", "")
        listed = F.regexp_extract(body, r"(?s)(?:^|\n)[ \t]*dependencies[ \t]*=[ \t]*\[(.*?)\][ \t]*(?:\n|$)", 1)
        group = header.rlike(r"^tool\.poetry\.group\..+\.dependencies$") | header.isin(_TOML_DEV) | header.rlike(r"^target\..+\.dev-dependencies$")
        return (F.when(header == "project", _found(listed, QUOTED_SPEC, False))
                .when(header == "project.optional-dependencies", _found(F.regexp_replace(body, r"(?m)^[ \t]*[\w.\-]+[ \t]*=", ""), QUOTED_SPEC, True))
                .when(header.isin(_TOML_PLAIN) | header.rlike(r"^target\..+\.dependencies$"), F.filter(_found(body, TOML_LINE, False, versions=(2, 3)), lambda d: d["name"] != "python"))
                .when(group, F.filter(_found(body, TOML_LINE, True, versions=(2, 3)), lambda d: d["name"] != "python")).otherwise(_none()))
    return _in_sections(F.regexp_replace(content, r"(?m)(?<=^|\s)#.*$", ""), r"(?m)^(?=[ \t]*\[)", section)


def _gemfile(content: Column) -> Column:
    dev = lambda text: text.rlike(r"^\s*group\b[^\n]*(?:development|test)")
    return _in_sections(F.regexp_replace(content, r"(?m)#.*$", ""), r"(?m)^(?=\s*group\b)|^\s*end\b", lambda text: _found(text, GEM_LINE, dev(text)))


def _gradle(content: Column) -> Column:
    kinds, names, versions = (F.regexp_extract_all(content, F.lit(GRADLE_LINE), g) for g in (1, 2, 3))
    return F.transform(F.arrays_zip(kinds, names, versions), lambda z: _dep(z["1"], z["2"], F.lower(z["0"]).startswith("test")))


def _pubspec(content: Column) -> Column:
    def block(text):
        header = F.regexp_extract(text, r"^(\w+):", 1)
        return F.when(header.isin("dependencies", "dev_dependencies"), _found(text, YAML_LINE, header == "dev_dependencies")).otherwise(_none())
    return _in_sections(content, r"(?m)^(?=\w)", block)


def _setup(content: Column) -> Column:
    listed = lambda key: F.regexp_extract(content, rf"(?s)\b{key}\s*=\s*\[(.*?)\]", 1)
    return F.concat(_found(listed("install_requires"), QUOTED_SPEC, False), _found(listed("tests_require"), QUOTED_SPEC, True))


def dependencies(path: Column, content: Column) -> Column:
    """The dependencies of one manifest (name, version, dev), by its name."""
    name = basename(path)
    return (F.when(name.isin("package.json", "composer.json"), _json(content))
            .when(name.rlike(r"^requirements.*\.txt$") | path.rlike(r"(^|/)requirements/[^/]+\.txt$"), _found(content, REQUIREMENT_LINE, False))
            .when(name.isin("pyproject.toml", "Cargo.toml", "Pipfile"), _toml(content))
            .when(name == "go.mod", _found(content, GO_REQUIRE, False))
            .when(name == "pom.xml", _pom(content))
            .when(name.isin("build.gradle", "build.gradle.kts"), _gradle(content))
            .when(name == "Gemfile", _gemfile(content))
            .when(name == "pubspec.yaml", _pubspec(content))
            .when(name == "setup.py", _setup(content)))


def read_manifests(files: DataFrame) -> DataFrame:
    return (files.select("project_id", F.col("path").alias("manifest"), F.explode(dependencies(F.col("path"), F.col("content"))).alias("d"))
            .select("project_id", "manifest", F.col("d.name").alias("dep_name"), F.col("d.version").alias("dep_version"), F.col("d.dev").alias("is_dev")))


# ------------------------------------------------------------ S04 ----
WORKSPACE_SCHEMA = "name STRING, version STRING, description STRING, main STRING"


def glob_regex(glob: Column) -> Column:
    """A glob as a pattern of whole paths: ``**`` any folders, ``*`` and ``?``
    within one that does not start with a dot, ``{a,b}`` either."""
    out = F.regexp_replace(glob, r"([.+^$()\[\]|\\])", r"\\$1")
    out = F.regexp_replace(out, r"\{([^{}]*)\}", "(?:\u0001$1\u0002)")
    out = F.aggregate(F.split(out, "(?=\u0001)|(?<=\u0002)"), F.lit(""), lambda a, x: F.concat(a, F.when(x.startswith("\u0001"), F.replace(x, F.lit(","), F.lit("|"))).otherwise(x)))
    out = F.regexp_replace(out, "[\u0001\u0002]", "")
    out = F.regexp_replace(out, r"/\*\*$", "\u0003")
    out = F.regexp_replace(out, r"(^|/)\*\*/", "$1\u0004")
    out = F.regexp_replace(out, r"^\*\*$", "\u0005")
    out = F.regexp_replace(F.regexp_replace(out, r"(^|/)(?=[*?])", "$1(?!\\\\.)"), r"\*+", "[^/]*")
    out = F.regexp_replace(out, r"(?<!\()\?(?![!:])", "[^/]")
    out = F.regexp_replace(out, "\u0003", "(?:/(?!\\\\.)[^/]+)*")
    out = F.regexp_replace(out, "\u0004", "(?:(?!\\\\.)[^/]+/)*")
    return F.concat(F.lit("^"), F.regexp_replace(out, "\u0005", "(?:(?!\\\\.)[^/]+(?:/(?!\\\\.)[^/]+)*)?"), F.lit("$"))


def workspaces(files: DataFrame) -> DataFrame:
    """Monorepo workspaces: (project_id, glob, path, name, version,
    description), one row for each glob of the root ``package.json`` and
    folder with a ``package.json`` that it matches.

    A glob meets the folders below its literal beginning by an equi-join (each
    folder is listed under all its parents); the rest of it is a pattern on
    the pairs that meet."""
    pkg = files.where((F.col("path") == "package.json") | F.col("path").endswith("/package.json")).where(F.col("content").isNotNull())
    root = pkg.where(F.col("path") == "package.json")
    listed = F.coalesce(F.from_json("content", "workspaces ARRAY<STRING>")["workspaces"],
                        F.from_json("content", "workspaces STRUCT<packages: ARRAY<STRING>>")["workspaces"]["packages"])
    glob = F.regexp_replace(F.regexp_replace(F.col("raw"), r"^(?:\./)+", ""), r"/+$", "")
    globs = root.select("project_id", F.explode(listed).alias("raw")).where(F.col("raw").isNotNull()).select("project_id", F.col("raw").alias("glob"), glob.alias("g")).distinct()
    fixed = F.regexp_extract("g", r"^((?:[^/*?{}\[\]]+/)*)(?:[^/]*[*?{}\[\]].*)$", 1)
    globs = globs.select("project_id", "glob", F.regexp_replace(F.when(F.col("g").rlike(r"[*?{}\[\]]"), fixed).otherwise(F.col("g")), "/$", "").alias("below"), glob_regex(F.col("g")).alias("pattern"))
    folder = F.regexp_replace("path", r"/?package\.json$", "")
    nested = pkg.select("project_id", folder.alias("dir"), F.from_json("content", WORKSPACE_SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).where((F.col("dir") != "") & F.col("m").isNotNull())
    parts = F.split("dir", "/")
    parents = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    met = nested.select("project_id", "dir", "m", F.explode(parents).alias("below")).join(globs, ["project_id", "below"]).where(F.rlike("dir", "pattern"))
    present = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    return met.select("project_id", "glob", F.col("dir").alias("path"), present(F.col("m.name"), F.col("dir")).alias("name"),
                      present(F.col("m.version"), F.lit("0.0.0")).alias("version"), F.coalesce("m.description", F.lit("")).alias("description"))
