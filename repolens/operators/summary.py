"""Project summaries: description, keywords, tech stack and purpose (C04), and
entry points (P14).

Inputs are ``files`` (project_id, path, content: manifests and readme) and
``nodes`` (project_id, path: the project's own source files).  Whatever grows
with a project, its paths above all, goes through combinable aggregates; only
lists with a bound (keywords, one manifest's dependencies) are arrays.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import paths as P
from repolens.operators.frameworks import scanner_frameworks
from repolens.operators.modules import module_inventory
from repolens.sources.manifests import dependencies, workspaces

# Limits, generic names, notable dependencies, purposes in the
# order they are tried, and paths of entry points.
MAX_KEYWORDS = 20
MAX_STACK = 15
MAX_PURPOSES = 3
MAX_ENTRY_POINTS = 10
MIN_PARAGRAPH = 20
MAX_DESCRIPTION = 300
GENERIC = ["node_modules", "dist", "build", ".git", ".next", "coverage", "__tests__", "__mocks__", "src", "lib", "index", "main",
           "out", "tmp", ".cache", "vendor", ".vscode", ".idea"]
NOTABLE = ["express", "fastify", "nestjs", "@nestjs/core", "koa", "hapi", "react", "next", "angular", "vue", "svelte",
           "prisma", "@prisma/client", "typeorm", "sequelize", "mongoose", "knex", "jest", "mocha", "vitest", "cypress", "playwright",
           "tailwindcss", "styled-components", "emotion", "redis", "ioredis", "bull", "bullmq", "graphql", "apollo", "@apollo/server",
           "socket.io", "ws", "passport", "jsonwebtoken", "bcrypt", "winston", "pino", "swagger", "@nestjs/swagger",
           "docker", "kubernetes", "aws-sdk", "@aws-sdk", "stripe", "paypal"]
PURPOSES = [
    ("api.*(rest|graph|endpoint)|controller.*route|swagger|openapi", "API Backend"),
    (r"cli|command.*line|bin\/|yargs|commander", "CLI Tool"),
    ("component.*ui|react|angular|vue|frontend|page.*screen", "Frontend Application"),
    ("mobile|flutter|dart|react.native|ionic", "Mobile App"),
    ("library|lib|package|npm|pub|sdk|module", "Library / Package"),
    ("test|spec|validator|lint|analyz|check", "Tool de Análise / Validação"),
    ("microservice|service|worker|queue", "Microservice"),
    (r"monorepo|workspace|packages\/", "Monorepo"),
    ("bot|scraper|crawler|automation", "Bot / Automação"),
    ("game|canvas|webgl|three", "Game / Visualização"),
    ("e-?commerce|shop|cart|product|catalog", "E-commerce"),
    ("blog|cms|content|post|article", "CMS / Blog"),
    ("auth|login|oauth|sso|identity", "Sistema de Autenticação"),
    ("chat|message|realtime|socket", "Comunicação Real-time"),
    ("dashboard|admin|panel|analytics", "Dashboard / Admin Panel"),
    ("payment|billing|fintech|finance|bank", "Fintech / Pagamentos"),
    ("health|medical|patient|clinic", "Healthcare"),
    ("education|course|learn|student", "EdTech")]
ENTRY_PATTERNS = [r"^(src\/)?(main|index|app|server|cli)\.(ts|js|py|dart|go|java)$", r"^(src\/)?bin\/",
                  r"^packages\/[^/]+\/src\/(main|index|app|server|cli)\.(ts|js)$", r"^packages\/[^/]+\/src\/bin\/",
                  r"manage\.py$", r"^main\.go$"]

_MANIFEST = "description STRING, keywords STRING, main STRING, bin STRING"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def _strings(text: Column) -> Column:
    """A JSON text that is a list of strings; null for anything else."""
    return F.from_json(F.when(text.startswith("["), text), "ARRAY<STRING>")


def _root_manifest(files: DataFrame) -> DataFrame:
    """(project_id, path, content, m) of the root ``package.json``."""
    root = files.where(F.col("path") == "package.json")
    return root.select("project_id", "path", "content", F.from_json("content", _MANIFEST).alias("m"))


# ---------------------------------------------------------------- C04 ----
def languages_of(nodes: DataFrame) -> DataFrame:
    """(project_id, files, languages): languages by number of files, then name."""
    n = nodes.select("project_id", P.language(F.col("path")).alias("language")).groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"))
    known = F.filter(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "language"))), lambda x: x["language"] != "Unknown")
    return n.groupBy("project_id").agg(F.sum("n").cast("bigint").alias("files"), F.transform(known, lambda x: x["language"]).alias("languages"))


def readme_paragraph(content: Column) -> Column:
    """The first line of a readme that is prose: no title, badge, picture,
    tag or rule, and not short; null if there is none."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    prose = F.filter(lines, lambda x: ~x.rlike(r"^(#|\[!|!\[|<|---|===)") & (F.length(x) >= MIN_PARAGRAPH))
    return F.substring(F.get(prose, F.lit(0)), 1, MAX_DESCRIPTION)


def _alternatives(pattern: str) -> list[str]:
    """A pattern's alternatives outside parentheses."""
    return re.split(r"\|(?![^(]*\))", pattern)


def purposes(signals: DataFrame) -> DataFrame:
    """(project_id, found): labels of the purposes that a project's signals
    show, in the order they are tried.

    ``signals``: (project_id, section, place, text), read as one text in this
    order.  ``a.*b`` may have its parts in different signals: it holds if some
    signal with ``a`` stands before one with ``b``, so least and greatest
    places decide and no text of a whole project is built.  All else is
    searched inside one signal.
    """
    at = F.struct("section", "place", "text")
    aggs, tests = [], []
    for i, (pattern, label) in enumerate(PURPOSES):
        one, apart = f"p{i}", []
        for j, alt in enumerate(x for x in _alternatives(pattern) if ".*" in x):
            a, b = alt.split(".*")
            aggs += [F.min(F.when(F.col("text").rlike(a), at)).alias(f"a{i}_{j}"), F.max(F.when(F.col("text").rlike(b), at)).alias(f"b{i}_{j}")]
            apart.append(F.coalesce(F.col(f"a{i}_{j}") < F.col(f"b{i}_{j}"), F.lit(False)))
        aggs.append(F.max(F.col("text").rlike(pattern)).alias(one))
        tests.append(F.when(reduce(lambda x, y: x | y, apart, F.coalesce(F.col(one), F.lit(False))), label))
    return signals.groupBy("project_id").agg(*aggs).select("project_id", F.filter(F.array(*tests), lambda x: x.isNotNull()).alias("found"))


def project_summary(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per project of ``nodes``: description, keywords, stack,
    purpose, and the number of its files.

    Description: the manifest's, else the readme's first paragraph, else a
    sentence about its files.  Keywords: of the manifest, its modules,
    frameworks and languages, without generic names, 20 at most.  Stack:
    languages, frameworks and notable dependencies, 15 at most.  Purpose: the
    first three kinds that its signals show.  Lists are joined by commas.
    Broken manifests count as missing, keywords that are numbers as their
    text; vendored paths are no signals.
    """
    nodes = nodes.select("project_id", "path").distinct()
    none = F.array().cast("array<string>")
    base = languages_of(nodes)
    root = _root_manifest(files)
    found = scanner_frameworks(files).groupBy("project_id").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))  # a fixed set of names
    readme = files.where(F.lower("path") == "readme.md").groupBy("project_id").agg(F.min_by(readme_paragraph(F.col("content")), "path").alias("readme"))
    inventory = module_inventory(nodes)  # at most 15 modules for a project
    modules = inventory.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "module"))), lambda m: F.lower(m["module"])).alias("modules"))
    wanted = root.groupBy("project_id").agg(
        F.first(_present(_trimmed(F.col("m.description")))).alias("said"),
        F.first(F.transform(_strings(F.col("m.keywords")), lambda k: F.lower(k))).alias("given"),
        F.first(dependencies(F.col("path"), F.col("content"))).alias("deps"))
    p = base.join(found, "project_id", "left").join(readme, "project_id", "left").join(modules, "project_id", "left").join(wanted, "project_id", "left")
    for c in ("frameworks", "modules", "given"):
        p = p.withColumn(c, F.coalesce(c, none))
    low = lambda c: F.transform(F.col(c), lambda x: F.lower(x))
    generic = F.array(*[F.lit(g) for g in GENERIC])
    keywords = F.filter(F.array_distinct(F.concat("given", "modules", low("frameworks"), low("languages"))),
                        lambda k: k.isNotNull() & ~F.array_contains(generic, k) & (F.length(k) > 1))
    p = p.withColumn("keywords", F.slice(keywords, 1, MAX_KEYWORDS)).withColumn("known", F.concat("languages", "frameworks"))
    # a notable dependency counts unless what stands for it is there already
    notable = F.array_distinct(F.filter(F.transform(F.coalesce("deps", F.array()), lambda d: d["name"]),
                                        lambda n: F.exists(F.array(*[F.lit(x) for x in NOTABLE]), lambda x: n.contains(x))))
    p = p.withColumn("notable", F.coalesce(notable, none))
    stands = lambda n: F.lower(F.get(F.split(F.regexp_replace(n, "^([^@]*)@", "$1"), "/"), F.lit(0)))
    kept = F.filter("notable", lambda n, i: ~F.array_contains(F.concat(low("known"), F.transform(F.slice("notable", F.lit(1), i), lambda x: F.lower(x))), stands(n)))
    p = p.withColumn("stack", F.slice(F.array_distinct(F.concat("known", kept)), 1, MAX_STACK))
    signals = (p.select("project_id", F.lit(0).alias("section"), F.posexplode("keywords").alias("place", "text"))
               .unionByName(inventory.select("project_id", F.lit(1).alias("section"), F.col("rank").cast("int").alias("place"), F.lower("module").alias("text")))
               .unionByName(inventory.select("project_id", F.lit(2).alias("section"), F.col("rank").cast("int").alias("place"), F.lower("description").alias("text")))
               .unionByName(nodes.where(~F.col("path").contains("node_modules"))
                            .select("project_id", F.lit(3).alias("section"), F.lit(0).alias("place"), F.lower("path").alias("text"))))
    p = p.join(purposes(signals), "project_id", "left")
    langs = F.array_join("languages", ", ")
    return p.select(
        "project_id", "files",
        F.coalesce("said", "readme", F.concat(F.lit("Project "), "project_id", F.lit(": "), F.col("files").cast("string"), F.lit(" files in "), langs)).alias("description"),
        F.array_join("keywords", ",").alias("keywords"), F.array_join("stack", ",").alias("stack"),
        F.when(F.size("found") > 0, F.array_join(F.slice("found", 1, MAX_PURPOSES), " + "))
        .otherwise(F.concat(F.lit("Project in "), F.array_join("languages", "/"))).alias("purpose"))


# ---------------------------------------------------------------- P14 ----
def _bins(text: Column) -> Column:
    """The paths of a manifest's ``bin``: one string, or the values of an object."""
    return (F.when(text.startswith("{"), F.map_values(F.from_json(text, "MAP<STRING, STRING>")))
            .when(text.isNotNull(), F.array(text)))


def _declared(manifest: Column) -> Column:
    """``bin`` paths, then ``main``."""
    none = F.array().cast("array<string>")
    return F.filter(F.concat(F.coalesce(_bins(manifest["bin"]), none), F.array(manifest["main"])), lambda x: x.isNotNull() & (x != ""))


def entry_points(files: DataFrame, nodes: DataFrame, top: int = MAX_ENTRY_POINTS) -> DataFrame:
    """(project_id, entry, source, rank): the first ``top`` entry points, each
    once: those that workspaces declare (by path), those of the root manifest,
    then source paths that look like one (by path)."""
    ws = workspaces(files).select("project_id", "path").distinct().withColumnRenamed("path", "dir")
    pkg = files.where(F.col("path").endswith("/package.json")).select(
        "project_id", F.regexp_replace("path", "/package.json$", "").alias("dir"), F.from_json("content", _MANIFEST).alias("m"))
    mine = ws.join(pkg, ["project_id", "dir"]).select("project_id", F.col("dir").alias("o"), F.posexplode(_declared(F.col("m"))).alias("i", "x")).select(
        "project_id", F.lit(1).alias("s"), "o", "i", F.concat("o", F.lit("/"), "x").alias("entry"))
    root = _root_manifest(files).select("project_id", F.lit(2).alias("s"), F.lit("").alias("o"), F.posexplode(_declared(F.col("m"))).alias("i", "entry"))
    like = nodes.where(F.col("path").rlike("|".join(f"(?:{p})" for p in ENTRY_PATTERNS))).select(
        "project_id", F.lit(3).alias("s"), F.col("path").alias("o"), F.lit(0).alias("i"), F.col("path").alias("entry"))
    first = mine.unionByName(root).unionByName(like).groupBy("project_id", "entry").agg(F.min(F.struct("s", "o", "i")).alias("at"))
    w = Window.partitionBy("project_id").orderBy("at", "entry")
    source = F.element_at(F.array(F.lit("workspace"), F.lit("manifest"), F.lit("path")), F.col("at.s"))
    return (first.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)
            .select("project_id", "entry", source.alias("source"), "rank"))
