"""Frameworks, stack and structure of projects.

All decisions are projections over constant tables and one aggregate per
project; no table of projects, files or dependencies is ever collected.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import basename

# Dependency -> framework, by category.
REGISTRY = {
    "web": {
        "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "starlette": "Starlette", "tornado": "Tornado", "sanic": "Sanic",
        "aiohttp": "aiohttp", "litestar": "Litestar", "django-rest-framework": "DRF", "djangorestframework": "DRF", "@nestjs/core": "NestJS",
        "express": "Express", "fastify": "Fastify", "koa": "Koa", "hapi": "Hapi", "@hapi/hapi": "Hapi", "next": "Next.js", "nuxt": "Nuxt",
        "spring-boot-starter-web": "Spring Boot", "spring-boot-starter": "Spring Boot", "quarkus": "Quarkus", "micronaut": "Micronaut", "ktor": "Ktor",
        "laravel/framework": "Laravel", "symfony/framework-bundle": "Symfony", "slim/slim": "Slim", "rails": "Ruby on Rails",
        "gin-gonic/gin": "Gin", "labstack/echo": "Echo", "gofiber/fiber": "Fiber", "gorilla/mux": "Gorilla Mux", "go-chi/chi": "Chi",
        "flutter": "Flutter", "shelf": "Shelf", "dart_frog": "Dart Frog", "actix-web": "Actix Web", "rocket": "Rocket", "axum": "Axum"},
    "orm": {
        "sqlalchemy": "SQLAlchemy", "tortoise-orm": "Tortoise ORM", "peewee": "Peewee", "sqlmodel": "SQLModel", "prisma": "Prisma",
        "typeorm": "TypeORM", "@prisma/client": "Prisma", "sequelize": "Sequelize", "mongoose": "Mongoose", "knex": "Knex", "drizzle-orm": "Drizzle"},
    "test": {"pytest": "pytest", "unittest": "unittest", "hypothesis": "Hypothesis", "jest": "Jest", "vitest": "Vitest", "mocha": "Mocha"},
    "lint": {"ruff": "Ruff", "flake8": "Flake8", "pylint": "Pylint", "black": "Black", "mypy": "mypy", "eslint": "ESLint", "biome": "Biome",
             "@biomejs/biome": "Biome", "prettier": "Prettier"},
}
# Ecosystem -> (order, confidence); a Gemfile and a pubspec name these only.
ECOSYSTEMS = {"python": (0, 0.95), "node": (1, 0.95), "java": (2, 0.85), "gradle": (2, 0.9), "php": (3, 0.9), "go": (4, 0.9), "ruby": (5, 0.95),
              "dart": (6, 0.95), "rust": (7, 0.85)}
RUBY = {"rails": ("Ruby on Rails", "web", 0.95), "sinatra": ("Sinatra", "web", 0.9), "rspec": ("RSpec", "test", 0.9)}
# Dependencies of package.json -> the scanner's framework names.
SCANNED = {"@nestjs/core": "NestJS", "@nestjs/common": "NestJS", "react": "React", "react-dom": "React", "@angular/core": "Angular", "vue": "Vue.js",
           "@vue/core": "Vue.js", "express": "Express.js", "next": "Next.js", "fastify": "Fastify", "typeorm": "TypeORM", "prisma": "Prisma",
           "@prisma/client": "Prisma", "sequelize": "Sequelize", "mongoose": "Mongoose", "@modelcontextprotocol/sdk": "MCP SDK", "probot": "Probot", "hono": "Hono"}
# Extensions -> language of a stack, frameworks of each side, path words of a database.
STACK_LANGUAGES = {"Python": ["py"], "TypeScript": ["ts", "tsx"], "JavaScript": ["js", "jsx"], "Dart": ["dart"], "Go": ["go"], "Rust": ["rs"],
                   "Java/Kotlin": ["java", "kt"], "Ruby": ["rb"], "PHP": ["php"], "C#": ["cs"]}
FRONTEND = ["Angular", "Vue", "Vue.js", "Next.js", "React", "Nuxt", "Nuxt.js", "Svelte", "SvelteKit", "Remix", "Gatsby", "Vite"]
BACKEND = ["Express", "Express.js", "NestJS", "Fastify", "Koa", "Hapi", "Django", "Flask", "FastAPI", "Spring Boot", "Laravel", "Rails",
           "Ruby on Rails", "Gin", "Echo", "Fiber", "Actix Web", "Rocket", "Probot", "MCP SDK"]
BACKEND_LANGUAGES = ["Python", "TypeScript", "Go", "Java/Kotlin", "Ruby", "PHP", "C#", "Rust"]
MOBILE = ["Flutter", "React Native", "Expo"]
DATABASE_WORDS = ["migration", "entity", "model", "schema", "prisma", "typeorm"]

_ENTRIES = {key: (name, category) for category, names in REGISTRY.items() for key, name in names.items()}
_HIT = "array<struct<name:string,category:string,version:string,confidence:double,rank:int>>"


def _lookup(pairs: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


# ------------------------------------------------------------ C05 ----
def ecosystem(manifest: Column) -> Column:
    name = basename(manifest)
    return (F.when(name.rlike(r"^requirements.*\.txt$") | manifest.rlike(r"(^|/)requirements/[^/]+\.txt$") | name.isin("pyproject.toml", "setup.py", "Pipfile"), "python")
            .when(name == "package.json", "node").when(name == "pom.xml", "java").when(name.isin("build.gradle", "build.gradle.kts"), "gradle")
            .when(name == "composer.json", "php").when(name == "go.mod", "go").when(name == "Gemfile", "ruby").when(name == "pubspec.yaml", "dart")
            .when(name == "Cargo.toml", "rust"))


def plain_version(spec: Column) -> Column:
    """The first number of a version range (``^1.2.0`` -> ``1.2.0``), or null."""
    found = F.regexp_extract(spec, r"[0-9][0-9.]*", 0)
    return F.when(found != "", found)


def frameworks(deps: DataFrame) -> DataFrame:
    """(project_id, name, category, version, confidence, rank): the frameworks
    that the manifests' dependencies name, each once (the first ecosystem, the
    surest, the first manifest), ranked with web frameworks first."""
    kind, low = ecosystem(F.col("manifest")), F.lower("dep_name")
    bare = F.regexp_replace(low, r"\[.*\]$", "")
    hit = lambda name, category, version, confidence: F.struct(name.alias("name"), category.alias("category"), version.alias("version"), confidence.alias("confidence"))
    key = F.when(kind.isin("python", "java", "gradle"), bare).otherwise(F.col("dep_name"))
    sure = _lookup({k: v[1] for k, v in ECOSYSTEMS.items()})[F.col("kind")]
    version = F.when(F.col("kind").isin("python", "node", "php"), plain_version(F.col("dep_version")))
    one = F.array(hit(_lookup({k: v[0] for k, v in _ENTRIES.items()})[F.col("key")], _lookup({k: v[1] for k, v in _ENTRIES.items()})[F.col("key")], version, sure))
    # a Go module path holds the registered name somewhere in it
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(c).alias("category")) for k, (n, c) in _ENTRIES.items()])
    go = F.transform(F.filter(table, lambda r: F.lower("dep_name").contains(r["key"])), lambda r: hit(r["name"], r["category"], F.lit(None).cast("string"), F.lit(0.9)))
    ruby = F.array(hit(*[_lookup({k: v[i] for k, v in RUBY.items()})[F.col("key")] for i in (0, 1)],
                       F.when(F.col("key") == "rails", plain_version(F.regexp_extract("dep_version", r"^(?:~>|>)\s*([0-9.]+)$", 1))), _lookup({k: v[2] for k, v in RUBY.items()})[F.col("key")]))
    gradle = F.transform(F.filter(F.array(*[F.lit(w) for w in ("spring-boot", "quarkus", "micronaut", "ktor")]), lambda w: F.lower("dep_name").contains(w)),
                         lambda w: hit(_lookup({"spring-boot": "Spring Boot", "quarkus": "Quarkus", "micronaut": "Micronaut", "ktor": "Ktor"})[w], F.lit("web"), F.lit(None).cast("string"), F.lit(0.9)))
    dart = F.when(F.col("key") == "flutter", F.array(hit(F.lit("Flutter"), F.lit("web"), F.lit(None).cast("string"), F.lit(0.95))))
    found = (F.when(F.col("kind") == "go", F.when(F.lower("dep_name").startswith("github.com/"), go)).when(F.col("kind") == "ruby", ruby)
             .when(F.col("kind") == "gradle", gradle).when(F.col("kind") == "dart", dart).otherwise(one))
    rows = (deps.select("project_id", "manifest", "dep_name", "dep_version", kind.alias("kind"), key.alias("key"))
            .select("project_id", "manifest", "dep_name", _lookup({k: v[0] for k, v in ECOSYSTEMS.items()})[F.col("kind")].alias("order"), F.explode(found).alias("h"))
            .where(F.col("h.name").isNotNull()))
    first = F.min_by("h", F.struct("order", (-F.col("h.confidence")).alias("c"), "manifest", "dep_name"))
    best = rows.groupBy("project_id", F.col("h.name").alias("name")).agg(first.alias("b")).select("project_id", "name", "b.category", "b.version", "b.confidence")
    by = Window.partitionBy("project_id").orderBy(F.col("category") != "web", F.desc("confidence"), "name")
    return best.withColumn("rank", F.row_number().over(by).cast("bigint"))  # at most one row for each registered name


def scanner_frameworks(files: DataFrame) -> DataFrame:
    """(project_id, framework): the names by which scoring profiles know them,
    from ``package.json`` files anywhere and other manifests at the root."""
    from repolens.sources.manifests import dependencies
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    node = (basename(path) == "package.json") & ~path.contains("node_modules")
    names = F.filter(F.transform(dependencies(path, content), lambda d: _lookup(SCANNED)[d["name"]]), lambda x: x.isNotNull())
    text = lambda word, name: F.when(content.contains(word), F.lit(name))
    said = (F.when(path == "pom.xml", F.array(F.when(content.contains("spring-boot"), "Spring Boot").when(content.contains("spring"), "Spring")))
            .when(path == "requirements.txt", F.array(text("django", "Django"), text("flask", "Flask"), text("fastapi", "FastAPI")))
            .when(path == "Gemfile", F.array(text("rails", "Ruby on Rails"))).when(path == "go.mod", F.array(F.lit("Go"))))
    return (files.select("project_id", F.explode(F.when(node, names).otherwise(said)).alias("framework"))
            .where(F.col("framework").isNotNull()).distinct())


# ------------------------------------------------------------ C06 ----
def stack_profile(files: DataFrame, found: DataFrame) -> DataFrame:
    """Per project of ``files`` (project_id, path): languages and frameworks
    (sorted), primary language, and whether it has a backend, a frontend, a
    mobile part and a database.  ``found``: (project_id, framework)."""
    low = F.lower("path")
    extension = F.element_at(F.split(low, r"\."), -1)
    seen = files.groupBy("project_id").agg(
        *[F.max(extension.isin(exts)).alias(f"l{i}") for i, exts in enumerate(STACK_LANGUAGES.values())],
        F.max(extension.isin("tsx", "jsx")).alias("jsx"), F.max(low.rlike("|".join(DATABASE_WORDS))).alias("has_database"))
    languages = F.filter(F.array(*[F.when(F.col(f"l{i}"), F.lit(name)) for i, name in enumerate(STACK_LANGUAGES)]), lambda x: x.isNotNull())
    names = found.groupBy("project_id").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))  # a fixed set of names
    out = seen.select("project_id", languages.alias("languages"), "jsx", "has_database").join(names, "project_id", "left")
    out = out.withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<string>")))
    any_of = lambda column, values: F.arrays_overlap(column, F.array(*[F.lit(v) for v in values]))
    return out.select("project_id", F.coalesce(F.get("languages", F.lit(0)), F.lit("Unknown")).alias("primary_language"),
                      F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"),
                      (any_of("frameworks", BACKEND) | any_of("languages", BACKEND_LANGUAGES)).alias("has_backend"),
                      (any_of("frameworks", FRONTEND) | F.col("jsx")).alias("has_frontend"),
                      (any_of("frameworks", MOBILE) | F.array_contains("languages", "Dart")).alias("has_mobile"), "has_database")


def project_structure(files: DataFrame) -> DataFrame:
    """(project_id, structure): clean-architecture, mvc, modular, monorepo,
    flat (no path of more than three parts) or unknown."""
    low = F.lower("path")
    folders = ["domain", "application", "infrastructure", "presentation", "models", "views", "controllers", "modules", "features", "packages", "apps"]
    has = files.groupBy("project_id").agg(*[F.max(low.contains(f"/{x}/")).alias(x) for x in folders], F.max(F.size(F.split("path", "/"))).alias("depth"))
    c = F.col
    kind = (F.when((c("domain") & c("infrastructure")) | (c("domain") & c("application") & c("presentation")), "clean-architecture")
            .when(c("models") & c("views") & c("controllers"), "mvc").when(c("modules") | c("features"), "modular")
            .when(c("packages") | c("apps"), "monorepo").when(c("depth") <= 3, "flat").otherwise("unknown"))
    return has.select("project_id", kind.alias("structure"))
