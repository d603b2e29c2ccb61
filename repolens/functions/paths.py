"""Path and file-content column functions.

All are native column expressions, usable in ``select``/``where``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.core import basename

# Third-party / build path segments that are never own source.
EXCLUDED_SEGMENTS = ["node_modules", "/dist/", "/build/", "/coverage/",
                     "/.next/", "/venv/", "/__pycache__/", "/target/"]

# Extension -> language.
LANGUAGE_BY_EXT = {
    ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".jsx": "JavaScript",
    ".py": "Python", ".java": "Java", ".go": "Go", ".rb": "Ruby", ".php": "PHP",
    ".cs": "C#", ".cpp": "C++", ".c": "C", ".rs": "Rust", ".kt": "Kotlin",
    ".scala": "Scala", ".sql": "SQL", ".graphql": "GraphQL",
}

# Method declaration patterns and internal-export markers.
METHOD_PATTERNS = [r"(?:async\s+)?(?:function|public|private|protected|static)\s+\w+\s*\(",
                   r"(?:readonly\s+)?\w+\s*=\s*(?:async\s+)?\("]
INTERNAL_MARKERS = ["_", "Internal", "Private", "Impl", "Detail"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_slashes(path) -> Column:
    return F.regexp_replace(_c(path), r"\\", "/")


# ---------------------------------------------------------------- P03 ----
def is_own_file(path) -> Column:
    """False when the path contains any third-party / build segment."""
    p = F.concat(F.lit("/"), normalize_slashes(path))  # a marker may stand first
    bad = F.lit(False)
    for seg in EXCLUDED_SEGMENTS:
        bad = bad | p.contains(seg)
    return ~bad


# ---------------------------------------------------------------- P01 ----
def extension(path) -> Column:
    """Lower-cased extension of the base name including the dot ('' if none).

    A leading dot alone (``.gitignore``) is not an extension.
    """
    name = basename(_c(path))
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language(path) -> Column:
    m = F.create_map(*[x for k, v in LANGUAGE_BY_EXT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[extension(path)], F.lit("Unknown"))


# ---------------------------------------------------------------- P02 ----
def line_count(content) -> Column:
    """Number of '\\n'-separated pieces; an empty text counts as one line."""
    return F.size(F.split(_c(content), "\n", -1)).cast("bigint")


# ---------------------------------------------------------------- P09 ----
def method_count(content) -> Column:
    c = _c(content)
    return (F.regexp_count(c, F.lit(METHOD_PATTERNS[0]))
            + F.regexp_count(c, F.lit(METHOD_PATTERNS[1]))).cast("bigint")


# ---------------------------------------------------------------- P10 ----
def internal_export_count(content) -> Column:
    c = _c(content)
    total = None
    for m in INTERNAL_MARKERS:
        n = F.regexp_count(c, F.lit(rf"export\s+\w*{m}\w*"))
        total = n if total is None else total + n
    return total.cast("bigint")


# ---------------------------------------------------------------- P04 ----
# Folder, suffix and name markers of the layers.
_DATA_DIRS = ["/entities/", "/entity/", "/migrations/", "/migration/", "/seeds/", "/seeders/",
              "/data/", "/db/", "/database/", "/models/", "/schema/", "/subscribers/"]
_DATA_SUFFIX = [".entity.ts", ".entity.js", ".model.ts", ".model.js"]
_DATA_NAME = ["repository", "dao", "mapper", "migration", "seed", "subscriber"]
_INFRA_DIRS = ["/config/", "/infra/", "/infrastructure/", "/setup/", "/guards/", "/pipes/",
               "/interceptors/", "/filters/", "/decorators/", "/middleware/", "/middlewares/",
               "/common/", "/shared/", "docker", "kubernetes"]
_INFRA_SUFFIX = [".guard.ts", ".pipe.ts", ".interceptor.ts", ".filter.ts", ".decorator.ts",
                 ".middleware.ts"]
_INFRA_NAME = [".config.", ".module."]
_API_DIRS = ["/api/", "/routes/", "/controllers/"]
_API_SUFFIX = [".controller.ts", ".controller.js", ".dto.ts", ".dto.js"]
_API_NAME = ["route", "controller", "handler"]
_SERVICE_DIRS = ["/service", "/business", "/logic", "/use-cases/", "/usecases/"]
_SERVICE_SUFFIX = [".service.ts", ".service.js"]
_SERVICE_NAME = ["service", "manager", "facade", "usecase"]
_UI_DIRS = ["/ui/", "/components/", "/pages/", "/views/", "/screens/", "/templates/"]
_UI_EXT = [".tsx", ".jsx", ".vue", ".html"]
_TEST_SUFFIX = [".test.ts", ".test.js", ".spec.ts", ".spec.js"]
_TEST_DIRS = ["/__tests__/", "/__mocks__/"]


def _any(col: Column, items, how: str) -> Column:
    """Any item contained in / ending ``col``, as ONE alternation regex (keeps
    the generated code small; a chain of contains() calls per category
    overflows the 64 KB method limit of whole-stage codegen)."""
    alt = "|".join(re.escape(it) for it in items)
    return col.rlike(f"({alt})" if how == "contains" else f"({alt})$")


def layer(path) -> Column:
    """Architectural layer of a file, or NULL (tests, vendored, unmatched).

    Checked in order: Data, Infrastructure, API, Service, UI.
    """
    p = F.concat(F.lit("/"), F.lower(_c(path)))  # a folder marker may stand first
    n = F.lower(basename(_c(path)))
    ext = extension(path)
    is_test = _any(n, _TEST_SUFFIX, "ends") | _any(p, _TEST_DIRS, "contains")
    return (F.when(is_test, F.lit(None).cast("string"))
            .when(p.contains("node_modules"), F.lit(None).cast("string"))
            .when(_any(p, _DATA_DIRS, "contains") | _any(n, _DATA_SUFFIX, "ends")
                  | _any(n, _DATA_NAME, "contains"), F.lit("Data"))
            .when(_any(p, _INFRA_DIRS, "contains") | _any(n, _INFRA_SUFFIX, "ends")
                  | _any(n, _INFRA_NAME, "contains"), F.lit("Infrastructure"))
            .when(_any(p, _API_DIRS, "contains") | _any(n, _API_SUFFIX, "ends")
                  | _any(n, _API_NAME, "contains"), F.lit("API"))
            .when(_any(p, _SERVICE_DIRS, "contains") | _any(n, _SERVICE_SUFFIX, "ends")
                  | _any(n, _SERVICE_NAME, "contains"), F.lit("Service"))
            .when(_any(p, _UI_DIRS, "contains") | ext.isin(_UI_EXT), F.lit("UI")))


# ---------------------------------------------------------------- P06 ----
def module_top(path) -> Column:
    """Mode (a): first directory of the path, or 'root' for a bare file."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 1, parts.getItem(0)).otherwise(F.lit("root"))


# Top directories that hold modules one level down.
SOURCE_ROOTS = ["src", "lib", "app", "packages", "modules", "features", "apps"]


def module_second_level(path) -> Column:
    """Module for grouping: first directory, or the second level below a
    source root (src, lib, app, ...); 'root' for a bare file."""
    parts = F.split(_c(path), "/")
    first = parts.getItem(0)
    return (F.when(F.size(parts) < 2, F.lit("root"))
            .when(first.isin(SOURCE_ROOTS) & (F.size(parts) > 2), parts.getItem(1))
            .otherwise(first))


# ---------------------------------------------------------------- P08 ----
def relativize(path, root: str) -> Column:
    """Project-relative path: strip ``root/`` when the path starts with it."""
    prefix = root.rstrip("/") + "/"
    p = _c(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)
