"""What a path says: module (P06 mode c), resource (P13) and entity name.

Column expressions over the path alone, so they run inside the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.core import basename

# Folders by their part in the module strategies.
MODULE_MARKERS = "modules features apps domains packages components pages bundles".split()
CLEAN_LAYERS = "domain application infrastructure presentation core adapters ports usecases use_cases".split()
SUB_LAYERS = ("services entities models repositories interfaces value_objects events exceptions enums dto dtos controllers views routes api workers consumers "
              "persistence storage extraction agents adapters mappers factories providers guards middleware dependencies schemas serializers signals tasks "
              "commands queries handlers listeners").split()
GENERIC = ("src lib app main common shared utils helpers config configuration middleware middlewares guards pipes interceptors filters decorators "
           "tests test __tests__ spec specs e2e migrations seeds dto dtos entities models schemas interfaces types typings controllers services repositories "
           "providers factories data domain presentation infrastructure application core base abstract generics constants enums public static assets resources "
           "templates views internal pkg cmd vendor node_modules adapters ports usecases use_cases value_objects events exceptions errors signals hooks").split()
NEVER = "__pycache__ node_modules dist build .git vendor target".split()
DJANGO_FILES = "views.py models.py urls.py serializers.py admin.py apps.py forms.py".split()
PACKAGE_ROOTS = "com org net io br".split()
GO_FOLDERS = "cmd internal pkg".split()
PHP_SUFFIX = "Controller|Request|Resource|Policy|Observer|Event"
RESOURCE_SUFFIX = "Controller|Router|Route|View|Handler|Endpoint|Resource|Blueprint"
ENTITY_PATTERNS = [r"(?i)(?:models?|entities|entity|schemas?)/([^/]+)\.", r"(?i)([^/]+)\.(?:model|entity|schema)\.", r"(?i)([^/]+)\.models?\."]
ENTITY_SKIP = ["Index", "Base", "Init"]


def _first(parts: Column, pick) -> Column:
    """The first value that ``pick(part, place)`` gives."""
    return F.get(F.filter(F.transform(parts, pick), lambda x: x.isNotNull()), F.lit(0))


def _at(parts: Column, i: Column) -> Column:
    """Part ``i``, or null if there is none or it is empty."""
    x = F.get(parts, i)
    return F.when(x != "", x)


def module_inferred(path) -> Column:
    """Mode (c): the module by six strategies in turn, or null: below a marker
    folder, below a clean-architecture layer, a Django app, a package of Java
    or PHP, a Go package, the last folder with a name of its own."""
    path = F.col(path) if isinstance(path, str) else path
    parts, low = F.split(path, "/"), F.lower(path)
    parent = F.when(F.size(parts) > 1, _at(parts, F.size(parts) - 2))
    own_parent = F.when(~F.lower(parent).isin(GENERIC), parent)

    def clean(part, i):
        below, next_low, further = _at(parts, i + 1), F.lower(F.get(parts, i + 1)), _at(parts, i + 2)
        sub = F.when(~further.contains("."), further).otherwise(F.concat(part, F.lit("/"), below))
        return F.when(F.lower(part).isin(CLEAN_LAYERS) & below.isNotNull(),
                      F.when(next_low.isin(SUB_LAYERS), F.coalesce(sub, F.concat(part, F.lit("/"), below)))
                      .when(~next_low.isin(GENERIC) & (F.length(next_low) > 2) & ~next_low.startswith("__"), below))

    php = (F.when(~F.lower(parent).isin("controllers", "requests"), parent)
           .otherwise(F.regexp_replace(F.regexp_replace(basename(path), r"\.[^.]+$", ""), f"(?i)(?:{PHP_SUFFIX})$", "")))
    folders = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    named = F.filter(folders, lambda d: ~F.lower(d).isin(GENERIC + NEVER) & (F.length(d) > 2) & ~d.startswith(".") & ~d.startswith("__"))
    return F.coalesce(
        _first(parts, lambda p, i: F.when(F.lower(p).isin(MODULE_MARKERS), _at(parts, i + 1))),
        _first(parts, clean),
        F.when(low.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in DJANGO_FILES) + ")$"), own_parent),
        _first(parts, lambda p, i: F.when(F.lower(p).isin(PACKAGE_ROOTS), _at(parts, i + 2))),
        F.when(low.contains("/http/controllers/") | low.contains("/http/requests/"), F.when((php == parent) | (F.length(php) > 2), php)),
        F.when(low.endswith(".go") & ~parent.isin(GO_FOLDERS), own_parent),
        F.get(named, F.lit(0)))


def resource_name(path) -> Column:
    """The resource that a route file serves ('' if it names none)."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    name = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(basename(path), r"\.[^.]+$", ""), f"(?i)(?:{RESOURCE_SUFFIX})$", ""), "[-_]", ""))
    parent = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))
    return (F.when(~name.isin("", "index", "base") & (F.length(name) > 1), name)
            .when(~F.lower(parent).isin("", "routes", "controllers"), F.regexp_replace(F.lower(parent), "[-_]", "")).otherwise(""))


def entity_name(path) -> Column:
    """The entity that a model, entity or schema file defines, or null."""
    path = F.col(path) if isinstance(path, str) else path
    found = F.coalesce(*[F.when(path.rlike(p), F.regexp_extract(path, p, 1)) for p in ENTITY_PATTERNS])
    words = F.split(F.regexp_replace(found, "[-_]", " "), r"(?<=[A-Za-z0-9_])(?=[^A-Za-z0-9_])|(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])")
    name = F.trim(F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)), ""))
    return F.when((name != "") & ~name.isin(ENTITY_SKIP), name)
