"""File role flags and the extended layer.

Each rule is a small tree of (contains / endswith) tests on the lower-cased
path, written once as data and rendered both as a Spark column and as SQL
(for the oracle), so the two cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule language: ("c", s) contains, ("e", s) endswith, ("any", [...]), ("all", [...]), ("not", r)
C = lambda s: ("c", s)
E = lambda s: ("e", s)


def ANY(*r):
    return ("any", list(r))


def ALL(*r):
    return ("all", list(r))


def NOT(r):
    return ("not", r)


# Fixed values of the role and layer rules.
TEST = ANY(C("/test"), C("/spec"), C("__tests__"), C(".test."), C(".spec."), C("_test.py"), C("_test.go"),
           ALL(C("test_"), E(".py")), C("/tests/"))
ENTITY = ANY(C("/model"), C("/entity"), C("/entities"), C("/schema"), C("/value_object"), C(".model."), C(".entity."),
             E("models.py"),
             ALL(C("/domain/"), ANY(E(".java"), E(".kt")), NOT(C("service")), NOT(C("repository"))),
             ALL(C("/models/"), E(".php")))
CONTROLLER = ANY(C(".controller."), C(".router."), ALL(C("/routes/"), NOT(C("__init__"))),
                 ALL(C("/route/"), NOT(C("__init__"))), E("views.py"), E("_view.py"), E("urls.py"), C("blueprint"),
                 ALL(ANY(E(".java"), E(".kt")), C("controller")), ALL(C("/controllers/"), E(".php")),
                 ALL(E(".go"), ANY(C("handler"), C("router"))), ALL(C("/controllers/"), E(".rb")),
                 C("/endpoint"), C("/handler"))
SERVICE = ANY(C("service"), C("usecase"), C("use_case"), C("use-case"), C("interactor"),
              ALL(C("/application/"), NOT(C("interface")), NOT(C("__init__"))))
LAYER_RULES = [
    ("API", ANY(C("/route"), C("/controller"), C("/endpoint"), C("/api/"), C("/presentation/"), C("/handler"),
                ALL(C("/view"), NOT(C("/review"))), C("/urls"), C("/blueprint"), C("/http/"))),
    ("Service", ANY(C("/service"), C("/usecase"), C("/use_case"), C("/use-case"), C("/application/"))),
    ("Data", ANY(C("/model"), C("/entity"), C("/entities"), C("/schema"), C("/repository"), C("/persistence"),
                 C("/migration"), C("/domain/"), C("/value_object"), C("/serializer"))),
    ("UI", ANY(C("/component"), C("/page"), C("/screen"), C("/widget"), C("/template"), C("/partial"),
               C("/layout"))),
    ("Infrastructure", ANY(C("/config"), C("/middleware"), C("/infra"), C("/infrastructure/"), C("/storage"),
                           C("/extraction"), C("/adapter"), C("/worker"), C("/consumer"), C("/queue"), C("/cache"),
                           C("/email"), C("/notification"))),
    ("CLI", ANY(C("/cli/"), C("/command"), C("/script"), C("/management/commands"))),
]
PACKAGE_LAYERS = [(["dashboard", "web", "frontend", "app", "ui"], "UI"), (["api", "cloud", "server", "backend"], "API"),
                  (["core", "bridge", "engine"], "Service"), (["cli", "command"], "CLI"),
                  (["types", "events", "mcp", "autonomy"], "Infrastructure")]


def to_col(rule, low: Column) -> Column:
    kind, arg = rule
    if kind == "c":
        return low.contains(arg)
    if kind == "e":
        return low.endswith(arg)
    if kind == "not":
        return ~to_col(arg, low)
    parts = [to_col(r, low) for r in arg]
    out = parts[0]
    for p in parts[1:]:
        out = (out | p) if kind == "any" else (out & p)
    return out


def to_sql(rule, low: str) -> str:
    kind, arg = rule
    if kind == "c":
        return f"contains({low}, '{arg}')"
    if kind == "e":
        return f"ends_with({low}, '{arg}')"
    if kind == "not":
        return f"NOT {to_sql(arg, low)}"
    return "(" + (" OR " if kind == "any" else " AND ").join(to_sql(r, low) for r in arg) + ")"


def extended_layer(path) -> Column:
    """Package-name layer for ``packages/<name>``, else the first matching
    path rule (API, Service, Data, UI, Infrastructure, CLI), else 'Other'."""
    low = F.lower(F.col(path) if isinstance(path, str) else path)
    pkg = F.regexp_extract(low, r"packages/([^/]+)", 1)
    expr = None
    for names, layer in PACKAGE_LAYERS:
        cond = pkg.isin(names)
        expr = F.when(cond, F.lit(layer)) if expr is None else expr.when(cond, F.lit(layer))
    expr = expr.when(pkg != "", F.lit("Package"))
    for layer, rule in LAYER_RULES:
        expr = expr.when(to_col(rule, low), F.lit(layer))
    return expr.otherwise(F.lit("Other"))


def with_roles(files, path: str = "path"):
    low = F.lower(F.col(path))
    return files.select("project_id", path, to_col(TEST, low).alias("is_test"),
                        to_col(ENTITY, low).alias("is_entity"), to_col(CONTROLLER, low).alias("is_controller"),
                        to_col(SERVICE, low).alias("is_service"), extended_layer(path).alias("ext_layer"))
