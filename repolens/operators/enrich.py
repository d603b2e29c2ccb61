"""Inferred endpoints (P13), entities (P11), module details (C02), untested
modules, critical files and size classes (C03).

``files``: (project_id, path[, lines]); ``edges``: (project_id, src, dst, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import roles
from repolens.functions.inference import entity_name, module_inferred, resource_name

# Words of an edge's target that stand for a check.
AUTH_WORDS = "auth guard permission jwt token security".split()
VALIDATION_WORDS = "dto schema validator pipe serializer form pydantic marshmallow".split()
CRITICAL_TOP = 10
UNTESTED_MIN = 2
SIZES = [("enterprise", 500, 100_000), ("large", 200, 50_000), ("medium", 50, 10_000)]


# ------------------------------------------------------------ P13 ----
def _endpoint(method: str, path, handler, auth, validation) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
    return F.struct(F.lit(method).alias("method"), lit(path).alias("endpoint"), lit(handler).alias("handler"), lit(auth).alias("has_auth"), lit(validation).alias("has_validation"))


def endpoints(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, method, endpoint, file, handler, has_auth, has_validation):
    what each route file serves by its name, checks by what it imports; of
    files with the same endpoint the first by path counts."""
    low, to = F.lower("path"), F.lower("dst")
    flags = edges.groupBy("project_id", F.col("src").alias("path")).agg(F.max(to.rlike("|".join(AUTH_WORDS))).alias("auth"), F.max(to.rlike("|".join(VALIDATION_WORDS))).alias("validation"))
    routes = (files.select("project_id", "path").distinct().where(roles.to_col(roles.CONTROLLER, low)).withColumn("name", resource_name("path"))
              .where(~F.col("name").isin("", "init", "index")).join(flags, ["project_id", "path"], "left"))
    auth, valid, name = F.coalesce("auth", F.lit(False)), F.coalesce("validation", F.lit(False)), F.col("name")
    at = lambda *parts: F.concat(*[F.lit(p) if p.startswith(("/", "_")) or p.endswith("_") else name for p in parts])
    crud = [("GET", at("/", "x"), at("list_", "x")), ("GET", at("/", "x", "/{id}"), at("get_", "x")), ("POST", at("/", "x"), at("create_", "x")),
            ("PUT", at("/", "x", "/{id}"), at("update_", "x")), ("DELETE", at("/", "x", "/{id}"), at("delete_", "x"))]
    served = (F.when(low.contains("health") | low.contains("status"), F.array(_endpoint("GET", "/health", "health_check", False, False)))
              .when(low.contains("metric") | low.contains("monitor"), F.array(_endpoint("GET", "/metrics", "get_metrics", auth, False)))
              .when(low.contains("auth"), F.array(_endpoint("POST", "/auth/login", "login", False, True), _endpoint("POST", "/auth/register", "register", False, True),
                                                  _endpoint("POST", "/auth/refresh", "refresh_token", True, False)))
              .when(low.contains("search") | low.contains("query"), F.array(_endpoint("GET", at("/", "x", "/search"), at("search_", "x"), auth, True),
                                                                           _endpoint("POST", at("/", "x", "/search"), at("advanced_search_", "x"), auth, True)))
              .otherwise(F.array(*[_endpoint(m, p, h, auth, valid) for m, p, h in crud])))
    rows = routes.select("project_id", F.col("path").alias("file"), F.explode(served).alias("e"))
    first = rows.groupBy("project_id", F.col("e.method").alias("method"), F.col("e.endpoint").alias("endpoint")).agg(F.min(F.struct("file", "e.handler", "e.has_auth", "e.has_validation")).alias("f"))
    return first.select("project_id", "method", "endpoint", "f.file", "f.handler", "f.has_auth", "f.has_validation")


# ------------------------------------------------------------ P11 ----
def entities(files: DataFrame) -> DataFrame:
    """(project_id, name, source, layer): entities by the names of model files,
    each once whatever its case (the first by path)."""
    low = F.lower("path")
    layer = (F.when(low.contains("/model"), "model").when(low.contains("/entity") | low.contains("/entities"), "entity")
             .when(low.contains("/schema"), "schema").when(low.contains("/dto"), "dto").otherwise("unknown"))
    named = files.select("project_id", "path", entity_name("path").alias("name"), layer.alias("layer")).where(F.col("name").isNotNull())
    first = named.groupBy("project_id", F.lower("name").alias("k")).agg(F.min(F.struct("path", "name", "layer")).alias("f"))
    return first.select("project_id", "f.name", F.col("f.path").alias("source"), "f.layer")


# ------------------------------------------------------------ C02 ----
def module_details(files: DataFrame) -> DataFrame:
    """Per inferred module: files, lines, tests, entities, controllers,
    services, and the layer of its first file."""
    low = F.lower("path")
    lines = F.col("lines") if "lines" in files.columns else F.lit(0)
    rows = files.select("project_id", "path", module_inferred("path").alias("module"), lines.alias("lines"), roles.to_col(roles.TEST, low).alias("t"),
                        roles.to_col(roles.ENTITY, low).alias("e"), roles.to_col(roles.CONTROLLER, low).alias("c"), roles.to_col(roles.SERVICE, low).alias("s"),
                        roles.extended_layer("path").alias("layer")).where(F.col("module").isNotNull())
    count = lambda c: F.sum(F.col(c).cast("bigint"))
    return rows.groupBy("project_id", "module").agg(
        F.count(F.lit(1)).cast("bigint").alias("files"), F.sum("lines").cast("bigint").alias("lines"), count("t").alias("tests"), count("e").alias("entities"),
        count("c").alias("controllers"), count("s").alias("services"), F.min_by("layer", "path").alias("layer"))


# ------------------------------------------------------------ C03 ----
def untested_modules(details: DataFrame) -> DataFrame:
    return details.where((F.col("tests") == 0) & (F.col("files") >= UNTESTED_MIN)).select("project_id", "module", "files")


def critical_files(edges: DataFrame, top: int = CRITICAL_TOP) -> DataFrame:
    """The ``top`` files of a project by the weight of their edges, ties by path."""
    ends = edges.select("project_id", F.explode(F.array("src", "dst")).alias("path"), "weight")
    per = ends.groupBy("project_id", "path").agg(F.sum("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("weight"), "path"))
    return per.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)


def size_classes(files: DataFrame) -> DataFrame:
    """(project_id, files, lines, size_class)."""
    per = files.groupBy("project_id").agg(F.count(F.lit(1)).cast("bigint").alias("files"), F.sum("lines").cast("bigint").alias("lines"))
    size = F.lit("small")
    for name, most_files, most_lines in reversed(SIZES):
        size = F.when((F.col("files") > most_files) | (F.col("lines") > most_lines), name).otherwise(size)
    return per.withColumn("size_class", size)
