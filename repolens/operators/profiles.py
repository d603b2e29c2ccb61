"""Scoring profiles (B06) and weight overrides.

The profile table is a fixed six-row literal (always safe to broadcast).
``projects``: (project_id, frameworks ARRAY<STRING>, languages ARRAY<STRING>,
is_monorepo BOOLEAN, explicit_profile STRING nullable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_T = ["modularity_excellent", "modularity_good", "coupling_excellent", "coupling_good", "cohesion_excellent",
      "cohesion_good", "god_class_lines", "god_class_methods"]
_W = ["w_modularity", "w_coupling", "w_cohesion", "w_layering"]

# The six scoring profiles (weights, thresholds, matching frameworks / languages).
PROFILES = [
    ("default", (0.40, 0.25, 0.20, 0.15), (2, 6, 0.15, 0.35, 0.8, 0.45, 500, 10), [], []),
    ("frontend-spa", (0.35, 0.15, 0.35, 0.15), (3, 8, 0.25, 0.45, 0.7, 0.4, 500, 10),
     ["React", "Vue.js", "Angular", "Next.js"], []),
    ("backend-monolith", (0.35, 0.30, 0.15, 0.20), (2, 5, 0.10, 0.25, 0.8, 0.45, 400, 8),
     ["Express.js", "NestJS", "Fastify", "Django", "Flask", "Ruby on Rails", "Spring Boot", "Spring", "Hono"], []),
    ("microservices", (0.30, 0.20, 0.25, 0.25), (3, 7, 0.20, 0.40, 0.8, 0.45, 300, 6), [], ["go"]),
    ("data-pipeline", (0.30, 0.25, 0.35, 0.10), (4, 8, 0.15, 0.35, 0.65, 0.35, 600, 15), ["FastAPI"], ["python"]),
    ("library", (0.45, 0.20, 0.25, 0.10), (2, 5, 0.20, 0.40, 0.8, 0.45, 400, 12), ["MCP SDK"], []),
]


def profile_table(spark: SparkSession) -> DataFrame:
    rows = [(n, *[float(x) for x in w], *[float(x) for x in t]) for n, w, t, _, _ in PROFILES]
    schema = "profile string, " + ", ".join(f"{c} double" for c in _W + _T)
    return spark.createDataFrame(rows, schema)


def _matches(name: str) -> Column:
    fws = [f.lower() for n, _, _, fw, _ in PROFILES if n == name for f in fw]
    return F.arrays_overlap(F.transform("frameworks", lambda x: F.lower(x)), F.array(*[F.lit(f) for f in fws]))


def resolve_profile(projects: DataFrame) -> DataFrame:
    """Profile per project: explicit, frontend, backend (microservices when a
    monorepo), library, Go monorepo, Python without frameworks, default;
    joined to the (broadcast, six-row) profile table."""
    names = [p[0] for p in PROFILES]
    langs = F.transform("languages", lambda x: F.lower(x))
    name = (F.when(F.col("explicit_profile").isin(names), F.col("explicit_profile"))
            .when(_matches("frontend-spa"), "frontend-spa")
            .when(_matches("backend-monolith") & F.col("is_monorepo"), "microservices")
            .when(_matches("backend-monolith"), "backend-monolith")
            .when(_matches("library"), "library")
            .when(F.array_contains(langs, "go") & F.col("is_monorepo"), "microservices")
            .when(F.array_contains(langs, "python") & (F.size("frameworks") == 0), "data-pipeline")
            .otherwise("default"))
    p = projects.select("project_id", name.alias("profile"))
    return p.join(F.broadcast(profile_table(projects.sparkSession)), "profile")


def merge_weights(profiles: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Override profile weights with the user's (project_id, modularity,
    coupling, cohesion, layering; NULL = keep) and renormalise to sum 1 when
    the sum is off by more than 0.001."""
    if overrides is None:
        return profiles
    o = overrides.select("project_id", *[F.col(c).alias(f"o_{c}") for c in
                                         ("modularity", "coupling", "cohesion", "layering")])
    j = profiles.join(o, "project_id", "left")
    for c in ("modularity", "coupling", "cohesion", "layering"):
        j = j.withColumn(f"w_{c}", F.coalesce(F.col(f"o_{c}"), F.col(f"w_{c}"))).drop(f"o_{c}")
    s = F.col("w_modularity") + F.col("w_coupling") + F.col("w_cohesion") + F.col("w_layering")
    j = j.withColumn("_s", s)
    norm = (F.col("_s") > 0) & (F.abs(F.col("_s") - 1.0) > 0.001)
    for c in _W:
        j = j.withColumn(c, F.when(norm, F.col(c) / F.col("_s")).otherwise(F.col(c)))
    return j.drop("_s")
