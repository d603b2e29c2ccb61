"""Refactoring candidates and plan tables.

Only the finding tables are built (no file edits or generated text).  All
rules run on the internal edge graph (``references.internal_edges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import basename, js_round, parent_dir
from repolens.operators.ranking import numbered
from repolens.session import materialize

# Fixed values of the refactoring rules.
HUB_MIN_FAN_IN = 8
BARREL_MIN_OUT = 3
BARREL_HIGH_OUT = 8
BARREL_SIBLING_EXPORTS = 5
CROSS_MIN_DIRS = 5
#: Edges out of barrels are sent to all executors up to so many rows; beyond, both sides are shuffled.
BROADCAST_EDGES = 200_000
HUB_BARRELS = {  # barrel names per language
    "typescript": ["index.ts", "index.tsx", "mod.ts"],
    "javascript": ["index.js", "index.mjs", "index.cjs", "index.jsx"],
    "python": ["__init__.py"], "go": [], "rust": ["mod.rs", "lib.rs"], "java": ["package-info.java"],
}
OPTIMIZER_BARRELS = ["__init__.py", "index.ts", "index.js", "index.tsx", "index.jsx"]
ENTRY_POINTS = ["main.py", "cli.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "main.ts", "main.js",
                "app.ts", "app.js", "server.ts", "server.js", "index.html", "setup.py", "setup.cfg",
                "pyproject.toml"]
PRIORITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
STEP_COLS = ["project_id", "rule", "target", "priority", "tier", "operations"]
IMPACT_COLS = ["project_id", "rule", "target", "metric", "delta"]


def priority_rank(col="priority") -> Column:
    m = F.create_map(*[x for k, v in PRIORITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(col)], F.lit(4))


def _typed_path(path) -> Column:
    low = F.lower(path)
    return low.contains("types") | low.contains("interface")


# ---------------------------------------------------------------- R01 ----
def _hub_name(path: str, lang: str) -> Column:
    return ~basename(path).isin(HUB_BARRELS[lang]) & ~_typed_path(F.col(path))


def _dependents(edges: DataFrame) -> DataFrame:
    """Importers of each file by group: (project_id, hub, group, dependents)."""
    parts = F.when(F.col("src").contains("/"), F.split("src", "/")).otherwise(F.split("src", r"\."))
    grp = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit("core"))
    return (edges.where(F.col("project_id").isNotNull() & F.col("dst").isNotNull())
            .groupBy("project_id", F.col("dst").alias("hub"), grp.alias("group"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("dependents")))


def hub_groups(edges: DataFrame, lang: str = "typescript", min_fan_in: int = HUB_MIN_FAN_IN) -> DataFrame:
    """Dependents of each hub grouped by their parent directory name
    (second-to-last path segment, or 'core'): (project_id, hub, group, dependents)."""
    fan = edges.groupBy("project_id", F.col("dst").alias("hub")).agg(F.count(F.lit(1)).alias("fan_in"))
    hubs = fan.where((F.col("fan_in") >= min_fan_in) & _hub_name("hub", lang))
    return _dependents(edges).join(hubs.select("project_id", "hub"), ["project_id", "hub"], "left_semi")


def hub_splits(edges: DataFrame, lang: str = "typescript", min_fan_in: int = HUB_MIN_FAN_IN) -> DataFrame:
    """Hubs with fan-in >= ``min_fan_in`` whose dependents fall in >= 2 groups
    (CRITICAL).  Fan-in is the sum over the groups, so edges are read once."""
    return (_dependents(edges).groupBy("project_id", "hub")
            .agg(F.count(F.lit(1)).cast("bigint").alias("groups"), F.sum("dependents").cast("bigint").alias("fan_in"))
            .where((F.col("fan_in") >= min_fan_in) & (F.col("groups") >= 2) & _hub_name("hub", lang))
            .withColumn("priority", F.lit("CRITICAL"))
            .withColumn("operations", F.col("groups") + F.col("fan_in") + 1))


# ---------------------------------------------------------------- R02 ----
def barrel_candidates(edges: DataFrame) -> DataFrame:
    """Barrel files importing >= 3 files: consumers that also import one of
    the barrel's targets directly, sibling re-exports, priority.

    Only files that import a barrel can be its consumers: the pairs (c, b) are
    the edges into barrels, their direct edges (c -> t) are looked up among
    the barrel's own (b -> t) by (b, t).  A file that many others import meets
    the barrels of its importers only, never all its importers.
    """
    e = edges.select("project_id", "src", "dst")
    # edges out of barrels are written once: the rest meets them by broadcast while they are few
    bout = materialize(e.where(basename("src").isin(OPTIMIZER_BARRELS)))
    stats = bout.groupBy("project_id", F.col("src").alias("barrel")).agg(
        F.count(F.lit(1)).alias("outgoing"),
        F.sum(F.when(parent_dir(F.col("dst")) == parent_dir(F.col("src")), 1).otherwise(0)).alias("siblings"))
    stats = stats.where(F.col("outgoing") >= BARREL_MIN_OUT)
    few = bout.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES
    side = F.broadcast if few else (lambda df: df)
    into = (e.join(side(stats.select("project_id", F.col("barrel").alias("dst"))), ["project_id", "dst"], "left_semi")
            .select("project_id", F.col("src").alias("consumer"), F.col("dst").alias("barrel")).distinct())
    to_target = (e.select("project_id", F.col("src").alias("consumer"), F.col("dst").alias("t"))
                 .join(side(bout.select("project_id", F.col("dst").alias("t")).distinct()), ["project_id", "t"], "left_semi"))
    direct = (into.join(to_target, ["project_id", "consumer"])
              .join(bout.select("project_id", F.col("src").alias("barrel"), F.col("dst").alias("t")), ["project_id", "barrel", "t"], "left_semi")
              .select("project_id", "barrel", "consumer").distinct()
              .groupBy("project_id", "barrel").agg(F.count(F.lit(1)).alias("consumers")))
    out = (stats.join(direct, ["project_id", "barrel"], "left")
           .withColumn("consumers", F.coalesce("consumers", F.lit(0)))
           .withColumn("operations", F.col("consumers")
                       + F.when(F.col("siblings") > BARREL_SIBLING_EXPORTS, 1).otherwise(0))
           .where(F.col("operations") > 0)
           .withColumn("priority", F.when(F.col("outgoing") >= BARREL_HIGH_OUT, "HIGH").otherwise("MEDIUM")))
    return out.select("project_id", "barrel", *[F.col(c).cast("bigint").alias(c) for c in
                                                ("outgoing", "siblings", "consumers", "operations")], "priority")


# ---------------------------------------------------------------- R03 ----
def cross_boundary(edges: DataFrame, min_dirs: int = CROSS_MIN_DIRS) -> DataFrame:
    """Files importing from >= ``min_dirs`` other directories (not ``.test.`` files)."""
    d = edges.select("project_id", "src", "dst", parent_dir(F.col("src")).alias("sd"),
                     parent_dir(F.col("dst")).alias("td"))
    g = d.groupBy("project_id", "src").agg(
        F.count_distinct("dst").cast("bigint").alias("targets"),
        F.count_distinct(F.when(F.col("td") != F.col("sd"), F.col("td"))).cast("bigint").alias("dirs"))
    return (g.where((F.col("dirs") >= min_dirs) & ~F.col("src").contains(".test."))
            .withColumn("priority", F.lit("HIGH")))


# ---------------------------------------------------------------- R05 ----
def dead_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (paths with a directory) nobody references - directly or by a
    dotted module name - that reference nothing either; entry points, tests,
    dunder and dot files excluded.  Priority per project: MEDIUM at >= 3."""
    from repolens.operators.graph import dot_variants
    name = basename("path")
    excluded = (name.isin(ENTRY_POINTS) | name.startswith("__") | name.startswith(".")
                | name.endswith(".test.ts") | name.endswith(".spec.ts") | name.endswith("_test.py")
                | name.endswith(".test.py") | name.startswith("test_"))
    # one aggregate of files and edge ends; a reference without project is none
    ends = edges.where(F.col("project_id").isNotNull())
    roles = (files.where(F.col("path").contains("/")).select("project_id", "path", F.lit(False).alias("used"))
             .unionByName(ends.select("project_id", F.col("dst").alias("path"), F.lit(True).alias("used")).where(F.col("path").contains("/")))
             .unionByName(ends.select("project_id", F.col("src").alias("path"), F.lit(True).alias("used")).where(F.col("path").contains("/"))))
    loose = materialize(roles.groupBy("project_id", "path").agg(F.max("used").alias("used")).where(~F.col("used"))
                        .select("project_id", "path").where(~excluded))
    # a module name has no slash: most references are none
    modules = edges.where(~F.col("dst").contains("/")).select("project_id", F.col("dst").alias("variant")).distinct()
    by_variant = (dot_variants(loose).join(modules, ["project_id", "variant"], "left_semi").select("project_id", "path").distinct())
    dead = materialize(loose.join(by_variant, ["project_id", "path"], "left_anti"))  # both are read twice
    per_project = dead.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))  # partial count, not a window
    return (dead.join(per_project, "project_id")
            .withColumn("priority", F.when(F.col("_n") >= 3, "MEDIUM").otherwise("LOW")).drop("_n"))


# ---------------------------------------------------------------- R06 ----
def steps(edges: DataFrame, files: DataFrame | None = None, lang: str = "typescript",
          extra: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """All rule findings as plan steps plus their score impacts.

    Returns (steps[project_id, rule, target, priority, tier, operations],
    impacts[project_id, rule, target, metric, delta]).  ``extra`` takes
    (steps, impacts) pairs from registered custom rules (U02).
    """
    hs = hub_splits(edges, lang).select("project_id", F.lit("hub-splitter").alias("rule"),
                                        F.col("hub").alias("target"), "priority", "operations")
    bc = barrel_candidates(edges).select("project_id", F.lit("barrel-optimizer").alias("rule"),
                                         F.col("barrel").alias("target"), "priority", "operations")
    cb = cross_boundary(edges).select("project_id", F.lit("import-organizer").alias("rule"),
                                      F.col("src").alias("target"), "priority", F.lit(2).cast("bigint")
                                      .alias("operations"))
    parts = [hs, bc, cb]
    if files is not None:
        dead = dead_files(files, edges)
        parts.append(dead.groupBy("project_id").agg(
            F.count(F.lit(1)).cast("bigint").alias("operations"), F.first("priority").alias("priority"))
            .select("project_id", F.lit("dead-code-detector").alias("rule"), F.lit("*").alias("target"),
                    "priority", "operations"))
    st = parts[0]
    for p in parts[1:]:
        st = st.unionByName(p)
    st = st.withColumn("tier", F.lit(1).cast("bigint")).select(*STEP_COLS)
    deltas = {"hub-splitter": [("coupling", 15)], "barrel-optimizer": [("coupling", 10), ("layering", 5)],
              "import-organizer": [("cohesion", 5), ("coupling", 5)], "dead-code-detector": [("modularity", 5)]}
    impact_map = F.create_map(*[x for k, v in deltas.items() for x in (
        F.lit(k), F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(d).cast("bigint").alias("delta"))
                            for m, d in v]))])
    imp = st.select("project_id", "rule", "target", F.explode(impact_map[F.col("rule")]).alias("i")).select(
        "project_id", "rule", "target", "i.metric", "i.delta")
    for s_df, i_df in extra or []:
        st = st.unionByName(s_df.select(*STEP_COLS))
        imp = imp.unionByName(i_df.select(*IMPACT_COLS))
    return st, imp


def plan(step_df: DataFrame) -> DataFrame:
    """Steps numbered per project by priority, then rule, then target."""
    return numbered(step_df, ["project_id"], [priority_rank(), "rule", "target"], pos="step_id")


def plan_totals(step_df: DataFrame) -> DataFrame:
    return step_df.groupBy("project_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("steps"),
        F.sum("operations").cast("bigint").alias("total_operations"),
        F.sum(F.when(F.col("tier") == 1, 1).otherwise(0)).cast("bigint").alias("tier1_steps"),
        F.sum(F.when(F.col("tier") == 2, 1).otherwise(0)).cast("bigint").alias("tier2_steps"))


# ---------------------------------------------------------------- B08 ----
def estimate_after(scores: DataFrame, impacts: DataFrame) -> DataFrame:
    """Score after the plan: each touched metric becomes
    min(95, max(current, min(95, current + delta))) for its largest delta;
    overall = rounded default-weighted sum, at most 100."""
    best = impacts.groupBy("project_id", "metric").agg(F.max("delta").alias("d"))
    wide = best.groupBy("project_id").pivot("metric", ["modularity", "coupling", "cohesion", "layering"]).agg(
        F.first("d"))
    s = scores.join(wide.select("project_id", *[F.col(m).alias(f"d_{m}") for m in
                                                ["modularity", "coupling", "cohesion", "layering"]]),
                    "project_id", "left")
    out = ["project_id"]
    for m in ["modularity", "coupling", "cohesion", "layering"]:
        cur = F.col(m)
        after = F.least(F.lit(95), cur + F.col(f"d_{m}"))
        out.append(F.when(F.col(f"d_{m}").isNull(), cur)
                   .otherwise(F.least(F.lit(95), F.greatest(cur, after))).cast("bigint").alias(f"{m}_after"))
    r = s.select(*out)
    total = (F.col("modularity_after") * 0.4 + F.col("coupling_after") * 0.25
             + F.col("cohesion_after") * 0.2 + F.col("layering_after") * 0.15)
    return r.withColumn("overall_after", F.least(js_round(total), F.lit(100)).cast("bigint"))


# ---------------------------------------------------------------- R08 ----
SUGGEST_HUB_MIN = 5
SUGGEST_CROSS_MIN = 3
SUGGEST_BARRELS = ["__init__.py", "index.ts", "index.js"]


def suggestions(ap: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Suggestions per project: one per anti-pattern; the 3 most connected
    files (>= 5 edge ends; barrels among them dropped); the 2 files importing
    from most other directories (>= 3); 'Reduce Coupling' / 'Improve
    Cohesion' when the score is below 70 and no hub / cross-boundary
    suggestion covers it.  Columns: project_id, priority, title, target, n."""
    s1 = ap.select("project_id", F.when(F.col("severity") == "CRITICAL", "CRITICAL").otherwise("HIGH").alias("priority"),
                   F.col("name").alias("title"), F.col("location").alias("target"),
                   F.lit(None).cast("bigint").alias("n"))
    ends = edges.select("project_id", F.explode(F.array("src", "dst")).alias("path"))
    deg = ends.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUGGEST_HUB_MIN)
    wh = Window.partitionBy("project_id").orderBy(F.desc("n"), "path")
    hubs = (deg.withColumn("r", F.row_number().over(wh)).where(F.col("r") <= 3)
            .where(~basename("path").isin(SUGGEST_BARRELS))
            .select("project_id", F.lit("HIGH").alias("priority"),
                    F.concat(F.lit("Hub File: "), basename("path")).alias("title"), F.col("path").alias("target"),
                    F.col("n").cast("bigint").alias("n")))
    cb = (edges.select("project_id", "src", parent_dir(F.col("src")).alias("sd"), parent_dir(F.col("dst")).alias("td"))
          .where(F.col("sd") != F.col("td")).groupBy("project_id", "src")
          .agg(F.count_distinct("td").alias("n")).where(F.col("n") >= SUGGEST_CROSS_MIN))
    wc = Window.partitionBy("project_id").orderBy(F.desc("n"), "src")
    cross = (cb.withColumn("r", F.row_number().over(wc)).where(F.col("r") <= 2)
             .select("project_id", F.lit("MEDIUM").alias("priority"),
                     F.concat(F.lit("Cross-boundary: "), basename("src")).alias("title"), F.col("src").alias("target"),
                     F.col("n").cast("bigint").alias("n")))
    has_hub = hubs.select("project_id").distinct()
    has_cross = cross.select("project_id").distinct()
    fb_c = (scores.where(F.col("coupling") < 70).join(has_hub, "project_id", "left_anti")
            .select("project_id", F.lit("HIGH").alias("priority"), F.lit("Reduce Coupling").alias("title"),
                    F.lit(None).cast("string").alias("target"), F.lit(None).cast("bigint").alias("n")))
    fb_h = (scores.where(F.col("cohesion") < 70).join(has_cross, "project_id", "left_anti")
            .select("project_id", F.lit("MEDIUM").alias("priority"), F.lit("Improve Cohesion").alias("title"),
                    F.lit(None).cast("string").alias("target"), F.lit(None).cast("bigint").alias("n")))
    return s1.unionByName(hubs).unionByName(cross).unionByName(fb_c).unionByName(fb_h)
