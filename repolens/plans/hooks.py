"""Plug-in hooks in use: a custom boundary detector (U01), a custom
refactor rule inside the plan (U02) and a score modifier (U03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.operators import detect, references, refactor, rules as RU, score
from repolens.plans.scoring import findings
from repolens.plugins import Registry
from repolens.session import drop_shuffles, materialize


def clean_layers_detector(files, edges, cfg):
    """Example enterprise rule: domain must not import infrastructure,
    controllers must not import controllers."""
    return RU.boundary_violations(edges).withColumn("metric1", F.lit(None).cast("bigint"))


def broken_detector(files, edges, cfg):
    return edges.select("no_such_column")


def cross_region_rule(edges, files, cfg):
    """Files importing from at least ``min_regions`` other top-level dirs get
    a LOW step with one operation per foreign region (impact cohesion +3)."""
    top = lambda c: F.split(F.col(c), "/").getItem(0)
    g = (edges.where(top("src") != top("dst")).groupBy("project_id", "src")
         .agg(F.count_distinct(top("dst")).alias("regions")).where(F.col("regions") >= cfg.get("min_regions", 4)))
    steps = g.select("project_id", F.lit("cross-region").alias("rule"), F.col("src").alias("target"),
                     F.lit("LOW").alias("priority"), F.lit(2).cast("bigint").alias("tier"),
                     F.col("regions").cast("bigint").alias("operations"))
    impacts = steps.select("project_id", "rule", "target", F.lit("cohesion").alias("metric"),
                           F.lit(3).cast("bigint").alias("delta"))
    return steps, impacts


def cap_coupling(parts):
    return parts.withColumn("coupling", F.least(F.col("coupling"), F.lit(90)).cast("bigint"))


def registry() -> Registry:
    r = Registry()
    r.register_detector("clean-layers", clean_layers_detector)
    r.register_detector("broken", broken_detector)
    r.register_rule("cross-region", cross_region_rule)
    r.register_score_modifier("cap-coupling", cap_coupling)
    return r


def q_custom_detector(spark, base):
    e, f = adapters.part_graph(spark, base)
    extra = registry().run_detectors(f, e)
    return detect.detect(None, e, extra=extra).select("project_id", "name", "severity", "location", "metric1")


def q_plan_with_rule(spark, base):
    e, f = adapters.supplier_graph(spark, base)
    e, f = materialize(references.internal_edges(e)), materialize(f)  # every rule reads them
    drop_shuffles(spark)
    st, _ = refactor.steps(e, f, extra=registry().run_rules(e, f, {"min_regions": 4}))
    return refactor.plan_totals(st)


def q_score_modifier(spark, base):
    e, f = adapters.supplier_graph(spark, base)
    e, f = materialize(e), materialize(f)
    return score.score(e, f, findings(e), modifiers=registry().score_modifiers())


QUERIES = {
    "u01_custom_detector": q_custom_detector,
    "u02_plan_with_custom_rule": q_plan_with_rule,
    "u03_score_modifier": q_score_modifier,
}


def _sql():
    from repolens.plans.refactoring import STEPS
    from repolens.plans.scoring import WHOLE_BODY, shotgun_sql, whole
    u01 = O.with_views(O.PART_GRAPH, shotgun_sql() + """,
allp AS (
  SELECT project_id, 'Shotgun Surgery' AS name, 'HIGH' AS severity, location, CAST(metric1 AS BIGINT) AS metric1 FROM shot
  UNION ALL SELECT project_id, 'Domain imports infrastructure', 'CRITICAL', src || ' -> ' || dst, CAST(NULL AS BIGINT) FROM edges
  WHERE contains(src, 'src/domain') AND contains(dst, 'src/infrastructure')
  UNION ALL SELECT project_id, 'Controller imports controller', 'MEDIUM', src || ' -> ' || dst, CAST(NULL AS BIGINT) FROM edges
  WHERE (contains(src, 'controller') OR contains(src, 'handler')) AND (contains(dst, 'controller') OR contains(dst, 'handler'))
    AND src <> dst)
SELECT * FROM allp""")
    top = "string_split({c}, '/')[1]"
    u02 = O.with_views(O.SUPPLIER_GRAPH, STEPS + f""",
cr AS (SELECT project_id, src, count(DISTINCT {top.format(c='dst')}) AS regions FROM edges
       WHERE {top.format(c='src')} <> {top.format(c='dst')} GROUP BY 1, 2 HAVING count(DISTINCT {top.format(c='dst')}) >= 4),
st2 AS (SELECT * FROM st UNION ALL SELECT project_id, 'cross-region', src, 'LOW', 2, CAST(regions AS BIGINT) FROM cr)
SELECT project_id, CAST(count(*) AS BIGINT) AS steps, CAST(sum(operations) AS BIGINT) AS total_operations,
       CAST(sum(CASE WHEN tier = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tier1_steps,
       CAST(sum(CASE WHEN tier = 2 THEN 1 ELSE 0 END) AS BIGINT) AS tier2_steps FROM st2 GROUP BY 1""")
    body = WHOLE_BODY
    assert body.rstrip().endswith("FROM p)")
    body = body.rstrip()[:-len("FROM p)")] + "FROM (SELECT * REPLACE (CAST(least(coupling, 90) AS BIGINT) AS coupling) FROM p) p)"
    u03 = whole(body + "\nSELECT * FROM score")
    return {"u01_custom_detector": u01, "u02_plan_with_custom_rule": u02, "u03_score_modifier": u03}


SQL = _sql()
