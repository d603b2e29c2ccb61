"""Refactoring candidates and plans.

Hubs, cross-boundary files and the plan run on the supplier graph (D3p);
barrels and dead files on the part graph (D3), which has index files and
isolated parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.operators import references, refactor as RF, score
from repolens.operators.refactor import ENTRY_POINTS, HUB_BARRELS, OPTIMIZER_BARRELS
from repolens.plans.scoring import findings, whole
from repolens.session import materialize


def _sup(spark, base):
    e, f = adapters.supplier_graph(spark, base)
    return materialize(references.internal_edges(e)), materialize(f)


def _parts(spark, base):
    e, f = adapters.part_graph(spark, base)
    return materialize(references.internal_edges(e)), materialize(f)


def q_hub_groups(spark, base):
    return RF.hub_groups(_sup(spark, base)[0])


def q_hub_splits(spark, base):
    return RF.hub_splits(_sup(spark, base)[0])


def q_barrels(spark, base):
    return RF.barrel_candidates(_parts(spark, base)[0])


def q_cross(spark, base):
    return RF.cross_boundary(_sup(spark, base)[0])


def q_dead(spark, base):
    e, f = _parts(spark, base)
    return RF.dead_files(f, e)


def _steps(spark, base):
    e, f = _sup(spark, base)
    return RF.steps(e, f)


def q_plan(spark, base):
    return RF.plan(_steps(spark, base)[0])


def q_plan_totals(spark, base):
    return RF.plan_totals(_steps(spark, base)[0])


def q_estimate(spark, base):
    e, f = _sup(spark, base)
    sc = score.score(e, f, findings(e))
    return RF.estimate_after(sc, RF.steps(e, f)[1])


def q_suggestions(spark, base):
    e, f = adapters.supplier_graph(spark, base)
    e, f = materialize(e), materialize(f)
    ap = materialize(findings(e))
    return RF.suggestions(ap, e, score.score(e, f, ap))


QUERIES = {
    "r08_suggestions": q_suggestions,
    "r01_hub_groups": q_hub_groups,
    "r01_hub_splits": q_hub_splits,
    "r02_barrel_candidates": q_barrels,
    "r03_cross_boundary": q_cross,
    "r05_dead_files": q_dead,
    "r06_plan": q_plan,
    "r06_plan_totals": q_plan_totals,
    "b08_estimate_after": q_estimate,
}

# ------------------------------------------------------------------ SQL ----
BN = O.basename
PD = "regexp_extract({c}, '^(.*)/[^/]*$', 1)"


def pdir(c):
    return PD.format(c=c)


def _parts_sql(c):
    return f"CASE WHEN contains({c}, '/') THEN string_split({c}, '/') ELSE string_split({c}, '.') END"


HUB = f"""fan AS (SELECT project_id, dst AS hub, count(*) AS fan_in FROM edges GROUP BY 1, 2),
hubs AS (SELECT * FROM fan WHERE fan_in >= {RF.HUB_MIN_FAN_IN} AND {BN('hub')} NOT IN {O.in_list(HUB_BARRELS['typescript'])}
         AND NOT (contains(lower(hub), 'types') OR contains(lower(hub), 'interface'))),
dep AS (SELECT project_id, dst AS hub,
               CASE WHEN len({_parts_sql('src')}) >= 2 THEN {_parts_sql('src')}[len({_parts_sql('src')}) - 1] ELSE 'core' END AS grp
        FROM edges),
hg AS (SELECT d.project_id, d.hub, d.grp AS "group", CAST(count(*) AS BIGINT) AS dependents
       FROM dep d JOIN hubs h ON h.project_id = d.project_id AND h.hub = d.hub GROUP BY 1, 2, 3),
hs AS (SELECT project_id, hub, CAST(count(*) AS BIGINT) AS groups, CAST(sum(dependents) AS BIGINT) AS fan_in,
              'CRITICAL' AS priority, CAST(count(*) + sum(dependents) + 1 AS BIGINT) AS operations
       FROM hg GROUP BY 1, 2 HAVING count(*) >= 2)"""

CROSS = f"""cg AS (SELECT project_id, src, CAST(count(DISTINCT dst) AS BIGINT) AS targets,
              CAST(count(DISTINCT CASE WHEN {pdir('dst')} <> {pdir('src')} THEN {pdir('dst')} END) AS BIGINT) AS dirs
       FROM edges GROUP BY 1, 2),
cb AS (SELECT *, 'HIGH' AS priority FROM cg WHERE dirs >= {RF.CROSS_MIN_DIRS} AND NOT contains(src, '.test.'))"""

BARREL = f"""bout AS (SELECT project_id, src, dst FROM edges WHERE {BN('src')} IN {O.in_list(OPTIMIZER_BARRELS)}),
bst AS (SELECT project_id, src AS barrel, count(*) AS outgoing,
               sum(CASE WHEN {pdir('dst')} = {pdir('src')} THEN 1 ELSE 0 END) AS siblings
        FROM bout GROUP BY 1, 2 HAVING count(*) >= {RF.BARREL_MIN_OUT}),
cons AS (SELECT b.project_id, b.src AS barrel, count(DISTINCT c.src) AS consumers
         FROM edges c JOIN bout b ON b.project_id = c.project_id AND b.dst = c.dst
         WHERE EXISTS (SELECT 1 FROM edges x WHERE x.project_id = c.project_id AND x.src = c.src AND x.dst = b.src)
         GROUP BY 1, 2),
bc AS (SELECT bst.project_id, bst.barrel, CAST(outgoing AS BIGINT) AS outgoing, CAST(siblings AS BIGINT) AS siblings,
              CAST(coalesce(consumers, 0) AS BIGINT) AS consumers,
              CAST(coalesce(consumers, 0) + CASE WHEN siblings > {RF.BARREL_SIBLING_EXPORTS} THEN 1 ELSE 0 END AS BIGINT) AS operations,
              CASE WHEN outgoing >= {RF.BARREL_HIGH_OUT} THEN 'HIGH' ELSE 'MEDIUM' END AS priority
       FROM bst LEFT JOIN cons ON cons.project_id = bst.project_id AND cons.barrel = bst.barrel)"""

_nm = BN("f.path")
DEAD = f"""fl AS (SELECT DISTINCT project_id, path FROM files WHERE contains(path, '/')),
tg AS (SELECT DISTINCT project_id, dst AS path FROM edges),
sr AS (SELECT DISTINCT project_id, src AS path FROM edges),
dv AS (SELECT project_id, path, replace(regexp_replace(path, '\\.[^.]+$', ''), '/', '.') AS variant FROM fl
       UNION ALL SELECT project_id, path, '.' || regexp_replace({BN('path')}, '\\.[^.]+$', '') FROM fl),
byv AS (SELECT DISTINCT dv.project_id, dv.path FROM dv JOIN tg ON tg.project_id = dv.project_id AND tg.path = dv.variant),
dead0 AS (SELECT f.project_id, f.path FROM fl f
          WHERE NOT ({_nm} IN {O.in_list(ENTRY_POINTS)} OR starts_with({_nm}, '__') OR starts_with({_nm}, '.')
                     OR ends_with({_nm}, '.test.ts') OR ends_with({_nm}, '.spec.ts') OR ends_with({_nm}, '_test.py')
                     OR ends_with({_nm}, '.test.py') OR starts_with({_nm}, 'test_'))
            AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.project_id = f.project_id AND tg.path = f.path)
            AND NOT EXISTS (SELECT 1 FROM byv WHERE byv.project_id = f.project_id AND byv.path = f.path)
            AND NOT EXISTS (SELECT 1 FROM sr WHERE sr.project_id = f.project_id AND sr.path = f.path)),
dead AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY project_id) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM dead0)"""

STEPS = HUB + ",\n" + BARREL + ",\n" + CROSS + ",\n" + DEAD + """,
st AS (
  SELECT project_id, 'hub-splitter' AS rule, hub AS target, priority, CAST(1 AS BIGINT) AS tier, operations FROM hs
  UNION ALL SELECT project_id, 'barrel-optimizer', barrel, priority, 1, operations FROM bc
  UNION ALL SELECT project_id, 'import-organizer', src, priority, 1, 2 FROM cb
  UNION ALL SELECT project_id, 'dead-code-detector', '*', min(priority), 1, count(*) FROM dead GROUP BY project_id),
imp AS (
  SELECT project_id, rule, target, 'coupling' AS metric, 15 AS delta FROM st WHERE rule = 'hub-splitter'
  UNION ALL SELECT project_id, rule, target, 'coupling', 10 FROM st WHERE rule = 'barrel-optimizer'
  UNION ALL SELECT project_id, rule, target, 'layering', 5 FROM st WHERE rule = 'barrel-optimizer'
  UNION ALL SELECT project_id, rule, target, 'cohesion', 5 FROM st WHERE rule = 'import-organizer'
  UNION ALL SELECT project_id, rule, target, 'coupling', 5 FROM st WHERE rule = 'import-organizer'
  UNION ALL SELECT project_id, rule, target, 'modularity', 5 FROM st WHERE rule = 'dead-code-detector')"""

_PR = "CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


def _est_sql():
    from repolens.plans.scoring import WHOLE_BODY
    cols = []
    for m in ["modularity", "coupling", "cohesion", "layering"]:
        cols.append(f"CAST(CASE WHEN d_{m} IS NULL THEN {m} ELSE least(95, greatest({m}, least(95, {m} + d_{m}))) END"
                    f" AS BIGINT) AS {m}_after")
    piv = ", ".join(f"max(CASE WHEN metric = '{m}' THEN d END) AS d_{m}"
                    for m in ["modularity", "coupling", "cohesion", "layering"])
    return (WHOLE_BODY + ",\n" + STEPS + f""",
best AS (SELECT project_id, metric, max(delta) AS d FROM imp GROUP BY 1, 2),
wide AS (SELECT project_id, {piv} FROM best GROUP BY 1),
ea AS (SELECT s.project_id, {', '.join(cols)} FROM score s LEFT JOIN wide w ON w.project_id = s.project_id)
SELECT *, CAST(least(floor(modularity_after * {O.d(0.4)} + coupling_after * {O.d(0.25)} + cohesion_after * {O.d(0.2)}
       + layering_after * {O.d(0.15)} + 0.5), 100) AS BIGINT) AS overall_after FROM ea""")


_S, _P = O.SUPPLIER_GRAPH, O.PART_GRAPH
SQL = {
    "r01_hub_groups": O.with_views(_S, HUB + "\nSELECT * FROM hg"),
    "r01_hub_splits": O.with_views(_S, HUB + "\nSELECT * FROM hs"),
    "r02_barrel_candidates": O.with_views(_P, BARREL + "\nSELECT * FROM bc WHERE operations > 0"),
    "r03_cross_boundary": O.with_views(_S, CROSS + "\nSELECT * FROM cb"),
    "r05_dead_files": O.with_views(_P, DEAD + "\nSELECT * FROM dead"),
    "r06_plan": O.with_views(_S, STEPS + f"""
SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {_PR}, rule, target) AS BIGINT) AS step_id FROM st"""),
    "r06_plan_totals": O.with_views(_S, STEPS + """
SELECT project_id, CAST(count(*) AS BIGINT) AS steps, CAST(sum(operations) AS BIGINT) AS total_operations,
       CAST(sum(CASE WHEN tier = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tier1_steps,
       CAST(sum(CASE WHEN tier = 2 THEN 1 ELSE 0 END) AS BIGINT) AS tier2_steps FROM st GROUP BY 1"""),
    "b08_estimate_after": whole(_est_sql()),
}


def _sugg_sql():
    from repolens.plans.scoring import WHOLE_BODY
    return WHOLE_BODY + f""",
s1 AS (SELECT project_id, 'HIGH' AS priority, 'Shotgun Surgery' AS title, location AS target, CAST(NULL AS BIGINT) AS n FROM shot
       UNION ALL SELECT project_id, 'HIGH', 'Circular Dependency', string_agg(path, ' -> ' ORDER BY path), CAST(NULL AS BIGINT)
       FROM members GROUP BY project_id, scc_id),
en AS (SELECT project_id, src AS path FROM edges UNION ALL SELECT project_id, dst FROM edges),
dg AS (SELECT project_id, path, count(*) AS n FROM en GROUP BY 1, 2 HAVING count(*) >= {RF.SUGGEST_HUB_MIN}),
hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, path) AS r FROM dg) t
       WHERE r <= 3 AND {BN('path')} NOT IN {O.in_list(RF.SUGGEST_BARRELS)}),
s2 AS (SELECT project_id, 'HIGH' AS priority, 'Hub File: ' || {BN('path')} AS title, path AS target, CAST(n AS BIGINT) AS n FROM hb),
cbx AS (SELECT project_id, src, count(DISTINCT {pdir('dst')}) AS n FROM edges WHERE {pdir('src')} <> {pdir('dst')}
        GROUP BY 1, 2 HAVING count(DISTINCT {pdir('dst')}) >= {RF.SUGGEST_CROSS_MIN}),
s3 AS (SELECT project_id, 'MEDIUM' AS priority, 'Cross-boundary: ' || {BN('src')} AS title, src AS target, CAST(n AS BIGINT) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, src) AS r FROM cbx) t WHERE r <= 2),
s4 AS (SELECT project_id, 'HIGH' AS priority, 'Reduce Coupling' AS title, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS n
       FROM score WHERE coupling < 70 AND project_id NOT IN (SELECT project_id FROM s2)),
s5 AS (SELECT project_id, 'MEDIUM' AS priority, 'Improve Cohesion' AS title, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BIGINT) AS n
       FROM score WHERE cohesion < 70 AND project_id NOT IN (SELECT project_id FROM s3))
SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5"""


SQL["r08_suggestions"] = whole(_sugg_sql())
