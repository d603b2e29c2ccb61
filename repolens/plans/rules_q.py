"""Rule checks on the supplier graph (D3p) and the part graph (D3):
J09, J10, B09, B10.  The rule set is configuration (a literal table)."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.operators import cycles as C
from repolens.operators import detect as A
from repolens.operators import rules as RU
from repolens.operators import score as SC
from repolens.plans.graphs import SCC_SQL
from repolens.plans.scoring import WHOLE_BODY as ANALYSIS
from repolens.session import materialize
from repolens.sources.store import rules_df

# Fixed rule set used by the registered checks.
RULES = {
    "quality_gates": {"min_overall_score": 70, "max_critical_anti_patterns": 0, "max_high_anti_patterns": 10},
    "boundaries": {"allow_circular_dependencies": False,
                   "banned_imports": ["EUROPE/NATION_3/", {"from": "/api/", "to": "/entities/"}]},
}


def _analysis(spark, base):
    e, f = adapters.supplier_graph(spark, base)
    e, f = materialize(e), materialize(f)
    ap = A.shotgun_surgery(e).unionByName(A.circular_dependencies(C.scc_members(e)))
    return e, f, ap, SC.score(e, f, ap)


def q_banned(spark, base):
    e, _ = adapters.supplier_graph(spark, base)
    return RU.banned_references(e, rules_df(spark, RULES))


def q_boundaries(spark, base):
    e, _ = adapters.part_graph(spark, base)
    return RU.boundary_violations(e, rules_df(spark, RULES))


def q_gates(spark, base):
    e, f, ap, sc = _analysis(spark, base)
    return RU.quality_gates(sc, ap, rules_df(spark, RULES))


def q_validate(spark, base):
    e, f, ap, sc = _analysis(spark, base)
    return RU.validate(sc, ap, e, rules_df(spark, RULES))


def q_verdict(spark, base):
    e, f, ap, sc = _analysis(spark, base)
    return RU.verdict(sc, RU.validate(sc, ap, e, rules_df(spark, RULES)))


QUERIES = {
    "j10_banned_references": q_banned,
    "j09_boundary_violations": q_boundaries,
    "b09_quality_gates": q_gates,
    "b10_validate": q_validate,
    "b10_verdict": q_verdict,
}

BANNED = """ban AS (
  SELECT project_id, 'error' AS level, 'boundaries.banned_imports' AS rule,
         printf('%s imports from %s', src, 'EUROPE/NATION_3/') AS message,
         dst AS actual, 'without EUROPE/NATION_3/' AS expected
  FROM edges WHERE contains(dst, 'EUROPE/NATION_3/'))"""


def _thr(x):
    return str(int(x)) if float(x).is_integer() else repr(float(x))


_qg = RULES["quality_gates"]
GATES = f"""cnt AS (SELECT project_id, sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS n_critical,
                       sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS n_high FROM aps GROUP BY 1),
sc2 AS (SELECT s.project_id, s.overall, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high
        FROM score s LEFT JOIN cnt ON cnt.project_id = s.project_id),
gates AS (
  SELECT project_id, 'error' AS level, 'quality_gates.min_overall_score' AS rule,
         'overall score ' || CAST(overall AS VARCHAR) || ', at least {_thr(_qg['min_overall_score'])}' AS message,
         CAST(overall AS VARCHAR) AS actual, '{_thr(_qg['min_overall_score'])}' AS expected
  FROM sc2 WHERE overall < {_qg['min_overall_score']}
  UNION ALL
  SELECT project_id, 'error', 'quality_gates.max_critical_anti_patterns',
         'critical findings ' || CAST(n_critical AS VARCHAR) || ', at most {_thr(_qg['max_critical_anti_patterns'])}',
         CAST(n_critical AS VARCHAR), '{_thr(_qg['max_critical_anti_patterns'])}'
  FROM sc2 WHERE n_critical > {_qg['max_critical_anti_patterns']}
  UNION ALL
  SELECT project_id, 'warning', 'quality_gates.max_high_anti_patterns',
         'high findings ' || CAST(n_high AS VARCHAR) || ', at most {_thr(_qg['max_high_anti_patterns'])}',
         CAST(n_high AS VARCHAR), '{_thr(_qg['max_high_anti_patterns'])}'
  FROM sc2 WHERE n_high > {_qg['max_high_anti_patterns']}),
cyr AS (SELECT project_id, 'error' AS level, 'boundaries.allow_circular_dependencies' AS rule,
               printf('cycles %d, none allowed', count(*)) AS message,
               CAST(count(*) AS VARCHAR) AS actual, '0' AS expected
        FROM cyc GROUP BY project_id),
{BANNED},
viol AS (SELECT * FROM gates UNION ALL SELECT * FROM cyr UNION ALL SELECT * FROM ban)"""


def _rec(body):
    return "WITH RECURSIVE " + O.SUPPLIER_GRAPH + ",\n" + SCC_SQL + ",\n" + ANALYSIS + ",\n" + GATES + "\n" + body


SQL = {
    "j10_banned_references": O.with_views(O.SUPPLIER_GRAPH, BANNED + "\nSELECT * FROM ban"),
    "j09_boundary_violations": O.with_views(O.PART_GRAPH, """bv AS (SELECT 1)
SELECT project_id, 'Boundary /api/ -> /entities/' AS name, 'HIGH' AS severity, src || ' -> ' || dst AS location
FROM edges WHERE contains(src, '/api/') AND contains(dst, '/entities/')
UNION ALL
SELECT project_id, 'Domain imports infrastructure', 'CRITICAL', src || ' -> ' || dst FROM edges
WHERE contains(src, 'src/domain') AND contains(dst, 'src/infrastructure')
UNION ALL
SELECT project_id, 'Controller imports controller', 'MEDIUM', src || ' -> ' || dst FROM edges
WHERE (contains(src, 'controller') OR contains(src, 'handler')) AND (contains(dst, 'controller') OR contains(dst, 'handler'))
  AND src <> dst"""),
    "b09_quality_gates": _rec("SELECT * FROM gates"),
    "b10_validate": _rec("SELECT * FROM viol"),
    "b10_verdict": _rec("""SELECT s.project_id, coalesce(sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END), 0) = 0 AS success,
       CAST(coalesce(sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors,
       CAST(coalesce(sum(CASE WHEN level = 'warning' THEN 1 ELSE 0 END), 0) AS BIGINT) AS warnings
FROM (SELECT DISTINCT project_id FROM score) s LEFT JOIN viol v ON v.project_id = s.project_id GROUP BY s.project_id"""),
}
