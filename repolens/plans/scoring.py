"""Minimum slice: supplier graph (D3p) -> edges, degrees -> detectors -> score.

Project = customer region + order year; files = suppliers.  The flagship
query is ``b05_score``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.operators import cycles, detect, graph, score
from repolens.plans.graphs import SCC_SQL
from repolens.session import materialize
from repolens.operators.score import BARREL_FILES, DEFAULT_THRESHOLDS as TH, DEFAULT_WEIGHTS as W


def _graph(spark, base):
    """Supplier graph, written once: it feeds four to five plan branches."""
    e, f = adapters.supplier_graph(spark, base)
    return materialize(e), materialize(f)


def findings(edges):
    """All findings that an edge-only project can have: files that import too
    many others, and import cycles (leaky abstractions need file contents)."""
    return detect.shotgun_surgery(edges).unionByName(detect.circular_dependencies(cycles.scc_members(edges)))


def q_score(spark, base):
    edges, files = _graph(spark, base)
    return score.score(edges, files, findings(edges))


def q_score_components(spark, base):
    return score.score_components(q_score(spark, base))


def q_modularity(spark, base):
    e, f = _graph(spark, base)
    return score.modularity(e, f)


def q_coupling(spark, base):
    e, f = _graph(spark, base)
    return score.coupling(e, f)


def q_cohesion(spark, base):
    e, f = _graph(spark, base)
    return score.cohesion(e, f)


def q_layering(spark, base):
    e, f = _graph(spark, base)
    return score.layering(findings(e), f)


def q_nodes(spark, base):
    e, _ = _graph(spark, base)
    return graph.nodes(e)


def q_degrees(spark, base):
    e, f = _graph(spark, base)
    return graph.degrees(e, f)


def q_shotgun(spark, base):
    e, _ = _graph(spark, base)
    return detect.shotgun_surgery(e).select("project_id", "location", "metric1")


def q_shotgun_in(spark, base):
    e, _ = _graph(spark, base)
    return detect.shotgun_surgery(e, direction="in").select("project_id", "location", "metric1")


def q_edges(spark, base):
    e, _ = _graph(spark, base)
    return graph.build_edges(e)


QUERIES = {
    "b05_score": q_score,
    "b05_score_components": q_score_components,
    "b01_modularity": q_modularity,
    "b02_coupling": q_coupling,
    "b03_cohesion": q_cohesion,
    "b04_layering": q_layering,
    "j05_edges": q_edges,
    "j05_nodes": q_nodes,
    "j06_degrees": q_degrees,
    "a05_shotgun_surgery": q_shotgun,
    "a05_shotgun_surgery_in": q_shotgun_in,
}

# ------------------------------------------------------------------ SQL ----
_ex, _gd = TH["modularity_excellent"], TH["modularity_good"]
MOD_SQL = ("CASE WHEN files = 0 THEN 50 ELSE " + O.ladder_lt(
    "(edges / files)", [(O.d(_ex), 100), (O.d((_ex + _gd) / 2), 85), (O.d(_gd), 70),
                        (O.d(_gd * 1.5), 50)], 30) + " END")
_cx, _cg = TH["coupling_excellent"], TH["coupling_good"]
COUP_SQL = ("CASE WHEN files <= 1 THEN 50 ELSE " + O.ladder_lt(
    "(max_degree / greatest(files - 1, 1))",
    [(O.d(_cx), 100), (O.d((_cx + _cg) / 2), 85), (O.d(_cg), 75), (O.d(_cg * 1.5), 65),
     (O.d(_cg * 2), 50), (O.d(_cg * 2.5), 35)], 20) + " END")
_hx, _hg = TH["cohesion_excellent"], TH["cohesion_good"]
COH_SQL = ("CASE WHEN edges = 0 THEN 50 ELSE " + O.ladder_gt(
    "(internal_edges / edges)",
    [(O.d(_hx), 100), (O.d((_hx + _hg) / 2), 85), (O.d(_hg), 75), (O.d(_hg * 0.7), 65),
     (O.d(_hg * 0.3), 50)], 30) + " END")
LAY_SQL = ("CASE WHEN lv = 0 THEN 100 ELSE " + O.ladder_lt(
    "(lv / greatest(CASE WHEN files = 0 THEN 50 ELSE files END, 10))",
    [(O.d(0.05), 95), (O.d(0.15), 85), (O.d(0.25), 70), (O.d(0.40), 50), (O.d(0.60), 35)], 20)
    + " END")

_top = "CASE WHEN len(string_split({c}, '/')) > 1 THEN string_split({c}, '/')[1] ELSE '' END"
INTERNAL_SQL = ("((len(string_split(src, '/')) <= 1 AND len(string_split(dst, '/')) <= 1) OR "
                + _top.format(c="src") + " = " + _top.format(c="dst") + ")")
NON_BARREL = (f"{O.basename('src')} NOT IN {O.in_list(BARREL_FILES)} AND "
              f"{O.basename('dst')} NOT IN {O.in_list(BARREL_FILES)}")


def shotgun_sql(direction: str = "out", threshold: int = detect.SHOTGUN_THRESHOLD) -> str:
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    name = O.basename("path")
    base = (f"{name} IN {O.in_list(detect.SHOTGUN_BASE_FILES)} OR "
            + " OR ".join(f"ends_with({name}, '{s}')" for s in detect.SHOTGUN_BASE_SUFFIXES))
    excl = " OR ".join(f"contains(path, '{d}')" for d in detect.SHOTGUN_EXCLUDED_DIRS)
    return f"""shot AS (
  SELECT project_id, path AS location, degree AS metric1 FROM (
    SELECT project_id, {key} AS path, count(DISTINCT {other}) AS degree FROM edges GROUP BY 1, 2) t
  WHERE {O.own_file('path')} AND NOT ({base}) AND NOT ({excl}) AND degree >= {threshold})"""


METRICS_SQL = f"""es AS (
  SELECT project_id, count(*) AS edges,
         sum(CASE WHEN {INTERNAL_SQL} THEN 1 ELSE 0 END) AS internal_edges
  FROM edges GROUP BY project_id),
ends AS (
  SELECT project_id, src AS node FROM edges WHERE {NON_BARREL}
  UNION ALL SELECT project_id, dst AS node FROM edges WHERE {NON_BARREL}),
md AS (SELECT project_id, max(deg) AS max_degree
       FROM (SELECT project_id, node, count(*) AS deg FROM ends GROUP BY 1, 2) t GROUP BY 1),
fs AS (SELECT project_id, count(DISTINCT path) AS files FROM files GROUP BY 1),
m AS (
  SELECT coalesce(fs.project_id, es.project_id) AS project_id,
         coalesce(files, 0) AS files, coalesce(edges, 0) AS edges,
         coalesce(internal_edges, 0) AS internal_edges, coalesce(max_degree, 0) AS max_degree
  FROM fs FULL JOIN es ON fs.project_id = es.project_id
  LEFT JOIN md ON md.project_id = coalesce(fs.project_id, es.project_id))"""

SCORE_BODY = f"""{shotgun_sql()},
lvs AS (SELECT project_id, count(*) AS lv FROM shot GROUP BY 1),
{METRICS_SQL},
p AS (
  SELECT m.project_id, files, edges, {MOD_SQL} AS modularity, {COUP_SQL} AS coupling,
         {COH_SQL} AS cohesion, {LAY_SQL.replace('lv', 'coalesce(lvs.lv, 0)')} AS layering
  FROM m LEFT JOIN lvs ON lvs.project_id = m.project_id),
score AS (
  SELECT project_id, CAST(files AS BIGINT) AS files, CAST(edges AS BIGINT) AS edges,
         CAST(modularity AS BIGINT) AS modularity, CAST(coupling AS BIGINT) AS coupling,
         CAST(cohesion AS BIGINT) AS cohesion, CAST(layering AS BIGINT) AS layering,
         CAST(least(greatest(floor(modularity * {O.d(W['modularity'])} + coupling * {O.d(W['coupling'])}
              + cohesion * {O.d(W['cohesion'])} + layering * {O.d(W['layering'])} + 0.5), 0), 100) AS BIGINT)
           AS overall
  FROM p)"""

_V = O.SUPPLIER_GRAPH

# with import cycles among the findings (needs graphs.SCC_SQL before it)
FINDINGS = """cyc AS (
  SELECT project_id, scc_id FROM members GROUP BY 1, 2),
aps AS (SELECT project_id, 'Shotgun Surgery' AS name, 'HIGH' AS severity FROM shot
        UNION ALL SELECT project_id, 'Circular Dependency', 'HIGH' FROM cyc),
lvs AS (SELECT project_id, count(*) AS lv FROM aps GROUP BY 1)"""
WHOLE_BODY = SCORE_BODY.replace("lvs AS (SELECT project_id, count(*) AS lv FROM shot GROUP BY 1)", FINDINGS)


def whole(body: str) -> str:
    return "WITH RECURSIVE " + _V + ",\n" + SCC_SQL + ",\n" + body


SQL = {
    "b05_score": whole(WHOLE_BODY + "\nSELECT * FROM score"),
    "b05_score_components": whole(WHOLE_BODY + "\n" + " UNION ALL ".join(
        f"SELECT project_id, '{k}' AS component, {k} AS score, {O.d(W[k])} AS weight FROM score"
        for k in ["modularity", "coupling", "cohesion", "layering"])),
    "b01_modularity": O.with_views(_V, METRICS_SQL + f"\nSELECT project_id, CAST({MOD_SQL} AS BIGINT) AS modularity FROM m"),
    "b02_coupling": O.with_views(_V, METRICS_SQL + f"\nSELECT project_id, CAST({COUP_SQL} AS BIGINT) AS coupling FROM m"),
    "b03_cohesion": O.with_views(_V, METRICS_SQL + f"\nSELECT project_id, CAST({COH_SQL} AS BIGINT) AS cohesion FROM m"),
    "b04_layering": whole(shotgun_sql() + ",\n" + FINDINGS + """,
fs AS (SELECT project_id, count(DISTINCT path) AS files FROM files GROUP BY 1),
m AS (SELECT coalesce(fs.project_id, lvs.project_id) AS project_id, coalesce(files, 0) AS files,
             coalesce(lv, 0) AS lv FROM fs FULL JOIN lvs ON fs.project_id = lvs.project_id)
SELECT project_id, CAST(""" + LAY_SQL + " AS BIGINT) AS layering FROM m"),
    "j05_edges": O.with_views(_V, "x AS (SELECT 1)\nSELECT DISTINCT project_id, src, dst, 'import' AS type, "
                              "CAST(1.0 AS DOUBLE) AS weight FROM edges"),
    "j05_nodes": O.with_views(_V, "x AS (SELECT 1)\nSELECT project_id, src AS path FROM edges UNION "
                              "SELECT project_id, dst AS path FROM edges"),
    "j06_degrees": O.with_views(_V, """fi AS (SELECT project_id, dst AS path, count(*) AS n FROM edges GROUP BY 1, 2),
fo AS (SELECT project_id, src AS path, count(*) AS n FROM edges GROUP BY 1, 2)
SELECT f.project_id, f.path, CAST(coalesce(fi.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(fo.n, 0) AS BIGINT) AS fan_out
FROM files f LEFT JOIN fi ON fi.project_id = f.project_id AND fi.path = f.path
LEFT JOIN fo ON fo.project_id = f.project_id AND fo.path = f.path"""),
    "a05_shotgun_surgery": O.with_views(_V, shotgun_sql() + "\nSELECT project_id, location, CAST(metric1 AS BIGINT) AS metric1 FROM shot"),
    "a05_shotgun_surgery_in": O.with_views(_V, shotgun_sql("in") + "\nSELECT project_id, location, CAST(metric1 AS BIGINT) AS metric1 FROM shot"),
}
