"""Import cycles on the part graph (D3): J08 components and A02 findings."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.operators import cycles as C
from repolens.operators import detect as A


def q_members(spark, base):
    e, _ = adapters.part_graph(spark, base)
    return C.scc_members(e)


def q_cycles(spark, base):
    return C.cycles(q_members(spark, base))


def q_circular(spark, base):
    return A.circular_dependencies(q_members(spark, base)).select(
        "project_id", "name", "severity", "location", "metric1")


def q_cycles_dense(spark, base):
    e, _ = adapters.supplier_graph(spark, base)
    return C.cycles(C.scc_members(e))


QUERIES = {
    "j08_cycles_supplier_graph": q_cycles_dense,
    "j08_cycle_members": q_members,
    "j08_cycles": q_cycles,
    "a02_circular_dependencies": q_circular,
}

SCC_SQL = """e AS (SELECT DISTINCT project_id, src, dst FROM edges WHERE src <> dst),
reach(project_id, a, b) AS (
  SELECT project_id, src, dst FROM e
  UNION
  SELECT r.project_id, r.a, e.dst FROM reach r JOIN e ON e.project_id = r.project_id AND e.src = r.b),
mutual AS (SELECT x.project_id, x.a, x.b FROM reach x
           JOIN reach y ON x.project_id = y.project_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
sccm AS (SELECT project_id, a AS path, least(a, min(b)) AS scc_id FROM mutual GROUP BY project_id, a),
loops AS (SELECT DISTINCT project_id, src AS path FROM edges WHERE src = dst),
members AS (
  SELECT project_id, scc_id, path FROM sccm
  UNION ALL
  SELECT project_id, path, path FROM loops
  WHERE NOT EXISTS (SELECT 1 FROM sccm WHERE sccm.project_id = loops.project_id AND sccm.path = loops.path))"""


def _rec(body: str) -> str:
    return "WITH RECURSIVE " + O.PART_GRAPH + ",\n" + SCC_SQL + "\n" + body


SQL = {
    "j08_cycles_supplier_graph": "WITH RECURSIVE " + O.SUPPLIER_GRAPH + ",\n" + SCC_SQL
    + "\nSELECT project_id, scc_id, CAST(count(*) AS BIGINT) AS size FROM members GROUP BY 1, 2",
    "j08_cycle_members": _rec("SELECT * FROM members"),
    "j08_cycles": _rec("SELECT project_id, scc_id, CAST(count(*) AS BIGINT) AS size FROM members GROUP BY 1, 2"),
    "a02_circular_dependencies": _rec(f"""SELECT project_id, 'Circular Dependency' AS name, 'HIGH' AS severity,
       string_agg(path, ' -> ' ORDER BY path) AS location, CAST(count(*) AS BIGINT) AS metric1
FROM members GROUP BY project_id, scc_id HAVING bool_and({O.own_file('path')})"""),
}
