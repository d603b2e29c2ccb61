"""Path functions and small graph joins on the part graph (D3):
P03, P06 (first directory / second level), P08, J07, J12, J13."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.functions import paths as P
from repolens.operators import graph as G
from repolens.operators.refactor import HUB_MIN_FAN_IN


def _pg(spark, base):
    return adapters.part_graph(spark, base)


def q_modules(spark, base):
    _, f = _pg(spark, base)
    return f.select("project_id", "path", P.module_top(F.col("path")).alias("module_top"),
                    P.module_second_level(F.col("path")).alias("module_group"),
                    P.is_own_file(F.col("path")).alias("own"),
                    P.relativize(F.col("path"), "Brand1").alias("relative"))


def _hubs(e):
    return (e.groupBy("project_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= 3).select("project_id", "path"))


def q_file_dependencies(spark, base):
    e, _ = _pg(spark, base)
    return G.file_dependencies(e, _hubs(e))


def q_affected(spark, base):
    e, f = _pg(spark, base)
    changed = f.where(F.col("path").contains("/services/"))
    return G.affected_scope(changed, e)


def q_dot_variants(spark, base):
    _, f = _pg(spark, base)
    return G.dot_variants(f.where(F.col("path").endswith(".py")))


QUERIES = {
    "p06_modules": q_modules,
    "j07_file_dependencies": q_file_dependencies,
    "j12_affected_scope": q_affected,
    "j13_dot_variants": q_dot_variants,
}

_parts = "string_split(path, '/')"
_roots = O.in_list(P.SOURCE_ROOTS)
HUBS = "hubs AS (SELECT project_id, dst AS path FROM edges GROUP BY 1, 2 HAVING count(*) >= 3)"

SQL = {
    "p06_modules": O.with_views(O.PART_GRAPH, f"""x AS (SELECT 1)
SELECT project_id, path, {O.module_top('path')} AS module_top,
       CASE WHEN len({_parts}) < 2 THEN 'root' WHEN {_parts}[1] IN {_roots} AND len({_parts}) > 2 THEN {_parts}[2]
            ELSE {_parts}[1] END AS module_group,
       {O.own_file('path')} AS own,
       CASE WHEN starts_with(path, 'Brand1/') THEN substring(path, 8) ELSE path END AS relative
FROM files"""),
    "j07_file_dependencies": O.with_views(O.PART_GRAPH, HUBS + """
SELECT e.project_id, e.src AS path, 'imports' AS direction, e.dst AS other FROM edges e
JOIN hubs h ON h.project_id = e.project_id AND h.path = e.src
UNION ALL
SELECT e.project_id, e.dst, 'imported_by', e.src FROM edges e JOIN hubs h ON h.project_id = e.project_id AND h.path = e.dst"""),
    "j12_affected_scope": O.with_views(O.PART_GRAPH, """ch AS (SELECT DISTINCT project_id, path FROM files WHERE contains(path, '/services/'))
SELECT project_id, path, 'changed' AS reason FROM ch
UNION ALL
SELECT DISTINCT e.project_id, e.src, 'importer' FROM edges e JOIN ch ON ch.project_id = e.project_id AND ch.path = e.dst
WHERE NOT EXISTS (SELECT 1 FROM ch c2 WHERE c2.project_id = e.project_id AND c2.path = e.src)"""),
    "j13_dot_variants": O.with_views(O.PART_GRAPH, """py AS (SELECT project_id, path FROM files WHERE ends_with(path, '.py'))
SELECT DISTINCT project_id, path, variant FROM (
  SELECT project_id, path, replace(regexp_replace(path, '\\.[^.]+$', ''), '/', '.') AS variant FROM py
  UNION ALL
  SELECT project_id, path, '.' || regexp_replace(regexp_extract(path, '[^/]*$', 0), '\\.[^.]+$', '') FROM py) t"""),
}
