"""File roles and extended layers (P05) on the part graph's files."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.functions import roles as RO


def q_roles(spark, base):
    _, f = adapters.part_graph(spark, base)
    return RO.with_roles(f)


QUERIES = {"p05_roles": q_roles}


def _layer_sql(low):
    pkg = f"regexp_extract({low}, 'packages/([^/]+)', 1)"
    parts = [f"WHEN {pkg} IN {O.in_list(names)} THEN '{layer}'" for names, layer in RO.PACKAGE_LAYERS]
    parts.append(f"WHEN {pkg} <> '' THEN 'Package'")
    parts += [f"WHEN {RO.to_sql(rule, low)} THEN '{layer}'" for layer, rule in RO.LAYER_RULES]
    return "CASE " + " ".join(parts) + " ELSE 'Other' END"


_low = "lower(path)"
SQL = {"p05_roles": O.with_views(O.PART_GRAPH, f"""x AS (SELECT 1)
SELECT project_id, path, {RO.to_sql(RO.TEST, _low)} AS is_test, {RO.to_sql(RO.ENTITY, _low)} AS is_entity,
       {RO.to_sql(RO.CONTROLLER, _low)} AS is_controller, {RO.to_sql(RO.SERVICE, _low)} AS is_service,
       {_layer_sql(_low)} AS ext_layer FROM files""")}
