"""Module inventory (P06 mode b, C01) on the supplier graph's nodes."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.operators import graph as G
from repolens.operators import modules as M


def q_inventory(spark, base):
    e, _ = adapters.supplier_graph(spark, base)
    return M.module_inventory(G.nodes(e))


QUERIES = {"c01_module_inventory": q_inventory}


def _first(col):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {O.lit(p)}) THEN {i}"
                              for i, (p, _) in enumerate(M.MODULE_PATTERNS, start=1)) + " END"


_parts = "string_split(path, '/')"
_descs = "[" + ", ".join(O.lit(d) for _, d in M.MODULE_PATTERNS) + "]"
_hint = f"regexp_replace({O.basename('path')}, {O.lit(M.HINT_EXT)}, '')"
SQL = {"c01_module_inventory": O.with_views(O.SUPPLIER_GRAPH, f"""nd AS (
  SELECT DISTINCT project_id, src AS path FROM edges UNION SELECT project_id, dst FROM edges),
nm AS (SELECT project_id, path,
              CASE WHEN contains(path, 'node_modules') OR len({_parts}) < 2 OR {_parts}[1] IN {O.in_list(M.TEST_DIRS)} THEN NULL
                   WHEN {_parts}[1] IN {O.in_list(M.SOURCE_ROOTS)} THEN CASE WHEN len({_parts}) > 2 THEN {_parts}[2] ELSE {_parts}[1] END
                   ELSE {_parts}[1] END AS module FROM nd),
nh AS (SELECT *, CASE WHEN {_hint} NOT IN {O.in_list(M.HINT_SKIP)} THEN {_first('lower(' + _hint + ')')} END AS hint_idx
       FROM nm WHERE module IS NOT NULL),
g AS (SELECT project_id, module, count(*) AS files, min(hint_idx) AS hint_idx FROM nh GROUP BY 1, 2),
g2 AS (SELECT *, least({_first('lower(module)')}, hint_idx) AS idx,
              CAST(row_number() OVER (PARTITION BY project_id ORDER BY files DESC, module) AS BIGINT) AS rank FROM g)
SELECT project_id, module, CAST(files AS BIGINT) AS files, rank,
       CASE WHEN idx IS NOT NULL THEN {_descs}[idx] ELSE 'Módulo ' || module END AS description
FROM g2 WHERE rank <= {M.TOP_MODULES}""")}
