"""Co-import pairs (J11) and module grouping (R04) on the supplier graph."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.operators import pairs as P
from repolens.operators import references
from repolens.session import materialize


def _pairs(spark, base):
    return P.co_imports(references.internal_edges(adapters.supplier_graph(spark, base)[0]))


QUERIES = {
    "j11_co_imports": _pairs,
    "r04_module_groups": lambda spark, base: P.module_groups(materialize(_pairs(spark, base)))[0],
    "r04_group_members": lambda spark, base: P.module_groups(materialize(_pairs(spark, base)))[1],
}

_DIR = "regexp_extract({c}, '^(.*)/[^/]*$', 1)"
_NAME = "lower(regexp_replace(regexp_extract({c}, '[^/]*$', 0), '\\.[^.]+$', ''))"
PAIRS = f"""im AS (SELECT DISTINCT project_id, src, dst FROM edges),
pr AS (SELECT a.project_id, a.dst AS file_a, b.dst AS file_b, count(*) AS n FROM im a JOIN im b ON a.project_id = b.project_id AND a.src = b.src AND a.dst < b.dst
       GROUP BY 1, 2, 3 HAVING count(*) >= {P.CO_IMPORT_MIN})"""
GROUPS = PAIRS + f""",
st0 AS (SELECT project_id, file_a AS center, file_b AS member, n FROM pr UNION ALL SELECT project_id, file_b, file_a, n FROM pr),
sr AS (SELECT * FROM st0 UNION ALL SELECT DISTINCT project_id, center, center, 0 FROM st0),
per AS (SELECT project_id, center, count(*) AS files, sum(n) AS score FROM sr GROUP BY 1, 2
        HAVING count(*) > {P.GROUP_MIN_PARTNERS} AND count(DISTINCT {_DIR.format(c='member')}) > 1
           AND NOT bool_or(contains(lower(member), 'types') OR contains(lower(member), 'interface'))),
kept AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.project_id ORDER BY score DESC, files DESC, center) AS rank FROM per p
  WHERE NOT EXISTS (SELECT 1 FROM sr JOIN per b ON b.project_id = sr.project_id AND b.center = sr.center
                    WHERE sr.project_id = p.project_id AND sr.member = p.center AND b.center <> p.center
                      AND (b.score > p.score OR b.score = p.score AND (b.files > p.files OR b.files = p.files AND b.center < p.center)))) x WHERE rank <= {P.GROUP_TOP}),
pa AS (SELECT k.project_id, k.center, k.files, sr.member, unnest(string_split_regex({_NAME.format(c='k.center')}, '[_-]')) AS part,
              generate_subscripts(string_split_regex({_NAME.format(c='k.center')}, '[_-]'), 1) AS pos FROM kept k JOIN sr ON sr.project_id = k.project_id AND sr.center = k.center),
sh AS (SELECT project_id, center, arg_min(part, pos) AS part FROM (SELECT project_id, center, pos, part FROM pa WHERE contains({_NAME.format(c='member')}, part)
       GROUP BY project_id, center, pos, part, files HAVING count(*) = files) y GROUP BY 1, 2),
gr AS (SELECT k.project_id, k.center, CAST(files AS BIGINT) AS files, CAST(score AS BIGINT) AS score, coalesce(part, 'shared') AS module,
              CASE WHEN {_DIR.format(c='k.center')} = '' THEN '.' ELSE {_DIR.format(c='k.center')} END || '/' || coalesce(part, 'shared') AS target_dir,
              'MEDIUM' AS priority, CAST(files + 1 AS BIGINT) AS operations, CAST(rank AS BIGINT) AS rank
       FROM kept k LEFT JOIN sh ON sh.project_id = k.project_id AND sh.center = k.center)"""

SQL = {
    "j11_co_imports": O.with_views(O.SUPPLIER_GRAPH, PAIRS + "\nSELECT project_id, file_a, file_b, CAST(n AS BIGINT) AS n FROM pr"),
    "r04_module_groups": O.with_views(O.SUPPLIER_GRAPH, GROUPS + "\nSELECT * FROM gr"),
    "r04_group_members": O.with_views(O.SUPPLIER_GRAPH, GROUPS + f"""
SELECT gr.project_id, gr.center, sr.member AS path, target_dir || '/' || {O.basename('sr.member')} AS new_path
FROM gr JOIN sr ON sr.project_id = gr.project_id AND sr.center = gr.center"""),
}
