"""Project summaries (C04) and entry points (P14) on the suppliers' projects."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.operators import summary as S
from repolens.plans import manifests_q, modules_q
from repolens.plans.structure import lang_sql
from repolens.session import materialize


def _repos(spark, base):
    """Written once: a summary reads each of them several times."""
    files, nodes = adapters.summary_repos(spark, base)
    return materialize(files), materialize(nodes)


QUERIES = {
    "c04_project_summary": lambda spark, base: S.project_summary(*_repos(spark, base)),
    "p14_entry_points": lambda spark, base: S.entry_points(*_repos(spark, base)),
}


def _pick(names):
    return "[" + ", ".join(O.lit(x) for x in names) + f"][CAST((p_partkey // 3) % {len(names)} + 1 AS INTEGER)]"


_list = lambda names: "[" + ", ".join(O.lit(x) for x in names) + "]"
TREES = manifests_q.DEPS + f""",
nd AS (SELECT DISTINCT 'repo-' || CAST(l_suppkey AS VARCHAR) AS project_id,
         replace(replace(replace(CASE WHEN p_partkey % 3 = 0 THEN {_pick(adapters.ENTRY_PATHS)} ELSE {_pick(adapters.APP_PATHS)} END,
           '{{b}}', lower(replace(p_brand, '#', ''))), '{{n}}', CAST(p_partkey AS VARCHAR)), '{{m}}', CAST(p_partkey % 7 AS VARCHAR)) AS path
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <= 1),
own AS (SELECT *, s_suppkey AS k FROM prj WHERE kind = 'package.json' OR s_suppkey % 3 = 0)"""
_inventory = modules_q.SQL["c01_module_inventory"]
_inventory = _inventory[_inventory.index("nm AS ("):]
_split = _inventory.rindex("\nSELECT project_id, module,")
MODULES = _inventory[:_split] + ",\ninv AS (" + _inventory[_split + 1:] + ")"
_generic = O.in_list(S.GENERIC)
_kinds = ", ".join(f"CASE WHEN regexp_matches(signal, {O.lit(p)}) THEN {O.lit(n)} END" for p, n in S.PURPOSES)
SUMMARY = f"""lc AS (SELECT project_id, {lang_sql('path')} AS language, count(*) AS n FROM nd GROUP BY 1, 2),
lg AS (SELECT project_id, CAST(sum(n) AS BIGINT) AS files, coalesce(list(language ORDER BY n DESC, language) FILTER (language <> 'Unknown'), []) AS languages FROM lc GROUP BY 1),
fwk AS (SELECT project_id, list(framework ORDER BY framework) AS frameworks FROM sf GROUP BY 1),
mds AS (SELECT project_id, list(lower(module) ORDER BY rank) AS modules, list(lower(description) ORDER BY rank) AS descriptions FROM inv GROUP BY 1),
rl AS (SELECT 'repo-' || CAST(s_suppkey AS VARCHAR) AS project_id, i, regexp_replace(string_split(text, chr(10))[i], '^\\s+|\\s+$', '', 'g') AS line
       FROM (SELECT s_suppkey, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM supplier JOIN documents ON doc_id = s_suppkey WHERE s_suppkey % 4 <> 3) t),
rd AS (SELECT project_id, substr(arg_min(line, i), 1, {S.MAX_DESCRIPTION}) AS readme FROM rl
       WHERE len(line) >= {S.MIN_PARAGRAPH} AND NOT regexp_matches(line, '^(#|\\[!|!\\[|<|---|===)') GROUP BY 1),
dn AS (SELECT project_id, dep_name, CASE WHEN is_dev THEN 100 ELSE 0 END + row_number() OVER (PARTITION BY project_id ORDER BY list_position({_list(adapters.MANIFEST_DEPS['package.json'])}, dep_name)) AS o
       FROM deps WHERE kind = 'package.json'),
dq AS (SELECT * FROM dn WHERE len(list_filter({_list(S.NOTABLE)}, lambda x: contains(dep_name, x))) > 0),
dk AS (SELECT project_id, list(dep_name ORDER BY o) AS kept FROM dq x
       WHERE NOT list_contains((SELECT list_transform(languages || coalesce(frameworks, []), lambda y: lower(y)) FROM lg LEFT JOIN fwk USING (project_id) WHERE lg.project_id = x.project_id),
                               string_split(replace(dep_name, '@', ''), '/')[1])
         AND NOT EXISTS (SELECT 1 FROM dq z WHERE z.project_id = x.project_id AND z.o < x.o AND z.dep_name = string_split(replace(x.dep_name, '@', ''), '/')[1]) GROUP BY 1),
b0 AS (SELECT lg.project_id, files, languages, coalesce(frameworks, []) AS frameworks, coalesce(modules, []) AS modules, coalesce(descriptions, []) AS descriptions, readme,
              coalesce(kept, []) AS kept, CASE WHEN k % 5 = 0 THEN 'Tools of ' || lg.project_id END AS said,
              CASE WHEN k % 2 = 0 THEN ['api', 'src', 'x', 'kw' || CAST(k % 7 AS VARCHAR)] ELSE [] END AS given
       FROM lg LEFT JOIN fwk USING (project_id) LEFT JOIN mds USING (project_id) LEFT JOIN rd USING (project_id) LEFT JOIN dk USING (project_id) LEFT JOIN own USING (project_id)),
kx AS (SELECT project_id, w, min(i) AS i FROM (SELECT project_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (
         SELECT project_id, given || modules || list_transform(frameworks || languages, lambda x: lower(x)) AS ws FROM b0) t) t
       WHERE w NOT IN {_generic} AND len(w) > 1 GROUP BY 1, 2),
kw AS (SELECT project_id, list(w ORDER BY i)[1:{S.MAX_KEYWORDS}] AS keywords FROM kx GROUP BY 1),
np AS (SELECT project_id, string_agg(lower(path), ' ' ORDER BY lower(path)) AS paths FROM nd WHERE NOT contains(path, 'node_modules') GROUP BY 1),
sx AS (SELECT b0.*, coalesce(keywords, []) AS keywords, concat_ws(' ', array_to_string(coalesce(keywords, []) || modules || descriptions, ' '), paths) AS signal
       FROM b0 LEFT JOIN kw USING (project_id) LEFT JOIN np USING (project_id)),
sy AS (SELECT *, list_filter([{_kinds}], lambda x: x IS NOT NULL) AS found FROM sx),
sz AS (SELECT *, languages || list_filter(frameworks || kept, lambda x: NOT list_contains(languages, x)) AS stack FROM sy)
SELECT project_id, files, coalesce(said, readme, 'Project ' || project_id || ': ' || CAST(files AS VARCHAR) || ' files in ' || array_to_string(languages, ', ')) AS description,
       array_to_string(keywords, ',') AS keywords, array_to_string(stack[1:{S.MAX_STACK}], ',') AS stack,
       CASE WHEN len(found) > 0 THEN array_to_string(found[1:{S.MAX_PURPOSES}], ' + ') ELSE 'Project in ' || array_to_string(languages, '/') END AS purpose
FROM sz"""
_size = "len(path || '/package.json')"
ENTRIES = f"""wd AS (SELECT DISTINCT project_id, path FROM wsp),
en AS (SELECT project_id, 1 AS s, path AS o, 0 AS i, path || '/' || CASE WHEN {_size} % 3 = 0 THEN 'bin/w.js' ELSE 'cli.js' END AS entry FROM wd WHERE {_size} % 3 < 2
       UNION ALL SELECT project_id, 1, path, 1, path || '/lib/w.js' FROM wd WHERE {_size} % 2 = 0
       UNION ALL SELECT project_id, 2, '', 0, CASE k % 4 WHEN 2 THEN 'server.js' ELSE 'bin/a.js' END FROM own WHERE k % 4 >= 2
       UNION ALL SELECT project_id, 2, '', 1, CASE k % 4 WHEN 3 THEN 'bin/b.js' ELSE 'dist/main.js' END FROM own WHERE k % 4 <> 2
       UNION ALL SELECT project_id, 3, path, 0, path FROM nd WHERE {' OR '.join(f"regexp_matches(path, {O.lit(p)})" for p in S.ENTRY_PATTERNS)}),
ef AS (SELECT *, row_number() OVER (PARTITION BY project_id, entry ORDER BY s, o, i) AS r FROM en)
SELECT project_id, entry, ['workspace', 'manifest', 'path'][s] AS source, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY s, o, i, entry) AS rank FROM ef WHERE r = 1) t WHERE rank <= {S.MAX_ENTRY_POINTS}"""

SQL = {
    "c04_project_summary": f"WITH {O.GEO},\n{TREES},\n{MODULES},\n{manifests_q.SCANNER},\n{SUMMARY}",
    "p14_entry_points": f"WITH {TREES},\n{manifests_q.WORKSPACES},\n{ENTRIES}",
}
