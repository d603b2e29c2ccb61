"""Plan consistency (R07) on plans built from orders and line items."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.operators import plan_checks as PC
from repolens.session import materialize


def _log(spark, base):
    steps, ops, files = adapters.plan_log(spark, base)
    return steps, materialize(ops), materialize(files)


def q_issues(spark, base):
    steps, ops, files = _log(spark, base)
    return PC.plan_issues(steps, ops, files)


def q_folded(spark, base):
    return PC.collision_issues(_log(spark, base)[1], fold=True)


def q_verdicts(spark, base):
    steps, ops, files = _log(spark, base)
    return PC.plan_verdicts(steps, PC.plan_issues(steps, ops, files))


QUERIES = {"r07_plan_issues": q_issues, "r07_folded_collisions": q_folded, "r07_plan_verdicts": q_verdicts}

_RULE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in adapters.PLAN_RULES.items()) + " ELSE 'cleanup' END"
_TARGET = f"'src/shared/m' || CAST(l_partkey % {adapters.PLAN_TARGETS} AS VARCHAR) || '.ts'"
LOG = f"""steps AS (SELECT 'plan-' || CAST(c_nationkey AS VARCHAR) AS project_id, o_orderkey AS step_id, {_RULE} AS rule
  FROM orders JOIN customer ON o_custkey = c_custkey),
ln AS (SELECT l.*, 'src/' || lower(replace(p_brand, '#', '')) AS dir,
         CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 1 THEN 'MOVE' WHEN l_returnflag = 'R' AND l_linenumber % 3 = 2 THEN 'DELETE'
              WHEN l_returnflag = 'N' AND l_discount > {O.d(0.04)} THEN 'CREATE' WHEN l_returnflag = 'R' THEN 'CREATE' ELSE 'MODIFY' END AS type
  FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 4),
ops AS (SELECT project_id, step_id, CAST(l_linenumber AS BIGINT) AS seq, type,
          CASE WHEN type = 'CREATE' AND l_linenumber = 6 THEN {_TARGET}
               WHEN type = 'CREATE' AND l_linenumber = 7 OR type = 'DELETE' AND l_linenumber = 5 THEN 'src/draft/o' || CAST(l_orderkey AS VARCHAR) || '.ts'
               ELSE dir || '/' || CASE WHEN l_tax >= {O.d(0.08)} THEN 'P' ELSE 'p' END || CAST(l_partkey AS VARCHAR) || '.ts' END AS path,
          CASE WHEN type = 'MOVE' THEN {_TARGET} END AS new_path,
          CASE WHEN type = 'MODIFY' AND l_quantity > 40 THEN 'Update imports after p' || CAST(l_partkey + 1 AS VARCHAR) || '.ts moved'
               WHEN type = 'MODIFY' AND l_discount < {O.d(0.01)} THEN 'Extract the shared part' ELSE 'Line ' || CAST(l_linenumber AS VARCHAR) END AS description
  FROM ln JOIN steps ON l_orderkey = step_id),
files AS (SELECT DISTINCT project_id, 'src/' || lower(replace(p_brand, '#', '')) || '/p' || CAST(p_partkey AS VARCHAR) || '.ts' AS path
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN steps ON l_orderkey = step_id WHERE p_partkey % 5 <> 0)"""


def _row(category, kind, severity, src, step="step_id", path="path", other="NULL", n="NULL"):
    return (f"SELECT project_id, '{category}' AS category, '{kind}' AS kind, {severity} AS severity, CAST({step} AS BIGINT) AS step_id, {path} AS path, "
            f"CAST({other} AS BIGINT) AS other_step, CAST({n} AS BIGINT) AS n FROM {src}")


def _collisions(fold: bool) -> str:
    key = (lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '[\\\\/]+', '/', 'g')), '^(\\./)+', ''), '/(\\./)+', '/', 'g'), '/$', '')") if fold else (lambda c: c)
    return (f"mk AS (SELECT project_id, {key('path')} AS path, min(step_id) AS step_id, count(*) AS times FROM ops WHERE type = 'CREATE' GROUP BY 1, 2),\n"
            f"mv AS (SELECT project_id, {key('new_path')} AS path, min(step_id) AS step_id, count(*) AS moves FROM ops WHERE type = 'MOVE' AND new_path <> '' GROUP BY 1, 2),\n"
            "cl AS (" + _row("PATH_COLLISION", "created_twice", "'ERROR'", "mk WHERE times > 1", n="times")
            + "\nUNION ALL " + _row("PATH_COLLISION", "moved_to_twice", "'ERROR'", "mv WHERE moves > 1", n="moves")
            + "\nUNION ALL " + _row("PATH_COLLISION", "created_and_moved_to", "'ERROR'", "(SELECT mk.*, mv.step_id AS ms, moves FROM mk JOIN mv USING (project_id, path)) x", other="ms", n="moves") + ")")


ISSUES = LOG + f""",
md AS (SELECT project_id, path, max(step_id) AS made_in FROM ops WHERE type = 'CREATE' GROUP BY 1, 2),
ls AS (SELECT project_id, path, max(struct_pack(step_id := step_id, seq := seq, type := type)) AS l FROM ops WHERE type IN ('MOVE', 'DELETE') GROUP BY 1, 2),
lost AS (SELECT project_id, path, l.step_id AS step_id, l.type AS type FROM ls
  WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.project_id = ls.project_id AND o.step_id = ls.l.step_id AND o.type = 'MODIFY' AND o.path <> ls.path AND contains(lower(o.description), 'import'))
    AND NOT EXISTS (SELECT 1 FROM ops o WHERE o.project_id = ls.project_id AND o.type = 'MODIFY' AND contains(o.description, {O.basename('ls.path')}))),
hb AS (SELECT o.project_id, o.step_id, count(*) FILTER (o.type = 'CREATE') AS made, count(*) FILTER (o.type = 'MODIFY') AS changed,
         bool_or(o.type = 'MODIFY' AND (contains(lower(description), 'refactor') OR contains(lower(description), 'extract'))) AS says
  FROM ops o JOIN steps s ON s.project_id = o.project_id AND s.step_id = o.step_id AND s.rule = 'hub-splitter' GROUP BY 1, 2),
bs AS (SELECT DISTINCT a.project_id, a.step_id FROM ops a JOIN ops b ON a.project_id = b.project_id AND a.step_id = b.step_id
       AND regexp_extract(a.path, '^(.*)/[^/]*$', 1) = regexp_extract(b.path, '^(.*)/[^/]*$', 1) AND a.type = 'CREATE' AND b.type = 'MODIFY'),
{_collisions(False)},
issues AS (
{_row('CIRCULAR_OPERATION', 'created_later', "'ERROR'", "(SELECT o.*, made_in FROM ops o JOIN md USING (project_id, path) WHERE type IN ('MODIFY', 'DELETE') AND made_in > o.step_id) x", other='made_in')}
UNION ALL {_row('CIRCULAR_OPERATION', 'create_and_delete', "'ERROR'", "(SELECT project_id, step_id, path FROM ops WHERE type IN ('CREATE', 'DELETE') GROUP BY 1, 2, 3 HAVING count(DISTINCT type) = 2) x")}
UNION ALL {_row('ORPHAN_IMPORT', 'no_consumer_update', "CASE WHEN type = 'MOVE' THEN 'WARNING' ELSE 'INFO' END", 'lost')}
UNION ALL {_row('INCOMPLETE_SPLIT', 'no_consumer_change', "'ERROR'", 'hb WHERE made > 0 AND changed = 0', path='NULL', n='made')}
UNION ALL {_row('INCOMPLETE_SPLIT', 'hub_not_changed', "'WARNING'", '(SELECT * FROM hb ANTI JOIN bs USING (project_id, step_id)) x WHERE made > 0 AND NOT says', path='NULL', n='made')}
UNION ALL SELECT * FROM cl
UNION ALL {_row('EMPTY_STEP', 'no_operation', "'WARNING'", '(SELECT * FROM steps ANTI JOIN ops USING (project_id, step_id)) x', path='NULL')}
UNION ALL {_row('SCOPE_VIOLATION', 'unknown_path', "'WARNING'", "(SELECT * FROM ops ANTI JOIN files USING (project_id, path) ANTI JOIN md USING (project_id, path)) x WHERE type <> 'CREATE'")})"""

SQL = {
    "r07_plan_issues": O.with_views(ISSUES, "r AS (SELECT * FROM issues) SELECT * FROM r"),
    "r07_folded_collisions": O.with_views(LOG, _collisions(True) + "\nSELECT * FROM cl"),
    "r07_plan_verdicts": O.with_views(ISSUES, """v AS (SELECT project_id, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings,
  count(*) FILTER (severity = 'INFO') AS infos FROM issues GROUP BY 1)
SELECT project_id, CAST(coalesce(errors, 0) AS BIGINT) AS errors, CAST(coalesce(warnings, 0) AS BIGINT) AS warnings, CAST(coalesce(infos, 0) AS BIGINT) AS infos,
       coalesce(errors, 0) = 0 AS valid FROM (SELECT DISTINCT project_id FROM steps) s LEFT JOIN v USING (project_id)"""),
}
