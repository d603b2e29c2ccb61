"""DuckDB SQL text for the oracle: the adapter views as CTEs.

Each oracle query is ``WITH <views> <select>``.  Literals that feed a
double comparison are written as ``CAST(x AS DOUBLE)`` so DuckDB does not
switch to DECIMAL arithmetic.
"""

from __future__ import annotations


def d(x: float) -> str:
    """A DOUBLE literal for DuckDB that round-trips the Python float."""
    return f"CAST({float(x)!r} AS DOUBLE)"


GEO = """geo AS (
  SELECT n.n_nationkey, n.n_name, r.r_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SUPPLIER_PATHS = """sp AS (
  SELECT s.s_suppkey, g.r_name || '/' || g.n_name || '/s' || CAST(s.s_suppkey AS VARCHAR) || '.ts' AS path
  FROM supplier s JOIN geo g ON s.s_nationkey = g.n_nationkey)"""

ORDER_PROJECTS = """op AS (
  SELECT o.o_orderkey, g.r_name || '-' || CAST(year(o.o_orderdate) AS VARCHAR) AS project_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.n_nationkey)"""

PROJECT_LINES = """pl AS (
  SELECT op.project_id, l.l_orderkey, l.l_linenumber, l.l_suppkey
  FROM lineitem l JOIN op ON l.l_orderkey = op.o_orderkey)"""

SUPPLIER_GRAPH = ",\n".join([GEO, SUPPLIER_PATHS, ORDER_PROJECTS, PROJECT_LINES, """pairs AS (
  SELECT DISTINCT a.project_id, a.l_suppkey AS sa, b.l_suppkey AS sb
  FROM pl a JOIN pl b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)""",
                             """edges AS (
  SELECT p.project_id, x.path AS src, y.path AS dst, 'import' AS type, CAST(1.0 AS DOUBLE) AS weight
  FROM pairs p JOIN sp x ON p.sa = x.s_suppkey JOIN sp y ON p.sb = y.s_suppkey)""",
                             """files AS (
  SELECT DISTINCT pl.project_id, sp.path FROM pl JOIN sp ON pl.l_suppkey = sp.s_suppkey)"""])


def with_views(views: str, body: str) -> str:
    return f"WITH {views},\n{body}"


def basename(col: str) -> str:
    return f"regexp_extract({col}, '[^/]*$', 0)"


def ladder_lt(x: str, steps, default) -> str:
    parts = " ".join(f"WHEN {x} < {b} THEN {v}" for b, v in steps)
    return f"CASE {parts} ELSE {default} END"


def ladder_gt(x: str, steps, default) -> str:
    parts = " ".join(f"WHEN {x} > {b} THEN {v}" for b, v in steps)
    return f"CASE {parts} ELSE {default} END"


def in_list(items) -> str:
    return "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


def own_file(col: str) -> str:
    from repolens.functions.paths import EXCLUDED_SEGMENTS
    p = f"('/' || replace({col}, '\\', '/'))"
    return "NOT (" + " OR ".join(f"contains({p}, '{s}')" for s in EXCLUDED_SEGMENTS) + ")"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"

FILE_CHANGES = ",\n".join([GEO, """sp5 AS (
  SELECT s.s_suppkey, g.r_name || '/' || g.n_name || '/s' || CAST(s.s_suppkey AS VARCHAR) AS path
  FROM supplier s JOIN geo g ON s.s_nationkey = g.n_nationkey)""", """changes AS (
  SELECT 'status-' || o.o_orderstatus AS project_id, 'o' || CAST(l.l_orderkey AS VARCHAR) AS commit_id,
         'c' || CAST(o.o_custkey AS VARCHAR) AS author, CAST(o.o_orderdate AS TIMESTAMP) AS ts,
         sp5.path, CAST(sum(l.l_quantity) AS BIGINT) AS additions, CAST(count(*) AS BIGINT) AS deletions
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN sp5 ON l.l_suppkey = sp5.s_suppkey
  GROUP BY o.o_orderstatus, l.l_orderkey, o.o_custkey, o.o_orderdate, sp5.path)""",
                           """ref_ts AS (SELECT max(CAST(o_orderdate AS TIMESTAMP)) AS a FROM orders)""",
                           """pc AS (SELECT c.*, ref_ts.a AS as_of FROM changes c, ref_ts
  WHERE c.ts <= ref_ts.a AND c.ts >= CAST(CAST(ref_ts.a AS DATE) - INTERVAL 168 DAYS AS TIMESTAMP))"""])


def module_top(col: str) -> str:
    return (f"CASE WHEN len(string_split({col}, '/')) > 1 THEN string_split({col}, '/')[1] "
            f"ELSE 'root' END")


def jsr(x: str, k: int) -> str:
    return f"floor(({x}) * {float(10 ** k)!r} + 0.5) / {float(10 ** k)!r}"

EVENTS = """ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) AS k
  FROM events)"""

ANALYSES = EVENTS + """,
analyses AS (
  SELECT event_id AS analysis_id, 'u' || CAST(user_id AS VARCHAR) AS project_id, ts,
         least(CAST(100.0 AS DOUBLE), value) AS overall, least(CAST(100.0 AS DOUBLE), value + 10) AS modularity,
         value % 100 AS coupling, least(CAST(100.0 AS DOUBLE), value * CAST(0.5 AS DOUBLE)) AS cohesion,
         CAST(k AS DOUBLE) AS layering, CAST(k + 10 AS BIGINT) AS nodes, CAST(k * 3 AS BIGINT) AS edges
  FROM ev)"""


def _ap_sql():
    from repolens.adapters import AP_NAMES, AP_SEVERITY
    names = "[" + ", ".join(f"'{n}'" for n in AP_NAMES) + "]"
    sev = "CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AP_SEVERITY.items()) + " END"
    return f"""ap0 AS (
  SELECT event_id AS analysis_id, {names}[CAST((k + i) % 5 + 1 AS INTEGER)] AS name,
         'src/m' || CAST((k + i) % 7 AS VARCHAR) || '/f' || CAST(k % 11 AS VARCHAR) || '.ts' AS location
  FROM ev, LATERAL (SELECT unnest(generate_series(1, 1 + k % 3)) AS i) g),
anti_patterns AS (
  SELECT analysis_id, name, {sev} AS severity, location, name || ' at ' || location AS description FROM ap0)"""


SNAPSHOTS = ANALYSES + ",\n" + _ap_sql()


def projects_sql(name: str = "projects", half: str | None = None) -> str:
    cond = {"old": "WHERE day(ts) < 16", "new": "WHERE day(ts) >= 16", None: ""}[half]
    return f"""{name} AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS project_id, '/repos/u' || CAST(user_id AS VARCHAR) AS path,
         'project-' || CAST(user_id AS VARCHAR) || '-' || CAST(max(k) AS VARCHAR) AS name,
         list_sort(list_distinct(list(event_type))) AS languages, CAST([] AS VARCHAR[]) AS frameworks,
         CAST(count(*) AS BIGINT) AS total_files, CAST(sum(floor(value)) AS BIGINT) AS total_lines,
         min(ts) AS created_at, max(ts) AS updated_at
  FROM ev {cond} GROUP BY user_id)"""


DECISIONS = """decisions AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS project_id, 'adr-' || CAST(k % 4 AS VARCHAR) AS decision_id,
         'ADR ' || CAST(k % 4 AS VARCHAR) AS title,
         ['proposed', 'accepted', 'deprecated', 'superseded'][CAST(event_id % 4 + 1 AS INTEGER)] AS status,
         ts AS updated_at, event_id AS record_id
  FROM ev WHERE event_type = 'signup')"""

CODE_FILES = GEO + """,
sup AS (
  SELECT s.s_suppkey, s.s_name, s.s_acctbal, g.r_name AS project_id,
         'src/' || lower(replace(g.n_name, ' ', '_')) || '/supplier_' || CAST(s.s_suppkey AS VARCHAR) || '.ts' AS path
  FROM supplier s JOIN geo g ON s.s_nationkey = g.n_nationkey),
items AS (SELECT l.*, sup.* FROM lineitem l JOIN sup ON l.l_suppkey = sup.s_suppkey),
clines AS (
  SELECT project_id, path, 0 AS sec, CAST(0 AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2, '// supplier ' || s_name AS line FROM sup
  UNION ALL SELECT project_id, path, 1, -2, 0, 'import fs from ''fs'';' FROM sup
  UNION ALL SELECT project_id, path, 1, -1, 0, 'import { helper } from ''./helpers'';' FROM sup WHERE s_acctbal < 0
  UNION ALL SELECT DISTINCT project_id, path, 1, l_partkey, 0,
         'import { P' || CAST(l_partkey AS VARCHAR) || ' } from ''../parts/p' || CAST(l_partkey AS VARCHAR) || ''';'
         FROM items WHERE l_quantity > 25
  UNION ALL SELECT project_id, path, 2, l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN
                '  public ship' || CAST(l_orderkey AS VARCHAR) || 'x' || CAST(l_linenumber AS VARCHAR) || '(q) { return '
                || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '; }'
              WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN
                '  handle' || CAST(l_orderkey AS VARCHAR) || 'x' || CAST(l_linenumber AS VARCHAR) || ' = (e) => e;'
              WHEN l_discount >= CAST(0.09 AS DOUBLE) THEN
                'export Impl_' || CAST(l_orderkey AS VARCHAR) || 'x' || CAST(l_linenumber AS VARCHAR) || ';'
              ELSE '  // item ' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || ' part '
                || CAST(l_partkey AS VARCHAR) || ' qty ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END
  FROM items),
code_files AS (
  SELECT project_id, path, string_agg(line, chr(10) ORDER BY sec, k1, k2, line) AS content FROM clines GROUP BY 1, 2
  UNION ALL
  SELECT DISTINCT i.project_id, 'src/parts/p' || CAST(p.p_partkey AS VARCHAR) || '.ts',
         'export const P' || CAST(p.p_partkey AS VARCHAR) || ' = ''' || p.p_name || ''';' || chr(10)
         || 'export function price' || CAST(p.p_partkey AS VARCHAR) || '() { return 1; }'
  FROM items i JOIN part p ON i.l_partkey = p.p_partkey)"""


def _part_paths():
    from repolens.adapters import PART_DIRS, PART_EXTS
    dirs = "[" + ", ".join(f"'{d}'" for d in PART_DIRS) + "]"
    exts = "[" + ", ".join(f"'{e}'" for e in PART_EXTS) + "]"
    return f"""pp AS (
  SELECT p_partkey, replace(p_brand, '#', '') || '/' || {dirs}[CAST(p_partkey % {len(PART_DIRS)} + 1 AS INTEGER)]
         || '/' || CASE WHEN p_partkey % 40 = 0 THEN 'index' ELSE 'p' || CAST(p_partkey AS VARCHAR) END || {exts}[CAST(p_partkey % {len(PART_EXTS)} + 1 AS INTEGER)] AS path
  FROM part)"""


PART_GRAPH = _part_paths() + """,
plines AS (
  SELECT 'm' || strftime(CAST(o.o_orderdate AS TIMESTAMP), '%Y-%m') AS project_id, l.l_orderkey, l.l_linenumber, l.l_partkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
ppairs AS (
  SELECT DISTINCT a.project_id, a.l_partkey AS pa, b.l_partkey AS pb
  FROM plines a JOIN plines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
edges AS (
  SELECT DISTINCT q.project_id, x.path AS src, y.path AS dst, 'import' AS type, CAST(1.0 AS DOUBLE) AS weight
  FROM ppairs q JOIN pp x ON q.pa = x.p_partkey JOIN pp y ON q.pb = y.p_partkey),
files AS (SELECT DISTINCT plines.project_id, pp.path FROM plines JOIN pp ON plines.l_partkey = pp.p_partkey)"""


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
