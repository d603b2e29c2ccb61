"""Code structure: reference extraction, file metrics, layers, detectors.

Inputs: code files built from supplier line items (D2) and the part graph
per order month (D3).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.functions import paths as P
from repolens.operators import cycles as C
from repolens.operators import detect as A
from repolens.operators import graph as G
from repolens.operators import references as R
from repolens.plans.graphs import SCC_SQL
from repolens.session import materialize


def with_file_metrics(files):
    """P01, P02, P04, P09, P10 as columns on a (project_id, path, content) table."""
    return files.select("project_id", "path", P.language(F.col("path")).alias("language"),
                        P.line_count(F.col("content")).alias("lines"),
                        P.method_count(F.col("content")).alias("methods"),
                        P.internal_export_count(F.col("content")).alias("internal_exports"),
                        P.layer(F.col("path")).alias("layer"))


def code_files(spark, base):
    """The code-file input, written once: it feeds metrics, extraction and
    resolution (three branches of every structure plan)."""
    return materialize(adapters.code_files(spark, base))


def code_graph(spark, base):
    files = code_files(spark, base)
    refs = R.filter_internal_python(materialize(R.extract_references(files)), files)
    edges = G.build_edges(R.resolve_references(refs, files))
    return files, materialize(edges)


def q_extract(spark, base):
    return R.extract_references(code_files(spark, base))


def q_resolve(spark, base):
    files = code_files(spark, base)
    return R.resolve_references(materialize(R.extract_references(files)), files)  # texts are searched once


def q_code_edges(spark, base):
    return code_graph(spark, base)[1]


def q_internal_edges(spark, base):
    return R.internal_edges(code_graph(spark, base)[1]).select("project_id", "src", "dst")


def q_file_metrics(spark, base):
    return with_file_metrics(code_files(spark, base))


def q_project_totals(spark, base):
    m = with_file_metrics(code_files(spark, base))
    return m.groupBy("project_id").agg(F.count(F.lit(1)).cast("bigint").alias("total_files"),
                                       F.sum("lines").cast("bigint").alias("total_lines"))


def q_languages(spark, base):
    _, files = adapters.part_graph(spark, base)
    return files.select("project_id", "path", P.language(F.col("path")).alias("language"))


def q_project_languages(spark, base):
    _, files = adapters.part_graph(spark, base)
    return (files.select("project_id", P.language(F.col("path")).alias("language"))
            .where(F.col("language") != "Unknown").groupBy("project_id")
            .agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages")))


def q_layers(spark, base):
    _, files = adapters.part_graph(spark, base)
    return files.select("project_id", "path", P.layer(F.col("path")).alias("layer"))


def q_layer_sizes(spark, base):
    _, files = adapters.part_graph(spark, base)
    return (files.select("project_id", P.layer(F.col("path")).alias("layer")).where(F.col("layer").isNotNull())
            .groupBy("project_id", "layer").agg(F.count(F.lit(1)).cast("bigint").alias("files")))


def _ap(df):
    return df.select("project_id", "name", "severity", "location", "metric1", "metric2")


def q_god(spark, base):
    return _ap(A.god_classes(with_file_metrics(code_files(spark, base))))


def q_leaky(spark, base):
    return _ap(A.leaky_abstractions(with_file_metrics(code_files(spark, base))))


def q_envy(spark, base):
    files, edges = code_graph(spark, base)
    return _ap(A.feature_envy(with_file_metrics(files), edges))


def q_detect(spark, base):
    files, edges = code_graph(spark, base)
    # metrics are counted once; the detectors read scalar columns only
    metrics = materialize(with_file_metrics(files))
    return A.detect(metrics, edges, C.scc_members(edges)).select(
        "project_id", "name", "severity", "location", "metric1", "metric2",
        F.col("severity_rank").cast("bigint").alias("severity_rank"))


def q_pattern_summary(spark, base):
    ap = adapters.anti_patterns(spark, base).join(
        adapters.analyses(spark, base).select("analysis_id", "project_id"), "analysis_id")
    return A.pattern_summary(ap)


def q_pattern_pivot(spark, base):
    ap = adapters.anti_patterns(spark, base).join(
        adapters.analyses(spark, base).select("analysis_id", "project_id"), "analysis_id")
    piv = A.pattern_pivot(ap, adapters.AP_NAMES)
    return piv.select("project_id", *[F.col(f"`{n}`").cast("bigint").alias(n.lower().replace(" ", "_"))
                                      for n in adapters.AP_NAMES])


QUERIES = {
    "j01_extract_references": q_extract,
    "j02_resolve_references": q_resolve,
    "j05_code_edges": q_code_edges,
    "p07_internal_edges": q_internal_edges,
    "p02_file_metrics": q_file_metrics,
    "p02_project_totals": q_project_totals,
    "p01_languages": q_languages,
    "p01_project_languages": q_project_languages,
    "p04_layers": q_layers,
    "p04_layer_sizes": q_layer_sizes,
    "a01_god_classes": q_god,
    "a03_leaky_abstractions": q_leaky,
    "a04_feature_envy": q_envy,
    "a06_detect": q_detect,
    "a07_pattern_summary": q_pattern_summary,
    "a07_pattern_pivot": q_pattern_pivot,
}

# ------------------------------------------------------------------ SQL ----
q = O.lit


def ext_sql(c):
    return f"regexp_extract({O.basename(c)}, '^.+(\\.[^.]+)$', 1)"


def lang_sql(c):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGE_BY_EXT.items())
    return f"coalesce(CASE lower({ext_sql(c)}) {cases} END, 'Unknown')"


def _any(col, items, how):
    f = "contains" if how == "contains" else "ends_with"
    return "(" + " OR ".join(f"{f}({col}, {q(i)})" for i in items) + ")"


def layer_sql(c):
    p, n = f"('/' || lower({c}))", f"lower({O.basename(c)})"
    e = f"lower({ext_sql(c)})"
    return f"""CASE WHEN {_any(n, P._TEST_SUFFIX, 'ends')} OR {_any(p, P._TEST_DIRS, 'contains')} THEN NULL
  WHEN contains({p}, 'node_modules') THEN NULL
  WHEN {_any(p, P._DATA_DIRS, 'contains')} OR {_any(n, P._DATA_SUFFIX, 'ends')} OR {_any(n, P._DATA_NAME, 'contains')} THEN 'Data'
  WHEN {_any(p, P._INFRA_DIRS, 'contains')} OR {_any(n, P._INFRA_SUFFIX, 'ends')} OR {_any(n, P._INFRA_NAME, 'contains')} THEN 'Infrastructure'
  WHEN {_any(p, P._API_DIRS, 'contains')} OR {_any(n, P._API_SUFFIX, 'ends')} OR {_any(n, P._API_NAME, 'contains')} THEN 'API'
  WHEN {_any(p, P._SERVICE_DIRS, 'contains')} OR {_any(n, P._SERVICE_SUFFIX, 'ends')} OR {_any(n, P._SERVICE_NAME, 'contains')} THEN 'Service'
  WHEN {_any(p, P._UI_DIRS, 'contains')} OR {e} IN {O.in_list(P._UI_EXT)} THEN 'UI' END"""


def count_sql(c, pattern):
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


METRICS = f"""fm AS (
  SELECT project_id, path, {lang_sql('path')} AS language,
         CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines,
         CAST({count_sql('content', P.METHOD_PATTERNS[0])} + {count_sql('content', P.METHOD_PATTERNS[1])} AS BIGINT) AS methods,
         CAST({' + '.join(count_sql('content', 'export\\s+\\w*' + m + '\\w*') for m in P.INTERNAL_MARKERS)} AS BIGINT) AS internal_exports,
         {layer_sql('path')} AS layer
  FROM code_files)"""

EXTRACT = f"""refs AS (
  SELECT project_id, path AS src, unnest(regexp_extract_all(content, {q(R.TS_IMPORT)}, 1)) AS raw, 'import' AS kind
  FROM code_files WHERE {ext_sql('path')} IN {O.in_list(R.TS_EXTS)}
  UNION ALL
  SELECT project_id, path, unnest(regexp_extract_all(content, {q(R.TS_DYNAMIC)}, 1)), 'dynamic'
  FROM code_files WHERE {ext_sql('path')} IN {O.in_list(R.TS_EXTS)}
  UNION ALL
  SELECT project_id, path, unnest(regexp_extract_all(content, {q(R.JAVA_IMPORT)}, 1)), 'import'
  FROM code_files WHERE {ext_sql('path')} = '.java')"""

_exts = "[" + ", ".join(q(e) for e in R.RESOLVE_EXTS) + "]"
RESOLVE = EXTRACT + f""",
rd AS (SELECT DISTINCT project_id, src, raw FROM refs),
rel AS (
  SELECT project_id, src, raw,
         array_to_string(list_reduce(string_split(concat_ws('/', regexp_extract(src, '^(.*)/[^/]*$', 1), raw), '/'),
           lambda acc, x: CASE WHEN x = '' OR x = '.' THEN acc WHEN x = '..' THEN acc[1:len(acc) - 1]
                               ELSE list_append(acc, x) END, CAST([] AS VARCHAR[])), '/') AS base
  FROM rd WHERE starts_with(raw, '.')),
cand AS (
  SELECT project_id, src, raw, base, base AS cpath, 0 AS rk FROM rel
  UNION ALL SELECT project_id, src, raw, base, base || e.ext, e.i FROM rel, (SELECT unnest({_exts}) AS ext,
         unnest(range(1, {len(R.RESOLVE_EXTS) + 1})) AS i) e
  UNION ALL SELECT project_id, src, raw, base, base || '/index' || e.ext, e.i + 9 FROM rel, (SELECT unnest({_exts}) AS ext,
         unnest(range(1, {len(R.RESOLVE_EXTS) + 1})) AS i) e),
hit AS (SELECT c.project_id, c.src, c.raw, arg_min(c.cpath, c.rk) AS hp FROM cand c
        JOIN (SELECT DISTINCT project_id, path FROM code_files) f ON f.project_id = c.project_id AND f.path = c.cpath
        GROUP BY 1, 2, 3),
resolved AS (
  SELECT rel.project_id, rel.src, rel.raw, coalesce(hit.hp, rel.base) AS dst FROM rel
  LEFT JOIN hit ON hit.project_id = rel.project_id AND hit.src = rel.src AND hit.raw = rel.raw
  UNION ALL SELECT project_id, src, raw, raw FROM rd WHERE NOT starts_with(raw, '.')),
edges AS (SELECT DISTINCT project_id, src, dst, 'import' AS type, CAST(1.0 AS DOUBLE) AS weight FROM resolved)"""


def _external_sql(c):
    base = f"string_split({c}, '/')[1]"
    sb = f"array_to_string(string_split({c}, '/')[1:2], '/')"
    in_full = f"EXISTS (SELECT 1 FROM nd WHERE nd.project_id = e.project_id AND nd.path = e.{c})"
    in_base = f"EXISTS (SELECT 1 FROM nd WHERE nd.project_id = e.project_id AND nd.path = {sb})"
    rel = f"(starts_with({c}, './') OR starts_with({c}, '../') OR starts_with({c}, '/'))"
    ext = (f"(starts_with({c}, 'node:') OR {c} IN {O.in_list(R.NODE_BUILTINS)} OR {base} IN {O.in_list(R.NODE_BUILTINS)}"
           f" OR (starts_with({c}, '@') AND contains({c}, '/') AND NOT {in_base} AND NOT {in_full})"
           f" OR (NOT starts_with({c}, '.') AND NOT {in_full} AND (NOT contains({c}, '.') OR starts_with({c}, 'node_modules'))))")
    return f"(NOT {rel} AND {ext})"


def _ap_sel(src):
    return f"SELECT project_id, name, severity, location, CAST(metric1 AS BIGINT) AS metric1, CAST(metric2 AS BIGINT) AS metric2 FROM {src}"


GOD = f"""god AS (SELECT project_id, 'God Class' AS name, 'CRITICAL' AS severity, path AS location,
              lines AS metric1, methods AS metric2 FROM fm
              WHERE lines > {A.GOD_CLASS_LINES} AND {O.own_file('path')} AND methods > {A.GOD_CLASS_METHODS})"""
LEAKY = f"""leaky AS (SELECT project_id, 'Leaky Abstraction' AS name, 'MEDIUM' AS severity, path AS location,
                internal_exports AS metric1, CAST(NULL AS BIGINT) AS metric2 FROM fm
                WHERE {O.own_file('path')} AND internal_exports > {A.LEAKY_MIN_EXPORTS})"""
_nm = f"lower({O.basename('fm.path')})"
ENVY = f"""fo AS (SELECT project_id, src AS path, count(DISTINCT dst) AS refs FROM edges GROUP BY 1, 2),
envy AS (SELECT fm.project_id, 'Feature Envy' AS name, 'MEDIUM' AS severity, fm.path AS location,
                coalesce(fo.refs, 0) AS metric1, methods AS metric2
         FROM fm LEFT JOIN fo ON fo.project_id = fm.project_id AND fo.path = fm.path
         WHERE {O.own_file('fm.path')} AND methods > 0
           AND NOT ({' OR '.join(f"ends_with({_nm}, {q(s)})" for s in A.ENVY_EXEMPT_SUFFIXES)} OR contains(fm.path, '/scripts/'))
           AND coalesce(fo.refs, 0) > methods * 3)"""


def _shot():
    from repolens.plans.scoring import shotgun_sql
    return shotgun_sql()


_CF = O.CODE_FILES
_SEV = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"

SQL = {
    "j01_extract_references": O.with_views(_CF, EXTRACT + "\nSELECT * FROM refs"),
    "j02_resolve_references": O.with_views(_CF, RESOLVE + "\nSELECT * FROM resolved"),
    "j05_code_edges": O.with_views(_CF, RESOLVE + "\nSELECT * FROM edges"),
    "p07_internal_edges": O.with_views(_CF, RESOLVE + f""",
nd AS (SELECT project_id, src AS path FROM edges UNION SELECT project_id, dst FROM edges)
SELECT project_id, src, dst FROM edges e WHERE NOT {_external_sql('dst')} AND NOT {_external_sql('src')}"""),
    "p02_file_metrics": O.with_views(_CF, METRICS + "\nSELECT * FROM fm"),
    "p02_project_totals": O.with_views(_CF, METRICS + """
SELECT project_id, CAST(count(*) AS BIGINT) AS total_files, CAST(sum(lines) AS BIGINT) AS total_lines FROM fm GROUP BY 1"""),
    "p01_languages": O.with_views(O.PART_GRAPH, f"x AS (SELECT 1)\nSELECT project_id, path, {lang_sql('path')} AS language FROM files"),
    "p01_project_languages": O.with_views(O.PART_GRAPH, f"""l AS (SELECT DISTINCT project_id, {lang_sql('path')} AS language FROM files)
SELECT project_id, string_agg(language, ',' ORDER BY language) AS languages FROM l WHERE language <> 'Unknown' GROUP BY 1"""),
    "p04_layers": O.with_views(O.PART_GRAPH, f"x AS (SELECT 1)\nSELECT project_id, path, {layer_sql('path')} AS layer FROM files"),
    "p04_layer_sizes": O.with_views(O.PART_GRAPH, f"""l AS (SELECT project_id, {layer_sql('path')} AS layer FROM files)
SELECT project_id, layer, CAST(count(*) AS BIGINT) AS files FROM l WHERE layer IS NOT NULL GROUP BY 1, 2"""),
    "a01_god_classes": O.with_views(_CF, METRICS + ",\n" + GOD + "\n" + _ap_sel("god")),
    "a03_leaky_abstractions": O.with_views(_CF, METRICS + ",\n" + LEAKY + "\n" + _ap_sel("leaky")),
    "a04_feature_envy": O.with_views(_CF, RESOLVE + ",\n" + METRICS + ",\n" + ENVY + "\n" + _ap_sel("envy")),
    "a06_detect": ("WITH RECURSIVE " + _CF + ",\n" + RESOLVE + ",\n" + SCC_SQL + ",\n" + METRICS + ",\n" + GOD + ",\n" + LEAKY + ",\n" + ENVY + ",\n"
                               + _shot() + f""",
circ AS (SELECT project_id, 'Circular Dependency' AS name, 'HIGH' AS severity, string_agg(path, ' -> ' ORDER BY path) AS location,
                count(*) AS metric1, CAST(NULL AS BIGINT) AS metric2
         FROM members GROUP BY project_id, scc_id HAVING bool_and({O.own_file('path')})),
allp AS ({_ap_sel('god')} UNION ALL {_ap_sel('circ')} UNION ALL {_ap_sel('leaky')} UNION ALL {_ap_sel('envy')}
         UNION ALL SELECT project_id, 'Shotgun Surgery', 'HIGH', location, CAST(metric1 AS BIGINT), CAST(NULL AS BIGINT) FROM shot)
SELECT *, CAST({_SEV} AS BIGINT) AS severity_rank FROM allp"""),
    "a07_pattern_summary": O.with_views(O.SNAPSHOTS, f"""j AS (SELECT a.project_id, ap.* FROM anti_patterns ap JOIN analyses a ON a.analysis_id = ap.analysis_id)
SELECT project_id, name, CAST(count(*) AS BIGINT) AS occurrences, arg_min(severity, {_SEV}) AS top_severity,
       CAST(count(DISTINCT location) AS BIGINT) AS locations,
       CAST(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS BIGINT) AS impact
FROM j GROUP BY 1, 2"""),
    "a07_pattern_pivot": O.with_views(O.SNAPSHOTS, """j AS (SELECT a.project_id, ap.name FROM anti_patterns ap JOIN analyses a ON a.analysis_id = ap.analysis_id)
SELECT project_id, """ + ", ".join(
        f"CAST(count(*) FILTER (WHERE name = '{n}') AS BIGINT) AS {n.lower().replace(' ', '_')}"
        for n in adapters.AP_NAMES) + " FROM j GROUP BY 1"),
}
