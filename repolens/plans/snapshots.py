"""Snapshot history (D6/D7 from events) and store queries: W01-W10, S06-S08."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.operators import snapshots as W
from repolens.sources import store as S


def _snap(spark, base):
    return adapters.analyses(spark, base), adapters.anti_patterns(spark, base)


def q_latest(spark, base):
    a, ap = _snap(spark, base)
    return W.latest_analysis(a, ap)


def q_list(spark, base):
    a, ap = _snap(spark, base)
    return W.list_analyses(a, ap, 50)


def q_history(spark, base):
    a, _ = _snap(spark, base)
    return W.score_history(a, 100)


def q_history_newest(spark, base):
    a, _ = _snap(spark, base)
    return W.score_history(a, 20, newest=True)


def q_delta(spark, base):
    a, _ = _snap(spark, base)
    return W.score_delta(a)


def q_trends(spark, base):
    a, ap = _snap(spark, base)
    return W.pattern_trends(a, ap)


def q_recurring(spark, base):
    a, ap = _snap(spark, base)
    return W.recurring(W.pattern_trends(a, ap), 3)


def q_top_hubs(spark, base):
    e, _ = adapters.supplier_graph(spark, base)
    return W.top_hubs(e, 10)


def q_store_stats(spark, base):
    a, ap = _snap(spark, base)
    return W.store_stats({"projects": adapters.projects(spark, base), "analyses": a,
                          "anti_patterns": ap, "decisions": adapters.decisions(spark, base)})


def q_suggest(spark, base):
    a, ap = _snap(spark, base)
    return W.suggest_rules(a, ap)


def q_compare_scores(spark, base):
    a, _ = _snap(spark, base)
    h, b = W.split_head_base(a)
    return W.compare_scores(h, b)


def q_compare_patterns(spark, base):
    a, ap = _snap(spark, base)
    h, b = W.split_head_base(a)
    return W.compare_patterns(h, b, ap)


def q_context(spark, base):
    a, ap = _snap(spark, base)
    return W.project_context(adapters.projects(spark, base), a, ap)


def q_flow_top(spark, base):
    e, _ = adapters.supplier_graph(spark, base)
    return W.flow_top(e, 15)


def q_graph_nodes(spark, base):
    e, _ = adapters.supplier_graph(spark, base)
    return W.graph_extract(e)[0]


def q_graph_links(spark, base):
    e, _ = adapters.supplier_graph(spark, base)
    return W.graph_extract(e)[1]


def _pub_projects(df):
    return df.select("project_id", "path", "name", F.array_join("languages", ",").alias("languages"),
                     F.array_join("frameworks", ",").alias("frameworks"), "total_files", "total_lines",
                     W.fmt_ts(F.col("created_at")).alias("created_at"),
                     W.fmt_ts(F.col("updated_at")).alias("updated_at"))


def q_upsert(spark, base):
    return _pub_projects(S.upsert_projects(adapters.projects(spark, base, "old"),
                                           adapters.projects(spark, base, "new")))


def q_latest_decisions(spark, base):
    return S.latest_decisions(adapters.decisions(spark, base))


EXPORT_BLOCK = 20  # items per document of the registered export: histories here are short


def q_export(spark, base):
    a, ap = _snap(spark, base)
    return S.export_history(adapters.projects(spark, base), a, W.pattern_trends(a, ap),
                            adapters.decisions(spark, base), block=EXPORT_BLOCK)


QUERIES = {
    "w01_latest_analysis": q_latest,
    "w02_list_analyses": q_list,
    "w02_score_history": q_history,
    "w02_score_history_newest": q_history_newest,
    "w03_score_delta": q_delta,
    "w04_pattern_trends": q_trends,
    "w04_recurring_patterns": q_recurring,
    "w05_top_hubs": q_top_hubs,
    "w06_store_stats": q_store_stats,
    "w07_suggest_rules": q_suggest,
    "w08_compare_scores": q_compare_scores,
    "w08_compare_patterns": q_compare_patterns,
    "w09_project_context": q_context,
    "w10_flow_top": q_flow_top,
    "w10_graph_nodes": q_graph_nodes,
    "w10_graph_links": q_graph_links,
    "s06_upsert_projects": q_upsert,
    "s07_latest_decisions": q_latest_decisions,
    "s08_export_history": q_export,
}

# ------------------------------------------------------------------ SQL ----
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
PUB = ("analysis_id, project_id, " + TS.format(c="ts") + " AS ts, "
       + ", ".join(f"{O.r6(c)} AS {c}" for c in ["overall", "modularity", "coupling", "cohesion", "layering"])
       + ", nodes, edges")
NEWEST = "row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, analysis_id DESC)"
OLDEST = "row_number() OVER (PARTITION BY project_id ORDER BY ts ASC, analysis_id ASC)"
APC = "apc AS (SELECT analysis_id, count(*) AS c FROM anti_patterns GROUP BY 1)"
TRENDS = f"""tr AS (
  SELECT a.project_id, ap.name, ap.severity, CAST(count(*) AS BIGINT) AS occurrences,
         {TS.format(c='min(a.ts)')} AS first_seen, {TS.format(c='max(a.ts)')} AS last_seen
  FROM anti_patterns ap JOIN analyses a ON ap.analysis_id = a.analysis_id
  GROUP BY a.project_id, ap.name, ap.severity)"""
NL = "chr(10)"


def _section(name: str, source: str, order: str, item: str) -> str:
    """One section of the export: JSON arrays of blocks in order."""
    return f"""SELECT project_id, '{name}' AS section, CAST((pos - 1) // {EXPORT_BLOCK} AS BIGINT) AS block,
       CAST(count(*) AS BIGINT) AS items, '[' || string_agg(item, ',' ORDER BY pos) || ']' AS doc
FROM (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS pos,
             CAST(to_json({item}) AS VARCHAR) AS item FROM {source} WHERE project_id IN (SELECT project_id FROM projects)) t
GROUP BY 1, 2, 3"""


_score_items = ", ".join(f"'{c}': {O.r6(c)}" for c in ["overall", "modularity", "coupling", "cohesion", "layering"])
EXPORT = " UNION ALL ".join([
    f"""SELECT project_id, 'project' AS section, CAST(0 AS BIGINT) AS block, CAST(1 AS BIGINT) AS items,
       '[' || CAST(to_json({{'project_id': project_id, 'path': path, 'name': name, 'languages': languages,
         'frameworks': frameworks, 'total_files': total_files, 'total_lines': total_lines,
         'created_at': {TS.format(c='created_at')}, 'updated_at': {TS.format(c='updated_at')}}}) AS VARCHAR) || ']' AS doc
FROM projects""",
    _section("analyses", "analyses", "ts DESC, analysis_id DESC",
             f"{{'ts': {TS.format(c='ts')}, 'analysis_id': analysis_id, {_score_items}}}"),
    _section("score_history", "analyses", "ts, analysis_id", f"{{'ts': {TS.format(c='ts')}, 'overall': {O.r6('overall')}}}"),
    _section("anti_pattern_trends", "tr", "occurrences DESC, name, severity",
             "{'name': name, 'severity': severity, 'occurrences': occurrences, 'first_seen': first_seen, 'last_seen': last_seen}"),
    _section("decisions", "decisions", "updated_at DESC, record_id DESC",
             f"{{'updated_at': {TS.format(c='updated_at')}, 'decision_id': decision_id, 'title': title, 'status': status}}"),
])


def f1(x: str) -> str:
    return f"printf('%.1f', {O.jsr(x, 1)})"


SUGGEST = f"""rk AS (SELECT *, {NEWEST} AS rn FROM analyses),
st AS (SELECT project_id, count(*) AS n, min(CASE WHEN rn <= 5 THEN overall END) AS min_recent,
              avg(CASE WHEN rn <= 5 THEN overall END) AS avg_recent,
              count(CASE WHEN rn <= 5 THEN 1 END) AS n_recent,
              max(CASE WHEN rn = 1 THEN coupling END) AS latest_coupling
       FROM rk WHERE rn <= 20 GROUP BY 1),
{TRENDS},
s AS (
  SELECT project_id, 1 AS strategy, 'quality_gate' AS type,
         'quality_gates:' || {NL} || '  min_overall_score: ' || CAST(CAST(floor(min_recent - 5) AS BIGINT) AS VARCHAR) AS yaml,
         CASE WHEN avg_recent >= 70 THEN 'high' ELSE 'medium' END AS confidence,
         printf('%d recent analyses, min=%s, avg=%s', n_recent, {f1('min_recent')}, {f1('avg_recent')}) AS based_on,
         CAST(0 AS BIGINT) AS occ
  FROM st WHERE n >= 3 AND min_recent >= 60 AND avg_recent >= 65
  UNION ALL
  SELECT tr.project_id, 2,
         CASE WHEN name = 'Circular Dependency' THEN 'boundary' ELSE 'anti_pattern_limit' END,
         CASE WHEN name = 'Circular Dependency' THEN 'boundaries:' || {NL} || '  allow_circular_dependencies: false'
              ELSE 'quality_gates:' || {NL} || '  ' ||
                   CASE WHEN severity = 'CRITICAL' THEN 'max_critical_anti_patterns' ELSE 'max_high_anti_patterns' END
                   || ': ' || CAST(CAST(CASE WHEN severity = 'CRITICAL' THEN 0 ELSE floor(occurrences * 0.5) END AS BIGINT) AS VARCHAR)
         END,
         CASE WHEN occurrences >= 5 THEN 'high' ELSE 'medium' END,
         CASE WHEN name = 'Circular Dependency' THEN 'seen ' || CAST(occurrences AS VARCHAR) || ' times from ' || first_seen
              ELSE 'seen ' || CAST(occurrences AS VARCHAR) || ' times as ' || severity END,
         occurrences
  FROM tr JOIN st ON st.project_id = tr.project_id
  WHERE n >= 2 AND occurrences >= 3 AND severity IN ('CRITICAL', 'HIGH')
  UNION ALL
  SELECT project_id, 3, 'quality_gate',
         '# a floor for one dimension:' || {NL} || '# coupling_score_min: 50', 'low',
         'coupling now ' || {f1('latest_coupling')}, CAST(0 AS BIGINT)
  FROM st WHERE n >= 3 AND latest_coupling < 50)
SELECT project_id, type, yaml, confidence, based_on FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, type, yaml ORDER BY strategy, occ DESC, based_on) AS k
  FROM s) t WHERE k = 1"""

HEAD_BASE = f"hb AS (SELECT *, {NEWEST} AS rn FROM analyses)"

CONTEXT = f"""{APC},
{TRENDS},
lt AS (SELECT a.*, CAST(coalesce(apc.c, 0) AS BIGINT) AS anti_pattern_count
       FROM (SELECT *, {NEWEST} AS rn FROM analyses) a LEFT JOIN apc ON apc.analysis_id = a.analysis_id
       WHERE rn = 1),
hs AS (SELECT project_id, count(*) AS n,
              max(CASE WHEN ra = 1 THEN ts END) AS first_ts, max(CASE WHEN ra = 1 THEN overall END) AS first_overall,
              max(CASE WHEN rd = 1 THEN ts END) AS last_ts, max(CASE WHEN rd = 1 THEN overall END) AS last_overall
       FROM (SELECT *, {OLDEST} AS ra, {NEWEST} AS rd FROM analyses) t GROUP BY 1),
tl AS (SELECT project_id, string_agg(line, {NL} ORDER BY k) AS pats FROM (
         SELECT project_id, printf('- %s, %s, %d times, %s until %s', name, severity, occurrences, first_seen, last_seen) AS line,
                row_number() OVER (PARTITION BY project_id ORDER BY occurrences DESC, name, severity) AS k
         FROM tr) t WHERE k <= 10 GROUP BY 1)
SELECT p.project_id, concat_ws({NL},
  concat_ws({NL}, '# ' || p.name, 'at ' || p.path,
            'written in ' || array_to_string(p.languages, ', '), 'built on ' || array_to_string(p.frameworks, ', '),
            printf('%d files, %d lines', p.total_files, p.total_lines), '',
            '## Newest analysis, ' || coalesce({TS.format(c='lt.ts')}, 'none yet')),
  CASE WHEN lt.analysis_id IS NOT NULL THEN concat_ws({NL},
            'score ' || {f1('lt.overall')}, '- modularity ' || {f1('lt.modularity')},
            '- coupling ' || {f1('lt.coupling')}, '- cohesion ' || {f1('lt.cohesion')},
            '- layering ' || {f1('lt.layering')}, printf('%d findings', lt.anti_pattern_count),
            printf('graph of %d files and %d edges', lt.nodes, lt.edges)) END,
  CASE WHEN hs.n > 1 THEN concat_ws({NL}, '', '## Course',
            printf('%d analyses, %s until %s', hs.n, {TS.format(c='hs.first_ts')}, {TS.format(c='hs.last_ts')}),
            'from ' || {f1('first_overall')} || ' to ' || {f1('last_overall')} || ', '
            || CASE WHEN last_overall - first_overall >= 0 THEN '+' ELSE '' END || {f1('last_overall - first_overall')}) END,
  CASE WHEN tl.pats IS NOT NULL THEN concat_ws({NL}, '', '## Findings that come back', tl.pats) END) AS text
FROM projects p LEFT JOIN lt ON lt.project_id = p.project_id LEFT JOIN hs ON hs.project_id = p.project_id
LEFT JOIN tl ON tl.project_id = p.project_id"""


def _mod2(c: str) -> str:
    from repolens.functions.paths import SOURCE_ROOTS
    parts = f"string_split({c}, '/')"
    return (f"CASE WHEN len({parts}) < 2 THEN 'root' WHEN {parts}[1] IN {O.in_list(SOURCE_ROOTS)} "
            f"AND len({parts}) > 2 THEN {parts}[2] ELSE {parts}[1] END")


GRAPH = f"""re AS (SELECT DISTINCT project_id, src AS path FROM edges),
en AS (SELECT project_id, src AS path FROM edges UNION ALL SELECT project_id, dst AS path FROM edges),
cn AS (SELECT en.project_id, en.path, count(*) AS c FROM en JOIN re ON re.project_id = en.project_id AND re.path = en.path
       GROUP BY 1, 2),
nd AS (SELECT re.project_id, re.path, CAST(coalesce(cn.c, 0) AS BIGINT) AS connections, 'Other' AS layer
       FROM re LEFT JOIN cn ON cn.project_id = re.project_id AND cn.path = re.path),
sh AS (SELECT project_id, sum(CASE WHEN layer = 'Other' THEN 1 ELSE 0 END) / count(*) AS other_share FROM nd GROUP BY 1),
tp AS (SELECT nd.project_id, nd.path, connections,
              CASE WHEN other_share > {O.d(0.7)} THEN {_mod2('nd.path')} ELSE layer END AS "group",
              CAST(row_number() OVER (PARTITION BY nd.project_id ORDER BY connections DESC, nd.path) AS BIGINT) AS rank
       FROM nd JOIN sh ON sh.project_id = nd.project_id)"""

_S = O.SNAPSHOTS
_EV = O.EVENTS

SQL = {
    "w01_latest_analysis": O.with_views(_S, f"""{APC}
SELECT {PUB}, CAST(coalesce(c, 0) AS BIGINT) AS anti_pattern_count
FROM (SELECT *, {NEWEST} AS rn FROM analyses) a LEFT JOIN apc USING (analysis_id) WHERE rn = 1"""),
    "w02_list_analyses": O.with_views(_S, f"""{APC}
SELECT {PUB}, CAST(rank AS BIGINT) AS rank, CAST(coalesce(c, 0) AS BIGINT) AS anti_pattern_count
FROM (SELECT *, {NEWEST} AS rank FROM analyses) a LEFT JOIN apc USING (analysis_id) WHERE rank <= 50"""),
    "w02_score_history": O.with_views(_S, f"""h AS (SELECT * FROM (SELECT *, {OLDEST} AS k FROM analyses) t WHERE k <= 100)
SELECT project_id, analysis_id, {TS.format(c='ts')} AS ts, CAST({OLDEST} AS BIGINT) AS pos,
       {', '.join(f'{O.r6(c)} AS {c}' for c in ['overall', 'modularity', 'coupling', 'cohesion', 'layering'])}
FROM h"""),
    "w02_score_history_newest": O.with_views(_S, f"""h AS (SELECT * FROM (SELECT *, {NEWEST} AS k FROM analyses) t WHERE k <= 20)
SELECT project_id, analysis_id, {TS.format(c='ts')} AS ts, CAST({OLDEST} AS BIGINT) AS pos,
       {', '.join(f'{O.r6(c)} AS {c}' for c in ['overall', 'modularity', 'coupling', 'cohesion', 'layering'])}
FROM h"""),
    "w03_score_delta": O.with_views(_S, f"""d AS (
  SELECT project_id, overall, lead(overall) OVER (PARTITION BY project_id ORDER BY ts DESC, analysis_id DESC) AS previous,
         {NEWEST} AS rn FROM analyses)
SELECT project_id, {O.r6('overall')} AS current, {O.r6('previous')} AS previous, {O.r6('overall - previous')} AS delta
FROM d WHERE rn = 1 AND previous IS NOT NULL"""),
    "w04_pattern_trends": O.with_views(_S, TRENDS + "\nSELECT * FROM tr"),
    "w04_recurring_patterns": O.with_views(_S, TRENDS + "\nSELECT * FROM tr WHERE occurrences >= 3"),
    "w05_top_hubs": O.with_views(O.SUPPLIER_GRAPH, """fi AS (SELECT project_id, dst AS path, CAST(count(*) AS BIGINT) AS fan_in FROM edges GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY fan_in DESC, path) AS BIGINT) AS rank FROM fi) t
WHERE rank <= 10"""),
    "w06_store_stats": O.with_views(_S + ",\n" + O.projects_sql() + ",\n" + O.DECISIONS, """x AS (SELECT 1)
SELECT 'projects' AS table_name, CAST(count(*) AS BIGINT) AS rows FROM projects
UNION ALL SELECT 'analyses', count(*) FROM analyses
UNION ALL SELECT 'anti_patterns', count(*) FROM anti_patterns
UNION ALL SELECT 'decisions', count(*) FROM decisions"""),
    "w07_suggest_rules": O.with_views(_S, SUGGEST),
    "w08_compare_scores": O.with_views(_S, HEAD_BASE + f"""
SELECT h.project_id, {O.r6('h.overall')} AS head_score, {O.r6('b.overall')} AS base_score,
       {O.r6('h.overall - b.overall')} AS delta,
       CASE WHEN b.overall IS NULL THEN 'first scan' WHEN h.overall - b.overall > 0 THEN 'improved'
            WHEN h.overall - b.overall < 0 THEN 'regressed' ELSE 'stable' END AS label
FROM (SELECT * FROM hb WHERE rn = 1) h LEFT JOIN (SELECT * FROM hb WHERE rn = 2) b ON b.project_id = h.project_id"""),
    "w08_compare_patterns": O.with_views(_S, HEAD_BASE + """,
hp AS (SELECT DISTINCT h.project_id, ap.name, ap.severity, ap.location FROM anti_patterns ap
       JOIN hb h ON ap.analysis_id = h.analysis_id WHERE h.rn = 1),
bp AS (SELECT DISTINCT h.project_id, ap.name, ap.severity, ap.location FROM anti_patterns ap
       JOIN hb h ON ap.analysis_id = h.analysis_id WHERE h.rn = 2)
SELECT *, 'added' AS status FROM (SELECT * FROM hp EXCEPT ALL SELECT * FROM bp) a
UNION ALL SELECT *, 'fixed' FROM (SELECT * FROM bp EXCEPT ALL SELECT * FROM hp) f
UNION ALL SELECT *, 'kept' FROM (SELECT * FROM hp INTERSECT SELECT * FROM bp) k"""),
    "w09_project_context": O.with_views(_S + ",\n" + O.projects_sql(), CONTEXT),
    "w10_flow_top": O.with_views(O.SUPPLIER_GRAPH, f"""fl AS (SELECT project_id, src, dst, sum(weight) AS weight FROM edges GROUP BY 1, 2, 3)
SELECT project_id, src, dst, {O.r6('weight')} AS weight, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, src, dst) AS BIGINT) AS rank FROM fl) t
WHERE rank <= 15"""),
    "w10_graph_nodes": O.with_views(O.SUPPLIER_GRAPH, GRAPH + "\nSELECT * FROM tp WHERE rank <= 60"),
    "w10_graph_links": O.with_views(O.SUPPLIER_GRAPH, GRAPH + """
SELECT e.project_id, e.dst, e.src FROM edges e
WHERE EXISTS (SELECT 1 FROM tp WHERE tp.rank <= 60 AND tp.project_id = e.project_id AND tp.path = e.src)
  AND EXISTS (SELECT 1 FROM tp WHERE tp.rank <= 60 AND tp.project_id = e.project_id AND tp.path = e.dst)"""),
    "s08_export_history": O.with_views(_S + ",\n" + O.projects_sql() + ",\n" + O.DECISIONS, TRENDS + "\n" + EXPORT),
    "s06_upsert_projects": O.with_views(_EV + ",\n" + O.projects_sql("p_old", "old") + ",\n"
                                        + O.projects_sql("p_new", "new"), f"""u AS (SELECT * FROM p_old UNION ALL SELECT * FROM p_new),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC, project_id DESC) AS rn,
             min(created_at) OVER (PARTITION BY path) AS first_created FROM u)
SELECT project_id, path, name, array_to_string(languages, ',') AS languages, array_to_string(frameworks, ',') AS frameworks,
       total_files, total_lines, {TS.format(c='first_created')} AS created_at, {TS.format(c='updated_at')} AS updated_at
FROM r WHERE rn = 1"""),
    "s07_latest_decisions": O.with_views(_EV + ",\n" + O.DECISIONS, """r AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, decision_id ORDER BY updated_at DESC, record_id DESC) AS rn,
         count(*) OVER (PARTITION BY project_id, decision_id) AS updates FROM decisions)
SELECT project_id, decision_id, title, status, CAST(updates AS BIGINT) AS updates FROM r WHERE rn = 1"""),
}
