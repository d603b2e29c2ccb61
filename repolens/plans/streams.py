"""Streaming jobs, registered through their batch twins (same DataFrame
transformations; the streams themselves are exercised in tests/)."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.plans.rules_q import RULES
from repolens.sources.store import rules_df
from repolens.streaming import jobs as J


def q_event_log(spark, base):
    return J.event_log(adapters.raw_events(spark, base)).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def q_constraints(spark, base):
    return J.constraints_batch(adapters.violations(spark, base)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def _degr(spark, base):
    return J.degradation_batch(adapters.analyses(spark, base))


def q_degradations(spark, base):
    d = _degr(spark, base)
    return d.select("project_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                    *[F.floor(F.col(c) * 1e6 + 0.5).alias(c) for c in ("previous_score", "current_score", "delta")])


def q_floors(spark, base):
    f = J.floor_constraints(_degr(spark, base))
    return f.select("project_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "rule",
                    "message", F.floor(F.col("actual") * 1e6 + 0.5).alias("actual"), "expected")


def q_timeline(spark, base):
    return J.timeline_windows(adapters.commits(spark, base)).withColumn(
        "week", F.date_format("week", "yyyy-MM-dd"))


def q_check(spark, base):
    return J.check_snapshots(adapters.analyses(spark, base), adapters.anti_patterns(spark, base),
                             rules_df(spark, {"quality_gates": RULES["quality_gates"]}))


QUERIES = {
    "t06_event_log": q_event_log,
    "t01_constraints": q_constraints,
    "t02_degradations": q_degradations,
    "t03_floor_constraints": q_floors,
    "t04_weekly_windows": q_timeline,
    "t05_check_snapshots": q_check,
}

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
_kinds = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in adapters.KIND_BY_EVENT_TYPE.items()) + " END"
_rules = "[" + ", ".join(f"'{r}'" for r in adapters.VIOLATION_RULES) + "]"
DEGR = """dg AS (SELECT project_id, ts, previous_score, overall AS current_score, overall - previous_score AS delta FROM (
  SELECT *, lag(overall) OVER (PARTITION BY project_id ORDER BY ts, analysis_id) AS previous_score FROM analyses) t
  WHERE overall - previous_score < -3)"""


def _f6(c):
    return f"floor({c} * {O.d(1e6)} + 0.5)"


_qg = RULES["quality_gates"]

SQL = {
    "t06_event_log": O.with_views(O.EVENTS, f"""raw AS (
  SELECT event_id, ts, 'u' || CAST(user_id AS VARCHAR) AS project_id, {_kinds} AS kind, value, k FROM ev)
SELECT event_id, {TS.format(c='ts')} AS ts, project_id, kind,
       CASE WHEN kind IN ('analysis.completed', 'violation.detected') THEN value END AS score,
       CASE WHEN kind IN ('analysis.completed', 'violation.detected') THEN k END AS anti_pattern_count,
       CASE WHEN kind = 'score.degraded' THEN value + k END AS previous_score,
       CASE WHEN kind = 'score.degraded' THEN value END AS current_score,
       CASE WHEN kind = 'score.degraded' THEN -CAST(k AS DOUBLE) END AS delta,
       CASE WHEN kind = 'constraint.created' THEN 'rule-' || CAST(k % 4 AS VARCHAR) END AS rule_type
FROM raw WHERE kind IS NOT NULL"""),
    "t01_constraints": O.with_views(O.EVENTS, f"""vi AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS project_id, ts, {_rules}[CAST(k % 4 + 1 AS INTEGER)] AS rule,
         CASE WHEN k % 2 = 0 THEN 'error' ELSE 'warning' END AS level, 'violation ' || CAST(k AS VARCHAR) AS message
  FROM ev WHERE event_type = 'error')
SELECT project_id, rule AS rule_type, level, message, {TS.format(c='ts')} AS created_at, true AS active FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY ts, level, message) AS rn FROM vi) t WHERE rn = 1"""),
    "t02_degradations": O.with_views(O.ANALYSES, DEGR + f"""
SELECT project_id, {TS.format(c='ts')} AS ts, {_f6('previous_score')} AS previous_score,
       {_f6('current_score')} AS current_score, {_f6('delta')} AS delta FROM dg"""),
    "t03_floor_constraints": O.with_views(O.ANALYSES, DEGR + f"""
SELECT project_id, {TS.format(c='ts')} AS ts, 'warning' AS level, 'auto.min_score_floor' AS rule,
       printf('Auto-generated: score dropped from %.1f to %.1f', floor(previous_score * 10 + 0.5) / 10,
              floor(current_score * 10 + 0.5) / 10) AS message,
       {_f6('current_score')} AS actual, CAST(floor(current_score - {O.d(2.0)}) AS BIGINT) AS expected FROM dg"""),
    "t04_weekly_windows": O.with_views(O.FILE_CHANGES, """cm AS (
  SELECT project_id, commit_id, min(ts) AS ts, sum(additions + deletions) AS churn, count(*) AS files FROM changes GROUP BY 1, 2)
SELECT project_id, strftime(CAST(date_trunc('week', ts) AS DATE), '%Y-%m-%d') AS week, CAST(count(*) AS BIGINT) AS commits,
       CAST(sum(churn) AS BIGINT) AS churn, CAST(sum(files) AS BIGINT) AS active_files FROM cm GROUP BY 1, 2"""),
    "t05_check_snapshots": O.with_views(O.SNAPSHOTS, f"""per AS (
  SELECT a.analysis_id, a.project_id, CAST(floor(a.overall + 0.5) AS BIGINT) AS overall,
         count(*) FILTER (WHERE ap.severity = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE ap.severity = 'HIGH') AS n_high
  FROM analyses a LEFT JOIN anti_patterns ap ON ap.analysis_id = a.analysis_id GROUP BY 1, 2, 3)
SELECT project_id, analysis_id, 'error' AS level, 'quality_gates.min_overall_score' AS rule,
       'overall score ' || CAST(overall AS VARCHAR) || ', at least {_qg['min_overall_score']}' AS message,
       CAST(overall AS VARCHAR) AS actual, '{_qg['min_overall_score']}' AS expected
FROM per WHERE overall < {_qg['min_overall_score']}
UNION ALL
SELECT project_id, analysis_id, 'error', 'quality_gates.max_critical_anti_patterns',
       'critical findings ' || CAST(n_critical AS VARCHAR) || ', at most {_qg['max_critical_anti_patterns']}',
       CAST(n_critical AS VARCHAR), '{_qg['max_critical_anti_patterns']}'
FROM per WHERE n_critical > {_qg['max_critical_anti_patterns']}
UNION ALL
SELECT project_id, analysis_id, 'warning', 'quality_gates.max_high_anti_patterns',
       'high findings ' || CAST(n_high AS VARCHAR) || ', at most {_qg['max_high_anti_patterns']}',
       CAST(n_high AS VARCHAR), '{_qg['max_high_anti_patterns']}'
FROM per WHERE n_high > {_qg['max_high_anti_patterns']}"""),
}
