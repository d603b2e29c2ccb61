"""Review verdict (B11) on the latest stored snapshot of each project."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.operators import rules as RU
from repolens.operators import snapshots as W
from repolens.plans.rules_q import RULES
from repolens.sources.store import rules_df
from repolens.streaming.jobs import check_snapshots


def q_review(spark, base):
    a, ap = adapters.analyses(spark, base), adapters.anti_patterns(spark, base)
    w = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("analysis_id"))
    latest = a.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    viol = check_snapshots(latest, ap, rules_df(spark, {"quality_gates": RULES["quality_gates"]}))
    deltas = W.score_delta(a)
    return RU.review(latest.select("project_id", "analysis_id", "overall"), ap, viol, deltas)


QUERIES = {"b11_review": q_review}

_qg = RULES["quality_gates"]


def _num(x):
    return f"regexp_replace(regexp_replace(printf('%.2f', {x}), '0+$', ''), '\\.$', '')"


SQL = {"b11_review": O.with_views(O.SNAPSHOTS, f"""lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id
       ORDER BY ts DESC, analysis_id DESC) AS rn FROM analyses) t WHERE rn = 1),
pv AS (SELECT * FROM (SELECT project_id, overall, lead(overall) OVER (PARTITION BY project_id ORDER BY ts DESC, analysis_id DESC) AS prev,
       row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, analysis_id DESC) AS rn FROM analyses) t
       WHERE rn = 1 AND prev IS NOT NULL),
dl AS (SELECT project_id, {O.r6('overall - prev')} AS delta FROM pv),
cnt AS (SELECT ap.analysis_id, sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS critical,
               sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS high FROM anti_patterns ap
        JOIN lt ON lt.analysis_id = ap.analysis_id GROUP BY 1),
j AS (SELECT lt.project_id, lt.analysis_id, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
             (CASE WHEN CAST(floor(lt.overall + 0.5) AS BIGINT) < {_qg['min_overall_score']} THEN 1 ELSE 0 END)
             + (CASE WHEN coalesce(critical, 0) > {_qg['max_critical_anti_patterns']} THEN 1 ELSE 0 END)
             + (CASE WHEN coalesce(high, 0) > {_qg['max_high_anti_patterns']} THEN 1 ELSE 0 END) AS violations, dl.delta
      FROM lt LEFT JOIN cnt ON cnt.analysis_id = lt.analysis_id LEFT JOIN dl ON dl.project_id = lt.project_id),
iss AS (SELECT *, list_filter([CASE WHEN critical > 0 THEN printf('%d CRITICAL anti-patterns', critical) END,
                               CASE WHEN high > 0 THEN printf('%d HIGH anti-patterns', high) END,
                               CASE WHEN violations > 0 THEN printf('%d rule violations', violations) END,
                               CASE WHEN delta < -5 THEN 'score down ' || {_num('abs(delta)')} END],
                              lambda x: x IS NOT NULL) AS l FROM j)
SELECT project_id, analysis_id, CAST(critical AS BIGINT) AS critical, CAST(high AS BIGINT) AS high,
       CAST(violations AS BIGINT) AS violations, array_to_string(l, ', ') AS issues,
       CASE WHEN len(l) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM iss""")}
