"""History core on the order-based change log (D5): H01-H07.

The analysed period is the reference's default: the 24 weeks before the
newest change.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.operators import history as H
from repolens.session import materialize


def changes_in_period(spark, base):
    """The analysed period of the change log, written once (it feeds file,
    module, author and coupling branches)."""
    as_of = adapters.newest_change(spark, base)
    start = H.period_start(as_of)
    return materialize(adapters.file_changes(spark, base, start, as_of)), F.lit(as_of).cast("timestamp")


def q_file_history(spark, base):
    pc, a = changes_in_period(spark, base)
    return H.file_history(pc, a)


def q_hotspots(spark, base):
    pc, a = changes_in_period(spark, base)
    return H.hotspots(H.file_history(pc, a)).select("project_id", "path", "churn", "weekly_rate", "rank")


def q_module_history(spark, base):
    pc, a = changes_in_period(spark, base)
    return H.module_history(pc, H.file_history(pc, a))


def q_velocity(spark, base):
    pc, a = changes_in_period(spark, base)
    return H.velocity(H.file_history(pc, a))


def q_change_coupling(spark, base):
    pc, _ = changes_in_period(spark, base)
    return H.change_coupling(pc, top=H.COUPLING_TOP)


def q_change_coupling_all(spark, base):
    pc, _ = changes_in_period(spark, base)
    return H.change_coupling(pc, top=None)


def q_weekly_timeline(spark, base):
    pc, a = changes_in_period(spark, base)
    return H.weekly_timeline(pc, a).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def q_totals(spark, base):
    pc, _ = changes_in_period(spark, base)
    return H.history_totals(pc)


QUERIES = {
    "h01_file_history": q_file_history,
    "h02_hotspots": q_hotspots,
    "h03_module_history": q_module_history,
    "h04_velocity": q_velocity,
    "h05_change_coupling": q_change_coupling,
    "h05_change_coupling_all": q_change_coupling_all,
    "h06_weekly_timeline": q_weekly_timeline,
    "h07_history_totals": q_totals,
}

FH_SQL = f"""fh0 AS (
  SELECT project_id, path, as_of, count(*) AS commits, sum(additions) AS additions,
         sum(deletions) AS deletions, count(DISTINCT author) AS authors, max(ts) AS last_ts,
         count(DISTINCT CASE WHEN ts >= as_of - INTERVAL 28 DAYS THEN commit_id END) AS recent
  FROM pc GROUP BY project_id, path, as_of),
fh AS (
  SELECT project_id, path, {O.module_top('path')} AS module, CAST(commits AS BIGINT) AS commits,
         CAST(additions AS BIGINT) AS additions, CAST(deletions AS BIGINT) AS deletions,
         CAST(additions + deletions AS BIGINT) AS churn,
         {O.r6('(additions + deletions) / commits')} AS churn_rate,
         CAST(authors AS BIGINT) AS authors, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_modified,
         {O.r6('recent / ' + O.d(4.0))} AS weekly_rate,
         (additions + deletions >= 500 AND recent / {O.d(4.0)} >= 1) AS is_hotspot
  FROM fh0)"""

VEL_SQL = """vr AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, module ORDER BY last_modified DESC, path) AS pos,
         count(*) OVER (PARTITION BY project_id, module) AS n
  FROM fh),
vg AS (
  SELECT project_id, module,
         avg(CASE WHEN pos <= greatest(floor(n / 2), 1) THEN weekly_rate END) AS rr,
         avg(CASE WHEN pos > greatest(floor(n / 2), 1) THEN weekly_rate END) AS orr0,
         avg(CASE WHEN pos <= greatest(floor(n / 2), 1) THEN churn_rate END) AS rc,
         avg(CASE WHEN pos > greatest(floor(n / 2), 1) THEN churn_rate END) AS oc0
  FROM vr GROUP BY project_id, module),
vel0 AS (
  SELECT project_id, module,
         CASE WHEN coalesce(orr0, rr) > 0 THEN (rr - coalesce(orr0, rr)) / coalesce(orr0, rr) * 100 ELSE 0.0 END AS acc,
         CASE WHEN coalesce(oc0, rc) > 0 THEN (rc - coalesce(oc0, rc)) / coalesce(oc0, rc) * 100 ELSE 0.0 END AS tr
  FROM vg),
vel AS (
  SELECT project_id, module, """ + O.jsr("acc", 1) + " AS commit_acceleration, " + O.jsr("tr", 1) + """ AS churn_trend,
         CASE WHEN acc > 15 THEN 'accelerating' WHEN acc < -15 THEN 'decelerating' ELSE 'stable' END AS direction
  FROM vel0)"""

COUPLING_SQL = """cpc AS (SELECT DISTINCT project_id, commit_id, path FROM pc),
cp AS (SELECT a.project_id, a.path AS file_a, b.path AS file_b, count(*) AS cochanges
       FROM cpc a JOIN cpc b ON a.project_id = b.project_id AND a.commit_id = b.commit_id AND a.path < b.path
       GROUP BY 1, 2, 3 HAVING count(*) >= 3),
fcnt AS (SELECT project_id, path, count(*) AS n FROM pc GROUP BY 1, 2),
cc AS (SELECT cp.project_id, file_a, file_b, CAST(cochanges AS BIGINT) AS cochanges,
              """ + O.jsr("cochanges / greatest(coalesce(x.n, 1), coalesce(y.n, 1))", 2) + """ AS confidence
       FROM cp LEFT JOIN fcnt x ON x.project_id = cp.project_id AND x.path = file_a
       LEFT JOIN fcnt y ON y.project_id = cp.project_id AND y.path = file_b)"""

_V = O.FILE_CHANGES

# module history (H03) as a CTE named mhist, on top of fh and vel
MH_CTE = FH_SQL + ",\n" + VEL_SQL + """,
ma AS (SELECT project_id, module, count(*) AS files, sum(commits) AS commits, sum(churn) AS churn,
              avg(weekly_rate) AS avg_weekly_rate FROM fh GROUP BY 1, 2),
mau AS (SELECT project_id, """ + O.module_top("path") + """ AS module, count(DISTINCT author) AS authors
        FROM pc GROUP BY 1, 2),
mh AS (SELECT project_id, module, string_agg(path, ',' ORDER BY rk) AS top_hotspots FROM (
         SELECT *, row_number() OVER (PARTITION BY project_id, module ORDER BY churn DESC, path) AS rk
         FROM fh WHERE is_hotspot) t WHERE rk <= 5 GROUP BY 1, 2),
mhist AS (
SELECT ma.project_id, ma.module, CAST(files AS BIGINT) AS files, CAST(commits AS BIGINT) AS commits,
       CAST(churn AS BIGINT) AS churn, """ + O.r6("avg_weekly_rate") + """ AS avg_weekly_rate,
       CAST(coalesce(authors, 0) AS BIGINT) AS authors, coalesce(top_hotspots, '') AS top_hotspots,
       commit_acceleration, churn_trend, direction
FROM ma LEFT JOIN mau USING (project_id, module) LEFT JOIN mh USING (project_id, module)
LEFT JOIN vel USING (project_id, module))"""

# weekly timeline (H06) as a CTE named tl
TL_CTE = """lm AS (SELECT CAST(date_trunc('week', a) AS DATE) AS m FROM ref_ts),
cal AS (SELECT p.project_id, CAST(lm.m - INTERVAL (7 * w) DAY AS DATE) AS week
        FROM (SELECT DISTINCT project_id FROM pc) p, lm, range(0, 24) r(w)),
pcm AS (SELECT project_id, commit_id, min(ts) AS ts, sum(additions + deletions) AS churn, count(*) AS files
        FROM pc GROUP BY 1, 2),
wk AS (SELECT project_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS commits,
              sum(churn) AS churn, sum(files) AS active_files FROM pcm GROUP BY 1, 2),
tl AS (SELECT cal.project_id, cal.week, CAST(coalesce(commits, 0) AS BIGINT) AS commits,
       CAST(coalesce(churn, 0) AS BIGINT) AS churn, CAST(coalesce(active_files, 0) AS BIGINT) AS active_files
FROM cal LEFT JOIN wk ON wk.project_id = cal.project_id AND wk.week = cal.week)"""

SQL = {
    "h01_file_history": O.with_views(_V, FH_SQL + "\nSELECT * FROM fh"),
    "h02_hotspots": O.with_views(_V, FH_SQL + """
SELECT project_id, path, churn, weekly_rate, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY churn DESC, path) AS rank
  FROM fh WHERE is_hotspot) t WHERE rank <= 20"""),
    "h04_velocity": O.with_views(_V, FH_SQL + ",\n" + VEL_SQL + "\nSELECT * FROM vel"),
    "h03_module_history": O.with_views(_V, MH_CTE + "\nSELECT * FROM mhist"),
    "h05_change_coupling": O.with_views(_V, COUPLING_SQL + """
SELECT project_id, file_a, file_b, cochanges, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, cochanges DESC, file_a, file_b) AS r
  FROM cc) t WHERE r <= 50"""),
    "h05_change_coupling_all": O.with_views(_V, COUPLING_SQL + "\nSELECT * FROM cc"),
    "h06_weekly_timeline": O.with_views(_V, """lm AS (SELECT CAST(date_trunc('week', a) AS DATE) AS m FROM ref_ts),
cal AS (SELECT p.project_id, CAST(lm.m - INTERVAL (7 * w) DAY AS DATE) AS week
        FROM (SELECT DISTINCT project_id FROM pc) p, lm, range(0, 24) r(w)),
pcm AS (SELECT project_id, commit_id, min(ts) AS ts, sum(additions + deletions) AS churn, count(*) AS files
        FROM pc GROUP BY 1, 2),
wk AS (SELECT project_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS commits,
              sum(churn) AS churn, sum(files) AS active_files FROM pcm GROUP BY 1, 2)
SELECT cal.project_id, strftime(cal.week, '%Y-%m-%d') AS week, CAST(coalesce(commits, 0) AS BIGINT) AS commits,
       CAST(coalesce(churn, 0) AS BIGINT) AS churn, CAST(coalesce(active_files, 0) AS BIGINT) AS active_files
FROM cal LEFT JOIN wk ON wk.project_id = cal.project_id AND wk.week = cal.week"""),
    "h07_history_totals": O.with_views(_V, """t AS (SELECT 1)
SELECT project_id, CAST(count(DISTINCT commit_id) AS BIGINT) AS total_commits,
       CAST(count(DISTINCT author) AS BIGINT) AS total_authors FROM pc GROUP BY project_id"""),
}
