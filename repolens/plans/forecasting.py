"""Forecasting: temporal scores on the change log (D5) and regressions on the
stored score history (D6): J15, H08, H09, H17-H19, H21-H23, H25."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.functions.core import round6
from repolens.operators import forecast as FC
from repolens.operators import history as H
from repolens.operators.ranking import numbered
from repolens.plans.history import FH_SQL, MH_CTE, TL_CTE, changes_in_period
from repolens.session import materialize


def _modules(spark, base):
    pc, a = changes_in_period(spark, base)
    return H.module_history(pc, H.file_history(pc, a))


def q_static(spark, base):
    return FC.static_scores(_modules(spark, base)).select(
        "project_id", "module", F.col("static_score").cast("bigint").alias("static_score"))


def q_temporal(spark, base):
    return FC.temporal_scores(_modules(spark, base))


def q_overall(spark, base):
    return FC.overall_trend(FC.temporal_scores(_modules(spark, base)))


def _features(spark, base):
    pc, a = changes_in_period(spark, base)
    files = pc.groupBy("project_id").agg(F.count_distinct("path").alias("files"))
    return FC.weekly_features(H.weekly_timeline(pc, a), files)


def q_features(spark, base):
    return _features(spark, base).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def q_reconstruct(spark, base):
    """Weekly scores, anchored on the mean static score of a project's modules."""
    return FC.reconstruct_scores(_features(spark, base), FC.current_scores(_modules(spark, base)))


def _series(spark, base):
    """Stored scores by place in time, written once: the regression reads them twice."""
    a = adapters.analyses(spark, base).select("project_id", "ts", "analysis_id", "overall")
    n = numbered(a, ["project_id"], ["ts", "analysis_id"])
    return materialize(n.select("project_id", (F.col("pos") - 1).cast("double").alias("x"),
                                F.col("overall").alias("y"), F.lit(None).cast("double").alias("w")))


def q_ema(spark, base):
    a = adapters.analyses(spark, base)
    e = FC.ema(a.select("project_id", "ts", "overall"), "project_id", "ts", "overall")
    return e.select("project_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                    round6("overall").alias("overall"), round6("ema").alias("ema"))


def q_wls(spark, base):
    return FC.wls(_series(spark, base), "project_id")


def q_trajectory(spark, base):
    return FC.trajectory(FC.wls(_series(spark, base), "project_id"), "project_id")


def q_decay(spark, base):
    return FC.decay_forecast(_series(spark, base), "project_id")


def q_daily(spark, base):
    return FC.daily_trend(adapters.analyses(spark, base))


QUERIES = {
    "j15_static_scores": q_static,
    "h08_temporal_scores": q_temporal,
    "h09_overall_trend": q_overall,
    "h17_weekly_features": q_features,
    "h18_reconstruct_scores": q_reconstruct,
    "h19_ema": q_ema,
    "h21_wls": q_wls,
    "h22_trajectory": q_trajectory,
    "h23_decay_forecast": q_decay,
    "h25_daily_trend": q_daily,
}

# ------------------------------------------------------------------ SQL ----
d, jsr = O.d, O.jsr

STATIC = """st AS (SELECT *, CASE WHEN churn / greatest(commits, 1) < 20 THEN 85 WHEN churn / greatest(commits, 1) < 50 THEN 75
                  WHEN churn / greatest(commits, 1) < 100 THEN 65 WHEN churn / greatest(commits, 1) < 200 THEN 50
                  ELSE 35 END AS static_score FROM mhist)"""

TEMPORAL = STATIC + f""",
tp0 AS (SELECT *, greatest({d(-20.0)}, least({d(30.0)},
          CASE WHEN churn_trend > 0 THEN churn_trend * {d(FC.CHURN_WEIGHT)} * {d(0.3)}
               ELSE churn_trend * {d(FC.CHURN_WEIGHT)} * {d(0.1)} END
          + CASE WHEN commit_acceleration > 20 THEN (commit_acceleration - 20) * {d(FC.COMMIT_WEIGHT)} * {d(0.2)}
                 ELSE {d(0.0)} END)) AS penalty FROM st),
tp1 AS (SELECT *, CAST(greatest(0, least(100, floor(static_score - penalty + 0.5))) AS BIGINT) AS temporal_score,
               CASE WHEN churn_trend > 30 OR commit_acceleration > 50 THEN 'degrading'
                    WHEN churn_trend < -10 AND direction <> 'accelerating' THEN 'improving' ELSE 'stable' END AS trend
        FROM tp0),
temporal AS (
  SELECT project_id, module, CAST(static_score AS BIGINT) AS static_score, temporal_score, trend,
         CAST(greatest(0, least(100, floor(temporal_score - penalty / 12 * 12 + 0.5))) AS BIGINT) AS projected_score,
         {jsr(f"greatest({d(0.1)}, least({d(1.0)}, 1 - (abs(churn_trend) + abs(commit_acceleration)) / 200 - {d(12 / 52)}))", 2)} AS confidence,
         CASE WHEN temporal_score < 30 OR (temporal_score < 50 AND trend = 'degrading') THEN 'critical'
              WHEN temporal_score < 50 OR (trend = 'degrading' AND authors <= 1) THEN 'high'
              WHEN temporal_score < 70 OR trend = 'degrading' THEN 'medium' ELSE 'low' END AS risk
  FROM tp1)"""

FEATURES = TL_CTE + f""",
tf AS (SELECT project_id, count(DISTINCT path) AS files FROM pc GROUP BY 1),
mxs AS (SELECT project_id, greatest(max(commits), 1) AS max_c, greatest(max(churn), 1) AS max_ch FROM tl GROUP BY 1),
ft0 AS (SELECT tl.*, commits / max_c AS ci, churn / max_ch AS chi,
               least({d(1.0)}, active_files / greatest(coalesce(tf.files, 0), 1)) AS ar,
               CAST(row_number() OVER (PARTITION BY tl.project_id ORDER BY week) - 1 AS BIGINT) AS week_offset
        FROM tl JOIN mxs ON mxs.project_id = tl.project_id LEFT JOIN tf ON tf.project_id = tl.project_id),
feat AS (SELECT project_id, week_offset, week, {jsr('ci', 3)} AS commit_intensity, {jsr('chi', 3)} AS churn_intensity,
                {jsr('ar', 3)} AS active_file_ratio,
                {jsr(f'{d(0.5)} * chi + {d(0.3)} * ci + {d(0.2)} * ar', 3)} AS complexity_signal FROM ft0)"""

RECON = MH_CTE + ",\n" + STATIC + ",\n" + FEATURES + f""",
anchor AS (SELECT project_id, {jsr('avg(static_score)', 1)} AS cur FROM st GROUP BY 1),
fa AS (SELECT project_id, avg(complexity_signal) AS mean_sig, max(week_offset) AS n1 FROM feat GROUP BY 1),
rec(project_id, i, score) AS (
  SELECT project_id, n1, cur FROM fa JOIN anchor USING (project_id)
  UNION ALL
  SELECT r.project_id, r.i - 1, greatest({d(0.0)}, least({d(100.0)}, r.score + greatest({d(-3.0)}, least({d(3.0)},
         (f.complexity_signal - fa.mean_sig) * {d(3.0)}))))
  FROM rec r JOIN feat f ON f.project_id = r.project_id AND f.week_offset = r.i
  JOIN fa ON fa.project_id = r.project_id WHERE r.i > 0),
sm(project_id, i, e) AS (
  SELECT project_id, i, score FROM rec WHERE i = 0
  UNION ALL
  SELECT s.project_id, s.i + 1, {d(0.3)} * r.score + {d(0.7)} * s.e
  FROM sm s JOIN rec r ON r.project_id = s.project_id AND r.i = s.i + 1)"""

LAM = math.log(2) / FC.HALF_LIFE
SERIES = f"""ser AS (SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ts, analysis_id) - 1 AS DOUBLE) AS x,
                overall AS y, CAST(NULL AS DOUBLE) AS w FROM analyses),
mx AS (SELECT project_id, max(x) AS last_x FROM ser GROUP BY 1),
sw AS (SELECT s.*, mx.last_x, coalesce(w, exp({d(-LAM)} * (mx.last_x - s.x))) AS wt FROM ser s JOIN mx ON mx.project_id = s.project_id),
sums AS (SELECT project_id, count(*) AS n, max(last_x) AS last_x, sum(wt) AS sw, sum(wt * x) AS swx, sum(wt * y) AS swy,
                sum(wt * x * x) AS swxx, sum(wt * x * y) AS swxy FROM sw GROUP BY 1),
co AS (SELECT *, sw * swxx - swx * swx AS det, (n = 1 OR abs(sw * swxx - swx * swx) < {d(1e-10)}) AS flat FROM sums),
co2 AS (SELECT *, CASE WHEN flat THEN {d(0.0)} ELSE (sw * swxy - swx * swy) / det END AS slope_raw,
               CASE WHEN flat THEN swy / sw ELSE (swxx * swy - swx * swxy) / det END AS icpt_raw FROM co),
rs AS (SELECT s.project_id, sum(s.wt * pow(s.y - c.swy / c.sw, 2)) AS ss_tot,
              sum(s.wt * pow(s.y - (c.slope_raw * s.x + c.icpt_raw), 2)) AS ss_res
       FROM sw s JOIN co2 c ON c.project_id = s.project_id GROUP BY 1),
fit0 AS (SELECT c.*, ss_tot, ss_res,
                CASE WHEN flat THEN NULL ELSE sqrt(ss_res / greatest(n - 2, 1) * sw / greatest(det, {d(1e-10)})) END AS se_raw
         FROM co2 c JOIN rs ON rs.project_id = c.project_id),
fit AS (SELECT project_id, CAST(n AS BIGINT) AS n, CAST(last_x AS DOUBLE) AS last_x, {jsr('slope_raw', 3)} AS slope,
               {jsr('icpt_raw', 2)} AS intercept,
               CASE WHEN n = 1 THEN {d(1.0)} WHEN flat THEN {d(0.0)}
                    ELSE {jsr(f'CASE WHEN ss_tot > 0 THEN greatest({d(0.0)}, 1 - ss_res / ss_tot) ELSE {d(0.0)} END', 3)} END AS r2,
               {jsr('se_raw', 3)} AS slope_se,
               CASE WHEN flat THEN false ELSE coalesce(CASE WHEN se_raw > {d(1e-10)} THEN abs(slope_raw / se_raw) > 2
                    WHEN abs(slope_raw) > {d(1e-10)} THEN true ELSE false END, false) END AS significant
        FROM fit0)"""


def clamp1(x):
    return f"greatest({d(0.0)}, least({d(100.0)}, {jsr(x, 1)}))"


TRAJ = f"""SELECT project_id, last_x + dd AS week_offset, {clamp1('slope * (last_x + dd) + intercept')} AS predicted,
       CASE WHEN slope_se IS NULL THEN {d(0.0)} ELSE {clamp1(f'slope * (last_x + dd) + intercept - slope_se * dd * {d(1.96)}')} END AS lower,
       CASE WHEN slope_se IS NULL THEN {d(100.0)} ELSE {clamp1(f'slope * (last_x + dd) + intercept + slope_se * dd * {d(1.96)}')} END AS upper,
       {jsr(f'greatest({d(0.05)}, r2 * exp({d(-0.1)} * dd))', 2)} AS confidence
FROM fit, (SELECT CAST(range AS BIGINT) AS dd FROM range(1, {FC.HORIZON + 1})) r"""

_pred = clamp1(f"slope * (last_x + {FC.HORIZON}) + intercept")
_conf = f"(r2 + least({d(0.2)}, n / {d(120.0)}))"
DECAY = f"""cur AS (SELECT project_id, arg_max(y, x) AS current FROM ser GROUP BY 1)
SELECT f.project_id, CAST(current AS DOUBLE) AS current, {_pred} AS predicted, {jsr(f'{_pred} - current', 1)} AS delta,
       {jsr('slope', 2)} AS weekly_delta,
       CASE WHEN slope >= 0 THEN NULL WHEN current <= {d(FC.CRITICAL_THRESHOLD)} THEN CAST(0 AS BIGINT)
            WHEN ({d(FC.CRITICAL_THRESHOLD)} - intercept) / slope - last_x > 0
              THEN CAST(ceil(({d(FC.CRITICAL_THRESHOLD)} - intercept) / slope - last_x) AS BIGINT)
            ELSE CAST(0 AS BIGINT) END AS weeks_to_threshold,
       {jsr(f'greatest({d(0.05)}, least({d(0.95)}, CASE WHEN significant THEN {_conf} ELSE {_conf} * {d(0.5)} END))', 2)} AS confidence,
       n
FROM fit f JOIN cur ON cur.project_id = f.project_id WHERE n >= {FC.MIN_POINTS}"""

DAILY = f"""hh AS (SELECT * FROM analyses),
t0 AS (SELECT project_id, min(ts) AS t0 FROM hh GROUP BY 1),
hx AS (SELECT hh.project_id, (epoch_us(ts) - epoch_us(t0)) / {d(86400e6)} AS x, overall AS y FROM hh JOIN t0 USING (project_id)),
ds AS (SELECT project_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, max(x) AS last_x
       FROM hx GROUP BY 1 HAVING count(*) >= 3),
ds2 AS (SELECT *, CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE {d(0.0)} END AS slope FROM ds),
ds3 AS (SELECT *, (sy - slope * sx) / n AS icpt FROM ds2),
dr AS (SELECT hx.project_id, sum(pow(y - (slope * x + icpt), 2)) AS ss_res, sum(pow(y - sy / n, 2)) AS ss_tot
       FROM hx JOIN ds3 USING (project_id) GROUP BY 1)
SELECT project_id, CAST(n AS BIGINT) AS n, {jsr('slope', 4)} AS slope_per_day,
       {jsr(f'CASE WHEN ss_tot <> 0 THEN 1 - ss_res / ss_tot ELSE {d(0.0)} END', 4)} AS r2,
       {jsr(f'greatest({d(0.0)}, least({d(100.0)}, slope * (last_x + 30) + icpt))', 1)} AS projected_30d,
       {jsr(f'greatest({d(0.0)}, least({d(100.0)}, slope * (last_x + 90) + icpt))', 1)} AS projected_90d,
       CASE WHEN slope > {d(0.1)} THEN 'improving' WHEN slope < {d(-0.1)} THEN 'degrading' ELSE 'stable' END AS trend
FROM ds3 JOIN dr USING (project_id)"""

EMA = f"""sq AS (SELECT project_id, ts, overall, row_number() OVER (PARTITION BY project_id ORDER BY ts, overall) AS i FROM analyses),
em(project_id, i, e) AS (
  SELECT project_id, i, overall FROM sq WHERE i = 1
  UNION ALL
  SELECT m.project_id, m.i + 1, {d(0.3)} * s.overall + {d(0.7)} * m.e FROM em m
  JOIN sq s ON s.project_id = m.project_id AND s.i = m.i + 1)
SELECT sq.project_id, strftime(sq.ts, '%Y-%m-%d %H:%M:%S') AS ts, {O.r6('sq.overall')} AS overall, {O.r6('em.e')} AS ema
FROM sq JOIN em ON em.project_id = sq.project_id AND em.i = sq.i"""

_V, _A = O.FILE_CHANGES, O.ANALYSES


def _rec(views, body):
    return "WITH RECURSIVE " + views + ",\n" + body


SQL = {
    "j15_static_scores": O.with_views(_V, MH_CTE + ",\n" + STATIC
                                      + "\nSELECT project_id, module, CAST(static_score AS BIGINT) AS static_score FROM st"),
    "h08_temporal_scores": O.with_views(_V, MH_CTE + ",\n" + TEMPORAL + "\nSELECT * FROM temporal"),
    "h09_overall_trend": O.with_views(_V, MH_CTE + ",\n" + TEMPORAL + """
SELECT project_id,
       CASE WHEN sum(CASE WHEN trend = 'degrading' THEN 1 ELSE 0 END) / count(*) > 0.3 THEN 'degrading'
            WHEN sum(CASE WHEN trend = 'improving' THEN 1 ELSE 0 END) / count(*) > 0.3 THEN 'improving'
            ELSE 'stable' END AS overall_trend,
       CAST(floor(avg(temporal_score) + 0.5) AS BIGINT) AS overall_temporal_score,
       coalesce(string_agg(CASE WHEN trend = 'degrading' THEN module END, ',' ORDER BY module), '') AS degrading_modules,
       coalesce(string_agg(CASE WHEN trend = 'improving' THEN module END, ',' ORDER BY module), '') AS improving_modules
FROM temporal GROUP BY project_id"""),
    "h17_weekly_features": O.with_views(_V, FEATURES
                                        + "\nSELECT * REPLACE (strftime(week, '%Y-%m-%d') AS week) FROM feat"),
    "h18_reconstruct_scores": _rec(_V, RECON + f"\nSELECT project_id, CAST(i AS BIGINT) AS week_offset, {jsr('e', 1)} AS score FROM sm"),
    "h19_ema": _rec(_A, EMA),
    "h21_wls": O.with_views(_A, SERIES + "\nSELECT * FROM fit"),
    "h22_trajectory": O.with_views(_A, SERIES + "\n" + TRAJ),
    "h23_decay_forecast": O.with_views(_A, SERIES + ",\n" + DECAY),
    "h25_daily_trend": O.with_views(_A, DAILY),
}


# ------------------------------------------------------- H10-H16 ----
# Parameters of the registered pre-anti-pattern queries: the order-based
# change log has ~26 lines of churn per commit and low co-change
# confidences, so the god-class churn and magnet confidence thresholds are
# lowered (as planned in SURVEY 7.2) to make those detectors fire.
GOD_CHURN = 20.0
MAGNET_CONFIDENCE = 0.2


def _tv(spark, base):
    pc, a = changes_in_period(spark, base)
    fh = H.file_history(pc, a)
    mh = H.module_history(pc, fh)
    tv = FC._velocity_cols(FC.temporal_scores(mh), mh)
    cc = H.change_coupling(pc)
    return fh, mh, tv, cc


def _patterns(spark, base):
    fh, mh, tv, cc = _tv(spark, base)
    parts = [FC.emerging_god_class(fh, tv, GOD_CHURN), FC.emerging_shotgun(cc), FC.bus_factor_risk(tv),
             FC.complexity_spiral(tv), FC.coupling_magnet(cc, tv, min_confidence=MAGNET_CONFIDENCE)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, tv, mh


QUERIES.update({
    "h10_emerging_god_class": lambda spark, base: FC.emerging_god_class(_tv(spark, base)[0], _tv(spark, base)[2], GOD_CHURN),
    "h11_emerging_shotgun": lambda spark, base: FC.emerging_shotgun(_tv(spark, base)[3]),
    "h12_bus_factor_risk": lambda spark, base: FC.bus_factor_risk(_tv(spark, base)[2]),
    "h13_complexity_spiral": lambda spark, base: FC.complexity_spiral(_tv(spark, base)[2]),
    "h14_coupling_magnet": lambda spark, base: FC.coupling_magnet(_tv(spark, base)[3], _tv(spark, base)[2],
                                                                  min_confidence=MAGNET_CONFIDENCE),
    "h15_module_forecast": lambda spark, base: FC.module_forecast(_patterns(spark, base)[1], _patterns(spark, base)[0]),
    "h16_outlook": lambda spark, base: FC.outlook(FC.overall_trend(FC.temporal_scores(_modules(spark, base))),
                                                  _patterns(spark, base)[0]),
})


def _pattern_sql():
    from repolens.plans.history import COUPLING_SQL
    mt = O.module_top
    thr = GOD_CHURN
    return MH_CTE + ",\n" + TEMPORAL + ",\n" + COUPLING_SQL + f""",
ctop AS (SELECT * FROM cc),
tv AS (SELECT t.*, m.churn_trend, m.commit_acceleration, m.direction, m.authors, m.commits AS module_commits
       FROM temporal t JOIN mhist m ON m.project_id = t.project_id AND m.module = t.module),
gw AS (SELECT fh.project_id, fh.module, fh.path, fh.commits,
              ceil(({d(2 * thr)} - churn_rate) / (churn_rate * (tv.churn_trend / 100) / 4)) AS w
       FROM fh JOIN tv ON tv.project_id = fh.project_id AND tv.module = fh.module
       WHERE churn_rate >= {d(thr)} AND tv.churn_trend > 0),
p_god AS (SELECT project_id, module, 'emerging-god-class' AS type,
                 CASE WHEN w <= 8 THEN 'alert' WHEN w <= 16 THEN 'warning' ELSE 'watch' END AS severity,
                 CAST(w AS BIGINT) AS weeks_to_threshold, {O.r6(f'least({d(0.9)}, {d(0.5)} + commits / 50)')} AS confidence,
                 path AS subject FROM gw WHERE w <= {FC.FC_WEEKS}),
cm AS (SELECT project_id, confidence, unnest(list_distinct([{mt('file_a')}, {mt('file_b')}])) AS module FROM ctop),
p_shot AS (SELECT project_id, module, 'emerging-shotgun-surgery' AS type,
                  CASE WHEN count(*) > 10 THEN 'alert' ELSE 'warning' END AS severity, CAST(4 AS BIGINT) AS weeks_to_threshold,
                  {O.r6('avg(confidence)')} AS confidence, CAST(count(*) AS VARCHAR) AS subject
           FROM cm GROUP BY 1, 2 HAVING count(*) >= {FC.FC_SHOTGUN_COUPLINGS}),
p_bus(project_id, module, type, severity, weeks_to_threshold, confidence, subject) AS (SELECT project_id, module, 'bus-factor-risk' AS type, CASE WHEN trend = 'degrading' THEN 'alert' ELSE 'warning' END,
                 CAST({FC.FC_WEEKS} AS BIGINT), {d(0.8)}, CAST(authors AS VARCHAR)
          FROM tv WHERE authors <= {FC.FC_BUS_FACTOR} AND module_commits >= 5),
sw AS (SELECT *, CASE WHEN (static_score - projected_score) / 12 > 0
                      THEN ceil((temporal_score - {FC.FC_ANTI_PATTERN_THRESHOLD}) / ((static_score - projected_score) / 12)) END AS w
       FROM tv WHERE churn_trend > 20 AND direction = 'accelerating'),
p_spiral(project_id, module, type, severity, weeks_to_threshold, confidence, subject) AS (SELECT project_id, module, 'complexity-spiral' AS type, CASE WHEN w <= 8 THEN 'alert' ELSE 'warning' END,
                    CAST(w AS BIGINT), confidence, CAST(temporal_score AS VARCHAR)
             FROM sw WHERE w IS NOT NULL AND w <= {FC.FC_WEEKS}),
inb AS (SELECT project_id, {mt('file_b')} AS module, count(*) AS n FROM ctop WHERE confidence > {d(MAGNET_CONFIDENCE)} GROUP BY 1, 2),
p_mag(project_id, module, type, severity, weeks_to_threshold, confidence, subject) AS (SELECT inb.project_id, inb.module, 'coupling-magnet' AS type, 'watch', CAST(12 AS BIGINT), {d(0.6)}, CAST(n AS VARCHAR)
          FROM inb JOIN tv ON tv.project_id = inb.project_id AND tv.module = inb.module
          WHERE n >= 3 AND commit_acceleration > 0),
pats AS (SELECT * FROM p_god UNION ALL SELECT * FROM p_shot UNION ALL SELECT * FROM p_bus
         UNION ALL SELECT * FROM p_spiral UNION ALL SELECT * FROM p_mag)"""


_P = _pattern_sql()
_prob = (f"(CASE WHEN temporal_score < 50 THEN {d(0.3)} WHEN temporal_score < 70 THEN {d(0.1)} ELSE {d(0.0)} END"
         f" + CASE WHEN trend = 'degrading' THEN {d(0.2)} ELSE {d(0.0)} END"
         f" + least({d(0.3)}, n_patterns * {d(0.1)})"
         f" + CASE WHEN authors <= 1 THEN {d(0.1)} ELSE {d(0.0)} END"
         f" + CASE WHEN churn_trend > 30 THEN {d(0.1)} ELSE {d(0.0)} END)")
SQL.update({
    "h10_emerging_god_class": O.with_views(_V, _P + "\nSELECT * FROM p_god"),
    "h11_emerging_shotgun": O.with_views(_V, _P + "\nSELECT * FROM p_shot"),
    "h12_bus_factor_risk": O.with_views(_V, _P + "\nSELECT * FROM p_bus"),
    "h13_complexity_spiral": O.with_views(_V, _P + "\nSELECT * FROM p_spiral"),
    "h14_coupling_magnet": O.with_views(_V, _P + "\nSELECT * FROM p_mag"),
    "h15_module_forecast": O.with_views(_V, _P + f""",
pc2 AS (SELECT project_id, module, count(*) AS n_patterns, sum(CASE WHEN severity = 'alert' THEN 1 ELSE 0 END) AS n_alerts
        FROM pats GROUP BY 1, 2),
j AS (SELECT tv.*, coalesce(n_patterns, 0) AS n_patterns, coalesce(n_alerts, 0) AS n_alerts
      FROM tv LEFT JOIN pc2 ON pc2.project_id = tv.project_id AND pc2.module = tv.module)
SELECT project_id, module,
       CASE WHEN temporal_score < 30 THEN 'critical' WHEN temporal_score < 50 OR trend = 'degrading' THEN 'degrading'
            WHEN temporal_score < 70 THEN 'at-risk' ELSE 'healthy' END AS current_health,
       CASE WHEN n_alerts > 0 OR projected_score < 30 THEN 'breakdown'
            WHEN trend = 'degrading' OR n_patterns > 0 THEN 'declining' ELSE 'stable' END AS forecast_6_months,
       least({d(1.0)}, {jsr(_prob, 2)}) AS bottleneck_probability,
       CAST((CASE WHEN trend = 'degrading' THEN 1 ELSE 0 END) + (CASE WHEN authors <= 1 THEN 1 ELSE 0 END)
            + (CASE WHEN churn_trend > 30 THEN 1 ELSE 0 END) + (CASE WHEN n_patterns > 0 THEN 1 ELSE 0 END) AS BIGINT) AS risk_factors,
       CAST(n_patterns AS BIGINT) AS patterns
FROM j"""),
    "h16_outlook": O.with_views(_V, _P + """,
ot AS (SELECT project_id,
              CASE WHEN sum(CASE WHEN trend = 'degrading' THEN 1 ELSE 0 END) / count(*) > 0.3 THEN 'degrading'
                   WHEN sum(CASE WHEN trend = 'improving' THEN 1 ELSE 0 END) / count(*) > 0.3 THEN 'improving'
                   ELSE 'stable' END AS overall_trend FROM temporal GROUP BY 1),
pp AS (SELECT project_id, count(*) AS n, sum(CASE WHEN severity = 'alert' THEN 1 ELSE 0 END) AS alerts FROM pats GROUP BY 1)
SELECT ot.project_id,
       CASE WHEN coalesce(alerts, 0) >= 2 OR overall_trend = 'degrading' THEN 'stormy'
            WHEN coalesce(alerts, 0) >= 1 OR coalesce(n, 0) >= 3 THEN 'cloudy' ELSE 'sunny' END AS outlook,
       CAST(coalesce(n, 0) AS BIGINT) AS patterns, CAST(coalesce(alerts, 0) AS BIGINT) AS alerts
FROM ot LEFT JOIN pp ON pp.project_id = ot.project_id"""),
})


QUERIES["h20_module_timelines"] = lambda spark, base: FC.module_timelines(_modules(spark, base))
SQL["h20_module_timelines"] = O.with_views(_V, MH_CTE + f""",
mt0 AS (SELECT project_id, module, commits, churn, churn_trend,
               greatest(1, ceil(commits / greatest(avg_weekly_rate, {d(0.1)}))) AS tw FROM mhist),
mt1 AS (SELECT *, tw AS n FROM mt0),
mx1 AS (SELECT mt1.*, r.w FROM mt1, LATERAL (SELECT unnest(range(0, CAST(n AS BIGINT))) AS w) r),
mx2 AS (SELECT *, {jsr(f'least({d(1.0)}, (churn / tw) * (1 + (churn_trend / 100) * (w / tw)) / greatest(churn, 1))', 3)} AS sig
        FROM mx1),
mg AS (SELECT project_id, module, max(n) AS n, coalesce(avg(CASE WHEN w < floor(n / 2) THEN sig END), {d(0.0)}) AS a1,
              coalesce(avg(CASE WHEN w >= floor(n / 2) THEN sig END), {d(0.0)}) AS a2, avg(sig) AS av FROM mx2 GROUP BY 1, 2)
SELECT project_id, module, CAST(n AS BIGINT) AS weeks, {jsr('av', 3)} AS avg_complexity,
       CASE WHEN a2 > a1 * {d(1.15)} THEN 'increasing' WHEN a2 < a1 * {d(0.85)} THEN 'decreasing' ELSE 'stable' END
         AS complexity_trend
FROM mg""")


# --------------------------------------------------------------- H24 ----
def _predictions(spark, base):
    m = materialize(_modules(spark, base))
    cur = FC.current_scores(m)
    tv = FC._velocity_cols(FC.temporal_scores(m), m)
    # the regression reads the weekly scores several times
    return m, cur, FC.predict_modules(FC.module_timelines(m), materialize(FC.module_scores(m, cur)), tv)


def q_module_scores(spark, base):
    m = materialize(_modules(spark, base))
    return FC.module_scores(m, FC.current_scores(m))


def q_project_risk(spark, base):
    m, cur, p = _predictions(spark, base)
    return FC.project_risk(cur, FC.reconstruct_scores(_features(spark, base), cur), materialize(p))


QUERIES.update({
    "h20_module_scores": q_module_scores,
    "h24_module_predictions": lambda spark, base: _predictions(spark, base)[2],
    "h24_project_risk": q_project_risk,
})

# weekly scores per module, as RECON does for projects
MODULE_RECON = f""",
ms0 AS (SELECT project_id, module, commits, churn, churn_trend, greatest(1, ceil(commits / greatest(avg_weekly_rate, {d(0.1)}))) AS tw FROM mhist),
ms1 AS (SELECT ms0.*, r.w FROM ms0, LATERAL (SELECT unnest(range(0, CAST(tw AS BIGINT))) AS w) r),
ms2 AS (SELECT *, {jsr(f'least({d(1.0)}, (churn / tw) * (1 + (churn_trend / 100) * (w / tw)) / greatest(churn, 1))', 3)} AS sig FROM ms1),
msa AS (SELECT project_id, module, avg(sig) AS mean_sig, max(w) AS n1,
               coalesce(avg(CASE WHEN w < floor(tw / 2) THEN sig END), {d(0.0)}) AS a1,
               coalesce(avg(CASE WHEN w >= floor(tw / 2) THEN sig END), {d(0.0)}) AS a2 FROM ms2 GROUP BY 1, 2),
mrec(project_id, module, i, score) AS (
  SELECT project_id, module, n1, cur FROM msa JOIN anchor USING (project_id)
  UNION ALL
  SELECT r.project_id, r.module, r.i - 1, greatest({d(0.0)}, least({d(100.0)}, r.score + greatest({d(-3.0)}, least({d(3.0)},
         (f.sig - a.mean_sig) * {d(3.0)}))))
  FROM mrec r JOIN ms2 f ON f.project_id = r.project_id AND f.module = r.module AND f.w = r.i
  JOIN msa a ON a.project_id = r.project_id AND a.module = r.module WHERE r.i > 0),
msm(project_id, module, i, e) AS (
  SELECT project_id, module, i, score FROM mrec WHERE i = 0
  UNION ALL
  SELECT s.project_id, s.module, s.i + 1, {d(0.3)} * r.score + {d(0.7)} * s.e
  FROM msm s JOIN mrec r ON r.project_id = s.project_id AND r.module = s.module AND r.i = s.i + 1)"""

# one regression for projects (module '') and modules, under a joint key
_SEP = "chr(31)"
_cur, _dec = DECAY.split("\nSELECT", 1)
PREDICTIONS = RECON + MODULE_RECON + f""",
ser AS (SELECT project_id || {_SEP} AS project_id, CAST(i AS DOUBLE) AS x, {jsr('e', 1)} AS y, CAST(NULL AS DOUBLE) AS w FROM sm
        UNION ALL SELECT project_id || {_SEP} || module, CAST(i AS DOUBLE), {jsr('e', 1)}, CAST(NULL AS DOUBLE) FROM msm),
""" + SERIES[SERIES.index("mx AS ("):] + ",\n" + _cur + ",\ndec AS (SELECT" + _dec + "),\n" + TEMPORAL[TEMPORAL.index("tp0 AS ("):] + f""",
pre AS (SELECT a.project_id, a.module, {', '.join('e.' + x for x in ('"current"', 'predicted', 'delta', 'weekly_delta', 'weeks_to_threshold', 'confidence'))},
               CASE WHEN a2 > a1 * {d(1.15)} THEN 'increasing' WHEN a2 < a1 * {d(0.85)} THEN 'decreasing' ELSE 'stable' END AS complexity_trend,
               {jsr('mean_sig', 3)} AS avg_complexity, t.trend, m.churn_trend, m.commit_acceleration
        FROM msa a JOIN dec e ON e.project_id = a.project_id || {_SEP} || a.module
        LEFT JOIN (temporal t JOIN mhist m USING (project_id, module)) ON t.project_id = a.project_id AND t.module = a.module),
pred AS (SELECT project_id, module, "current", predicted, delta, weekly_delta, weeks_to_threshold, confidence,
                CASE WHEN predicted < {d(FC.CRITICAL_THRESHOLD)} THEN 'critical' WHEN predicted < {d(FC.WARNING_THRESHOLD)} AND complexity_trend = 'increasing' THEN 'high'
                     WHEN delta < -5 THEN 'medium' ELSE 'low' END AS risk, complexity_trend,
                coalesce(nullif(concat_ws(', ', CASE WHEN complexity_trend = 'increasing' THEN 'complexity rises' END,
                  CASE WHEN avg_complexity > {d(FC.HIGH_COMPLEXITY)} THEN 'complexity is high' END,
                  CASE WHEN churn_trend > {FC.DRIVER_CHURN} THEN 'churn +' || CAST(CAST(floor(churn_trend + 0.5) AS BIGINT) AS VARCHAR) || '%' END,
                  CASE WHEN commit_acceleration > {FC.DRIVER_COMMITS} THEN 'commits +' || CAST(CAST(floor(commit_acceleration + 0.5) AS BIGINT) AS VARCHAR) || '%' END,
                  CASE WHEN trend = 'degrading' THEN 'degrades' END), ''), 'none') AS drivers FROM pre)"""
_late = f"weeks_to_threshold <= {2 * FC.HORIZON}"
PROJECT_RISK = f""",
pcnt AS (SELECT project_id, count(*) AS modules, count(*) FILTER ({_late}) AS at_risk, count(*) FILTER ({_late} AND risk = 'critical') AS critical,
                count(*) FILTER (complexity_trend = 'increasing') AS increasing FROM pred GROUP BY 1),
pnam AS (SELECT project_id, string_agg(module, ', ' ORDER BY r) AS rising FROM (
           SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY list_position({FC.RISK_ORDER}, risk), module) AS r FROM pred WHERE complexity_trend = 'increasing') t
         WHERE r <= {FC.NAMED_MODULES} GROUP BY 1),
prj AS (SELECT a.project_id, coalesce(e."current", cur) AS "current", coalesce(predicted, cur) AS predicted, coalesce(delta, {d(0.0)}) AS delta,
               coalesce(weekly_delta, {d(0.0)}) AS weekly_delta, weeks_to_threshold, coalesce(confidence, {d(FC.FALLBACK_CONFIDENCE)}) AS confidence,
               CAST(coalesce(n, 0) AS BIGINT) AS points, CAST(coalesce(modules, 0) AS BIGINT) AS modules, CAST(coalesce(at_risk, 0) AS BIGINT) AS at_risk,
               CAST(coalesce(critical, 0) AS BIGINT) AS critical, CAST(coalesce(increasing, 0) AS BIGINT) AS increasing, coalesce(rising, '') AS rising
        FROM anchor a LEFT JOIN dec e ON e.project_id = a.project_id || {_SEP} LEFT JOIN pcnt ON pcnt.project_id = a.project_id
        LEFT JOIN pnam ON pnam.project_id = a.project_id)
SELECT *, CASE WHEN predicted < {d(FC.CRITICAL_THRESHOLD)} OR critical >= 2 THEN 'critical' WHEN delta < -10 OR critical >= 1 THEN 'high'
               WHEN delta < -5 OR at_risk > 0 THEN 'medium' ELSE 'low' END AS risk,
       coalesce(nullif(concat_ws(', ', CASE WHEN critical > 0 THEN 'stabilize modules' END, CASE WHEN increasing > 0 THEN 'reduce complexity' END,
         CASE WHEN weekly_delta < {d(-0.5)} THEN 'review decline' END, CASE WHEN weeks_to_threshold <= {FC.FC_WEEKS} THEN 'act before threshold' END), ''), 'none') AS steps
FROM prj"""
SQL.update({
    "h20_module_scores": _rec(_V, RECON + MODULE_RECON + f"\nSELECT project_id, module, CAST(i AS BIGINT) AS week_offset, {jsr('e', 1)} AS score FROM msm"),
    "h24_module_predictions": _rec(_V, PREDICTIONS + "\nSELECT * FROM pred"),
    "h24_project_risk": _rec(_V, PREDICTIONS + PROJECT_RISK),
})
