"""Module predictions and project risk (H24) on series made for each class."""

from __future__ import annotations

from repolens.operators import forecast as FC


def _case(spark):
    """Modules of project p whose scores fall ever more steeply, q without
    enough points."""
    lines = {"crash": (70.0, -4.0), "slide": (70.0, -1.0), "dip": (90.0, -0.6), "flat": (80.0, 0.0)}
    scores = [("p", m, w, a + b * w) for m, (a, b) in lines.items() for w in range(8)] + [("q", "short", 0, 50.0), ("q", "short", 1, 40.0)]
    scores = spark.createDataFrame(scores, "project_id string, module string, week_offset bigint, score double")
    trends = {"crash": "stable", "slide": "increasing", "dip": "stable", "flat": "decreasing", "short": "increasing"}
    lines = spark.createDataFrame([("q" if m == "short" else "p", m, 8, 0.8 if m == "slide" else 0.1, t) for m, t in trends.items()],
                                  "project_id string, module string, weeks bigint, avg_complexity double, complexity_trend string")
    temporal = spark.createDataFrame([("p", "crash", "degrading", 44.6, 21.0), ("p", "dip", "stable", 30.0, 20.0)],
                                     "project_id string, module string, trend string, churn_trend double, commit_acceleration double")
    return lines, scores, temporal


def test_module_risk_and_drivers(spark):
    lines, scores, temporal = _case(spark)
    got = {r.module: r for r in FC.predict_modules(lines, scores, temporal).collect()}
    assert {m: r.risk for m, r in got.items()} == {"crash": "critical", "slide": "high", "dip": "medium", "flat": "low"}
    assert got["crash"].drivers == "churn +45%, commits +21%, degrades"
    assert got["slide"].drivers == "complexity rises, complexity is high"
    assert got["dip"].drivers == got["flat"].drivers == "none"
    assert got["crash"].weeks_to_threshold == 1 and got["flat"].weeks_to_threshold is None
    late = {r.module for r in FC.at_risk_modules(FC.predict_modules(lines, scores)).collect()}
    assert late == {"crash", "slide"}


def test_project_risk_with_and_without_a_fit(spark):
    lines, scores, temporal = _case(spark)
    current = spark.createDataFrame([("p", 60.0), ("q", 45.0)], "project_id string, current double")
    weekly = spark.createDataFrame([("p", w, 80.0 - w) for w in range(10)], "project_id string, week_offset bigint, score double")
    got = {r.project_id: r for r in FC.project_risk(current, weekly, FC.predict_modules(lines, scores, temporal)).collect()}
    p, q = got["p"], got["q"]
    assert (p.current, p.predicted, p.delta, p.points, p.modules, p.at_risk, p.critical) == (71.0, 59.0, -12.0, 10, 4, 2, 1)
    assert (p.risk, p.rising) == ("high", "slide")
    assert p.steps == "stabilize modules, reduce complexity, review decline"
    assert (q.current, q.predicted, q.delta, q.confidence, q.points, q.modules) == (45.0, 45.0, 0.0, 0.1, 0, 0)
    assert (q.risk, q.steps, q.weeks_to_threshold) == ("low", "none", None)


def test_predictions_of_empty_tables(spark):
    lines, scores, temporal = _case(spark)
    none = FC.predict_modules(lines.limit(0), scores.limit(0), temporal)
    assert none.count() == 0
    current = spark.createDataFrame([], "project_id string, current double")
    weekly = spark.createDataFrame([], "project_id string, week_offset bigint, score double")
    assert FC.project_risk(current, weekly, none).count() == 0
