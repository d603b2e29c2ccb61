"""Rule checks.

``rules``: (project_id, rule, threshold, from_pattern, to_pattern) from
``sources.store.rules_df``; project_id '*' applies to every project.
Violations: (project_id, level, rule, message, actual, expected).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIOLATION_COLS = ["project_id", "level", "rule", "message", "actual", "expected"]

# Fixed values of the example boundary rule (clean layering, controllers).
DOMAIN_DIR = "src/domain"
INFRA_DIR = "src/infrastructure"


def _rules_for(rules: DataFrame, kind: str) -> DataFrame:
    return rules.where(F.col("rule") == kind)


def per_project(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """The rules with '*' written out for each of ``projects`` (project_id)."""
    exact = rules.where(F.col("project_id") != "*")
    wild = rules.where(F.col("project_id") == "*").drop("project_id").withColumn("_all", F.lit("*"))
    named = projects.select("project_id").distinct().withColumn("_all", F.lit("*"))
    return exact.unionByName(named.join(wild, "_all").select(*rules.columns))


def _attach(df: DataFrame, rules: DataFrame, cond=None) -> DataFrame:
    """Join rows to the rules of their project, '*' rules included, under
    ``cond``: an equi-join on project_id, whose strategy is the planner's."""
    out = df.join(per_project(rules, df), "project_id")
    return out if cond is None else out.where(cond)


# ---------------------------------------------------------------- J10 ----
def banned_references(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """One error per (edge, banned substring) whose target contains it."""
    b = _rules_for(rules, "banned_import").where(F.col("from_pattern").isNull()).select(
        "project_id", F.col("to_pattern").alias("banned"))
    j = _attach(edges.select("project_id", "src", "dst"), b, F.col("dst").contains(F.col("banned")))
    return j.select("project_id", F.lit("error").alias("level"), F.lit("boundaries.banned_imports").alias("rule"),
                    F.format_string("%s imports from %s", "src", "banned")
                    .alias("message"), F.col("dst").alias("actual"),
                    F.concat(F.lit("without "), F.col("banned")).alias("expected"))


# ---------------------------------------------------------------- J09 ----
def boundary_violations(edges: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Layer/boundary violations as anti-pattern rows:
    domain -> infrastructure (CRITICAL), controller/handler -> another
    controller/handler (MEDIUM), and every declared (from, to) pair (HIGH)."""
    e = edges.select("project_id", "src", "dst")
    loc = F.concat(F.col("src"), F.lit(" -> "), F.col("dst"))
    dom = e.where(F.col("src").contains(DOMAIN_DIR) & F.col("dst").contains(INFRA_DIR)).select(
        "project_id", F.lit("Domain imports infrastructure").alias("name"), F.lit("CRITICAL").alias("severity"),
        loc.alias("location"))
    is_ctl = lambda c: F.col(c).contains("controller") | F.col(c).contains("handler")
    ctl = e.where(is_ctl("src") & is_ctl("dst") & (F.col("src") != F.col("dst"))).select(
        "project_id", F.lit("Controller imports controller").alias("name"), F.lit("MEDIUM").alias("severity"),
        loc.alias("location"))
    out = dom.unionByName(ctl)
    if rules is not None:
        pairs = _rules_for(rules, "banned_import").where(F.col("from_pattern").isNotNull()).select(
            "project_id", "from_pattern", "to_pattern")
        j = _attach(e, pairs, F.col("src").contains(F.col("from_pattern")) & F.col("dst").contains(F.col("to_pattern")))
        out = out.unionByName(j.select(
            "project_id", F.concat(F.lit("Boundary "), F.col("from_pattern"), F.lit(" -> "), F.col("to_pattern"))
            .alias("name"), F.lit("HIGH").alias("severity"), loc.alias("location")))
    return out


# ---------------------------------------------------------------- B09 ----
def quality_gates(scores: DataFrame, ap: DataFrame, rules: DataFrame) -> DataFrame:
    """Min overall score (error), max CRITICAL (error), max HIGH (warning)."""
    counts = ap.groupBy("project_id").agg(
        F.sum(F.when(F.col("severity") == "CRITICAL", 1).otherwise(0)).alias("n_critical"),
        F.sum(F.when(F.col("severity") == "HIGH", 1).otherwise(0)).alias("n_high"))
    s = (scores.select("project_id", "overall").join(counts, "project_id", "left")
         .na.fill(0, ["n_critical", "n_high"]))
    gates = rules.where(F.col("rule").isin("min_overall_score", "max_critical_anti_patterns",
                                           "max_high_anti_patterns")).select("project_id", "rule", "threshold")
    j = _attach(s, gates)
    fmt = lambda v: F.regexp_replace(F.format_string("%.1f", v), r"\.0$", "")
    thr = fmt(F.col("threshold"))
    rows = F.array(
        F.when((F.col("rule") == "min_overall_score") & (F.col("overall") < F.col("threshold")), F.struct(
            F.lit("error").alias("level"), F.lit("quality_gates.min_overall_score").alias("rule"),
            F.concat(F.lit("overall score "), F.col("overall").cast("string"), F.lit(", at least "), thr).alias("message"),
            F.col("overall").cast("string").alias("actual"), thr.alias("expected"))),
        F.when((F.col("rule") == "max_critical_anti_patterns") & (F.col("n_critical") > F.col("threshold")), F.struct(
            F.lit("error").alias("level"), F.lit("quality_gates.max_critical_anti_patterns").alias("rule"),
            F.concat(F.lit("critical findings "), F.col("n_critical").cast("string"), F.lit(", at most "), thr).alias("message"),
            F.col("n_critical").cast("string").alias("actual"), thr.alias("expected"))),
        F.when((F.col("rule") == "max_high_anti_patterns") & (F.col("n_high") > F.col("threshold")), F.struct(
            F.lit("warning").alias("level"), F.lit("quality_gates.max_high_anti_patterns").alias("rule"),
            F.concat(F.lit("high findings "), F.col("n_high").cast("string"), F.lit(", at most "), thr).alias("message"),
            F.col("n_high").cast("string").alias("actual"), thr.alias("expected"))))
    return (j.select("project_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("v"))
            .select("project_id", "v.*"))


# ---------------------------------------------------------------- B10 ----
def cycle_rule(ap: DataFrame, rules: DataFrame) -> DataFrame:
    """Error when cycles are forbidden and any Circular Dependency exists."""
    n = ap.where(F.col("name") == "Circular Dependency").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_cycles"))
    j = _attach(n, rules.where(F.col("rule") == "no_circular").select("project_id", "rule"))
    return j.select("project_id", F.lit("error").alias("level"),
                    F.lit("boundaries.allow_circular_dependencies").alias("rule"),
                    F.format_string("cycles %d, none allowed", "n_cycles")
                    .alias("message"), F.col("n_cycles").cast("string").alias("actual"), F.lit("0").alias("expected"))


def validate(scores: DataFrame, ap: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """All violations: quality gates, cycle ban, banned references."""
    return (quality_gates(scores, ap, rules).unionByName(cycle_rule(ap, rules))
            .unionByName(banned_references(edges, rules)).select(*VIOLATION_COLS))


def verdict(scores: DataFrame, violations: DataFrame) -> DataFrame:
    """Per project: success = no error-level violation; counts by level."""
    v = violations.groupBy("project_id").agg(
        F.sum(F.when(F.col("level") == "error", 1).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("level") == "warning", 1).otherwise(0)).alias("warnings"))
    return (scores.select("project_id").distinct().join(v, "project_id", "left").na.fill(0, ["errors", "warnings"])
            .select("project_id", (F.col("errors") == 0).alias("success"),
                    F.col("errors").cast("bigint").alias("errors"), F.col("warnings").cast("bigint").alias("warnings")))


# ---------------------------------------------------------------- B11 ----
def _num(c):
    """A number as JavaScript prints a 2-decimal value (no trailing zeros)."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c), r"0+$", ""), r"\.$", "")


def review(latest: DataFrame, ap: DataFrame, violations: DataFrame, deltas: DataFrame) -> DataFrame:
    """Review verdict per project from its latest snapshot.

    ``latest``: (project_id, analysis_id, overall); ``ap``: anti-pattern rows
    (analysis_id, severity); ``violations``: (project_id, ...) rule
    violations of that snapshot; ``deltas``: (project_id, delta) vs the
    previous snapshot.  Issues: CRITICAL / HIGH counts, violations, a
    regression of more than 5 points.
    """
    c = ap.join(latest.select("analysis_id"), "analysis_id", "left_semi").groupBy("analysis_id").agg(
        F.sum(F.when(F.col("severity") == "CRITICAL", 1).otherwise(0)).alias("critical"),
        F.sum(F.when(F.col("severity") == "HIGH", 1).otherwise(0)).alias("high"))
    v = violations.groupBy("project_id").agg(F.count(F.lit(1)).alias("violations"))
    j = (latest.join(c, "analysis_id", "left").join(v, "project_id", "left")
         .join(deltas.select("project_id", "delta"), "project_id", "left")
         .na.fill(0, ["critical", "high", "violations"]))
    issues = F.filter(F.array(
        F.when(F.col("critical") > 0, F.format_string("%d CRITICAL anti-patterns", "critical")),
        F.when(F.col("high") > 0, F.format_string("%d HIGH anti-patterns", "high")),
        F.when(F.col("violations") > 0, F.format_string("%d rule violations", "violations")),
        F.when(F.col("delta") < -5, F.concat(F.lit("score down "), _num(F.abs(F.col("delta")))))), lambda x: x.isNotNull())
    return j.select("project_id", "analysis_id",
                    F.col("critical").cast("bigint").alias("critical"), F.col("high").cast("bigint").alias("high"),
                    F.col("violations").cast("bigint").alias("violations"),
                    F.array_join(issues, ", ").alias("issues"),
                    F.when(F.size(issues) == 0, "pass").otherwise("fail").alias("verdict"))
