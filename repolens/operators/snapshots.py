"""Snapshot history queries (W01-W10): windows, ranking, top-k, set operations.

Tables (see ``repolens.sources.store``):
  analyses(analysis_id BIGINT, project_id, ts TIMESTAMP, overall, modularity,
           coupling, cohesion, layering DOUBLE, nodes, edges BIGINT)
  anti_patterns(analysis_id, name, severity, location, description)

Every ranking has a full tie-break (ts, then analysis_id / name / path), so
results never depend on input order.  Top-k uses ``row_number() <= k``,
which Spark pre-limits per partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import js_round_to, round6

SCORE_COLS = ["overall", "modularity", "coupling", "cohesion", "layering"]


def fmt_ts(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _newest(part="project_id"):
    return Window.partitionBy(part).orderBy(F.desc("ts"), F.desc("analysis_id"))


def _oldest(part="project_id"):
    return Window.partitionBy(part).orderBy(F.asc("ts"), F.asc("analysis_id"))


def with_ap_counts(analyses: DataFrame, ap: DataFrame) -> DataFrame:
    """analyses + anti_pattern_count (partial count per analysis, then a join)."""
    cnt = ap.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("anti_pattern_count"))
    return (analyses.join(cnt, "analysis_id", "left")
            .withColumn("anti_pattern_count", F.coalesce("anti_pattern_count", F.lit(0)).cast("bigint")))


def _publish(df: DataFrame) -> DataFrame:
    cols = [c for c in df.columns]
    out = []
    for c in cols:
        if c == "ts":
            out.append(fmt_ts(F.col("ts")).alias("ts"))
        elif c in SCORE_COLS:
            out.append(round6(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- W01 ----
def latest_analysis(analyses: DataFrame, ap: DataFrame) -> DataFrame:
    """Newest analysis per project with its anti-pattern count."""
    r = analyses.withColumn("rn", F.row_number().over(_newest())).where("rn = 1").drop("rn")
    return _publish(with_ap_counts(r, ap))


# ---------------------------------------------------------------- W02 ----
def list_analyses(analyses: DataFrame, ap: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` analyses per project (rank 1 = newest) with counts."""
    r = (analyses.withColumn("rank", F.row_number().over(_newest()).cast("bigint"))
         .where(F.col("rank") <= n))
    return _publish(with_ap_counts(r, ap))


def score_history(analyses: DataFrame, n: int = 100, newest: bool = False) -> DataFrame:
    """Score points in time order, limited to ``n`` per project.

    ``newest=False`` keeps the oldest ``n`` (what the reference's store
    returns); ``newest=True`` keeps the latest ``n``.
    """
    w = _newest() if newest else _oldest()
    r = (analyses.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
         .withColumn("pos", F.row_number().over(_oldest()).cast("bigint")))
    return _publish(r.select("project_id", "analysis_id", "ts", "pos", *SCORE_COLS))


# ---------------------------------------------------------------- W03 ----
def score_delta(analyses: DataFrame) -> DataFrame:
    """Latest minus previous overall score; projects with one snapshot give no row."""
    # the two newest are kept before the shuffle, then folded into one row
    r = (analyses.select("project_id", "ts", "analysis_id", "overall")
         .withColumn("rn", F.row_number().over(_newest())).where(F.col("rn") <= 2)
         .groupBy("project_id").agg(F.max(F.when(F.col("rn") == 1, F.col("overall"))).alias("overall"),
                                    F.max(F.when(F.col("rn") == 2, F.col("overall"))).alias("previous"))
         .where(F.col("previous").isNotNull()))
    return r.select("project_id", round6("overall").alias("current"),
                    round6("previous").alias("previous"),
                    round6(F.col("overall") - F.col("previous")).alias("delta"))


# ---------------------------------------------------------------- W04 ----
def pattern_trends(analyses: DataFrame, ap: DataFrame) -> DataFrame:
    """Per (project, pattern, severity): occurrences, first and last seen."""
    j = ap.join(analyses.select("analysis_id", "project_id", "ts"), "analysis_id")
    return (j.groupBy("project_id", "name", "severity").agg(
        F.count(F.lit(1)).cast("bigint").alias("occurrences"),
        fmt_ts(F.min("ts")).alias("first_seen"),
        fmt_ts(F.max("ts")).alias("last_seen")))


def recurring(trends: DataFrame, min_occurrences: int = 3) -> DataFrame:
    return trends.where(F.col("occurrences") >= min_occurrences)


# ---------------------------------------------------------------- W05 ----
def top_hubs(edges: DataFrame, n: int = 10, key: str = "project_id") -> DataFrame:
    """Files with the highest fan-in, top ``n`` per snapshot/project (ties by path)."""
    fan = edges.groupBy(key, F.col("dst").alias("path")).agg(F.count(F.lit(1)).cast("bigint").alias("fan_in"))
    w = Window.partitionBy(key).orderBy(F.desc("fan_in"), F.asc("path"))
    return (fan.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= n))


# ---------------------------------------------------------------- W06 ----
def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per store table, one row each (a union of global counts)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


# ---------------------------------------------------------------- W07 ----
def suggest_rules(analyses: DataFrame, ap: DataFrame, window: int = 20, recent: int = 5
                  ) -> DataFrame:
    """Rule suggestions from stored history.

    1. quality gate: over the ``recent`` newest scores (of the ``window``
       newest), min >= 60 and mean >= 65 -> floor(min - 5);
    2. patterns (CRITICAL/HIGH) seen >= 3 times: ban cycles, else a limit
       (0 for CRITICAL, floor(occurrences / 2) for HIGH);
    3. latest coupling < 50 with >= 3 analyses: a coupling note.
    Needs >= 2 analyses.  Duplicates (type, yaml) keep the strongest basis.
    """
    w = _newest()
    ranked = analyses.withColumn("rn", F.row_number().over(w))
    win = ranked.where(F.col("rn") <= window)
    stats = win.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("rn") <= recent, F.col("overall"))).alias("min_recent"),
        F.avg(F.when(F.col("rn") <= recent, F.col("overall"))).alias("avg_recent"),
        F.count(F.when(F.col("rn") <= recent, 1)).alias("n_recent"),
        F.max(F.when(F.col("rn") == 1, F.col("coupling"))).alias("latest_coupling"))
    s1 = stats.where((F.col("n") >= 3) & (F.col("min_recent") >= 60) & (F.col("avg_recent") >= 65)).select(
        "project_id", F.lit(1).alias("strategy"), F.lit("quality_gate").alias("type"),
        F.concat(F.lit("quality_gates:\n  min_overall_score: "),
                 F.floor(F.col("min_recent") - 5).cast("bigint").cast("string")).alias("yaml"),
        F.when(F.col("avg_recent") >= 70, "high").otherwise("medium").alias("confidence"),
        F.format_string("%d recent analyses, min=%s, avg=%s", F.col("n_recent"),
                        F.format_string("%.1f", js_round_to(F.col("min_recent"), 1)),
                        F.format_string("%.1f", js_round_to(F.col("avg_recent"), 1))).alias("based_on"),
        F.lit(0).cast("bigint").alias("occ"))
    tr = pattern_trends(analyses, ap).join(stats.select("project_id", "n"), "project_id").where(
        (F.col("n") >= 2) & (F.col("occurrences") >= 3) & F.col("severity").isin("CRITICAL", "HIGH"))
    is_cycle = F.col("name") == "Circular Dependency"
    limit = F.when(F.col("severity") == "CRITICAL", F.lit(0)).otherwise(F.floor(F.col("occurrences") * 0.5))
    key = F.when(F.col("severity") == "CRITICAL", "max_critical_anti_patterns").otherwise("max_high_anti_patterns")
    s2 = tr.select(
        "project_id", F.lit(2).alias("strategy"),
        F.when(is_cycle, "boundary").otherwise("anti_pattern_limit").alias("type"),
        F.when(is_cycle, F.lit("boundaries:\n  allow_circular_dependencies: false"))
        .otherwise(F.concat(F.lit("quality_gates:\n  "), key, F.lit(": "), limit.cast("bigint").cast("string")))
        .alias("yaml"),
        F.when(F.col("occurrences") >= 5, "high").otherwise("medium").alias("confidence"),
        F.when(is_cycle, F.concat(F.lit("seen "), F.col("occurrences").cast("string"), F.lit(" times from "),
                                  F.col("first_seen")))
        .otherwise(F.concat(F.lit("seen "), F.col("occurrences").cast("string"), F.lit(" times as "),
                            F.col("severity"))).alias("based_on"),
        F.col("occurrences").alias("occ"))
    s3 = stats.where((F.col("n") >= 3) & (F.col("latest_coupling") < 50)).select(
        "project_id", F.lit(3).alias("strategy"), F.lit("quality_gate").alias("type"),
        F.lit("# a floor for one dimension:\n# coupling_score_min: 50").alias("yaml"),
        F.lit("low").alias("confidence"),
        F.concat(F.lit("coupling now "),
                 F.format_string("%.1f", js_round_to(F.col("latest_coupling"), 1))).alias("based_on"),
        F.lit(0).cast("bigint").alias("occ"))
    allr = s1.unionByName(s2).unionByName(s3)
    wd = Window.partitionBy("project_id", "type", "yaml").orderBy("strategy", F.desc("occ"), "based_on")
    return (allr.withColumn("k", F.row_number().over(wd)).where("k = 1")
            .select("project_id", "type", "yaml", "confidence", "based_on"))


# ---------------------------------------------------------------- W08 ----
def split_head_base(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newest analysis per project as head, the one before it as base."""
    r = analyses.withColumn("rn", F.row_number().over(_newest()))
    return r.where("rn = 1").drop("rn"), r.where("rn = 2").drop("rn")


def compare_scores(head: DataFrame, base: DataFrame) -> DataFrame:
    """Head vs base overall score with delta and label."""
    h = head.select("project_id", F.col("overall").alias("head_score"))
    b = base.select("project_id", F.col("overall").alias("base_score"))
    j = h.join(b, "project_id", "left")
    d = F.col("head_score") - F.col("base_score")
    return j.select("project_id", round6("head_score").alias("head_score"),
                    round6("base_score").alias("base_score"), round6(d).alias("delta"),
                    F.when(F.col("base_score").isNull(), "first scan").when(d > 0, "improved")
                    .when(d < 0, "regressed").otherwise("stable").alias("label"))


def compare_patterns(head: DataFrame, base: DataFrame, ap: DataFrame) -> DataFrame:
    """Patterns (name, severity, location) added, fixed or kept between base and head."""
    def pats(side):
        return (ap.join(side.select("analysis_id", "project_id"), "analysis_id")
                .select("project_id", "name", "severity", "location").distinct())
    hp, bp = pats(head), pats(base)
    keys = ["project_id", "name", "severity", "location"]
    added = hp.exceptAll(bp).withColumn("status", F.lit("added"))
    fixed = bp.exceptAll(hp).withColumn("status", F.lit("fixed"))
    kept = hp.intersect(bp).withColumn("status", F.lit("kept"))
    return added.unionByName(fixed).unionByName(kept).select(*keys, "status")


# ---------------------------------------------------------------- W09 ----
def project_context(projects: DataFrame, analyses: DataFrame, ap: DataFrame, top: int = 10
                    ) -> DataFrame:
    """Text summary per project: header, latest score, trend, recurring patterns."""
    def f1(c):
        return F.format_string("%.1f", js_round_to(c, 1))
    latest = with_ap_counts(analyses.withColumn("rn", F.row_number().over(_newest())).where("rn = 1"), ap)
    hist = analyses.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("ts", "overall"), F.struct("ts", "analysis_id")).alias("first"),
        F.max_by(F.struct("ts", "overall"), F.struct("ts", "analysis_id")).alias("last"))
    tr = pattern_trends(analyses, ap)
    wt = Window.partitionBy("project_id").orderBy(F.desc("occurrences"), "name", "severity")
    trl = (tr.withColumn("k", F.row_number().over(wt)).where(F.col("k") <= top)
           .withColumn("line", F.format_string("- %s, %s, %d times, %s until %s", "name", "severity",
                                               "occurrences", "first_seen", "last_seen"))
           .groupBy("project_id").agg(F.array_join(F.transform(
               F.sort_array(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n").alias("pats")))
    p = projects.select("project_id", "name", "path", "languages", "frameworks", "total_files", "total_lines")
    j = (p.join(latest, "project_id", "left").join(hist, "project_id", "left").join(trl, "project_id", "left"))
    delta = F.col("last.overall") - F.col("first.overall")
    header = F.concat_ws("\n",
                         F.concat(F.lit("# "), F.col("name")),
                         F.concat(F.lit("at "), F.col("path")),
                         F.concat(F.lit("written in "), F.array_join("languages", ", ")),
                         F.concat(F.lit("built on "), F.array_join("frameworks", ", ")),
                         F.format_string("%d files, %d lines", "total_files", "total_lines"),
                         F.lit(""),
                         F.concat(F.lit("## Newest analysis, "),
                                  F.coalesce(fmt_ts(F.col("ts")), F.lit("none yet"))))
    cur = F.when(F.col("analysis_id").isNotNull(), F.concat_ws(
        "\n",
        F.concat(F.lit("score "), f1(F.col("overall"))),
        F.concat(F.lit("- modularity "), f1(F.col("modularity"))),
        F.concat(F.lit("- coupling "), f1(F.col("coupling"))),
        F.concat(F.lit("- cohesion "), f1(F.col("cohesion"))),
        F.concat(F.lit("- layering "), f1(F.col("layering"))),
        F.format_string("%d findings", "anti_pattern_count"),
        F.format_string("graph of %d files and %d edges", "nodes", "edges")))
    trend = F.when(F.col("n") > 1, F.concat_ws(
        "\n", F.lit(""), F.lit("## Course"),
        F.format_string("%d analyses, %s until %s", F.col("n"), fmt_ts(F.col("first.ts")),
                        fmt_ts(F.col("last.ts"))),
        F.concat(F.lit("from "), f1(F.col("first.overall")), F.lit(" to "), f1(F.col("last.overall")),
                 F.lit(", "), F.when(delta >= 0, "+").otherwise(""), f1(delta))))
    pats = F.when(F.col("pats").isNotNull(), F.concat_ws("\n", F.lit(""), F.lit("## Findings that come back"),
                                                        F.col("pats")))
    return j.select("project_id", F.concat_ws("\n", header, cur, trend, pats).alias("text"))


# ---------------------------------------------------------------- W10 ----
def flow_top(edges: DataFrame, n: int = 15) -> DataFrame:
    """Top ``n`` (src, dst) flows by summed weight per project (ties by src, dst)."""
    f = edges.groupBy("project_id", "src", "dst").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy("project_id").orderBy(F.desc("weight"), "src", "dst")
    return (f.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)
            .select("project_id", "src", "dst", round6("weight").alias("weight"), "rank"))


def graph_extract(edges: DataFrame, layers: DataFrame | None = None, max_nodes: int = 60
                  ) -> tuple[DataFrame, DataFrame]:
    """Nodes (importing files only) ranked by connections, top ``max_nodes``
    per project with a group label, and the links among them.

    Group = layer, or the module (second level under src/lib/app/...) when
    more than 70% of the nodes have no layer.
    """
    from repolens.functions.paths import module_second_level
    real = edges.select("project_id", F.col("src").alias("path")).distinct()
    ends = edges.select("project_id", F.explode(F.array("src", "dst")).alias("path"))
    conn = ends.join(real, ["project_id", "path"], "left_semi").groupBy("project_id", "path").agg(
        F.count(F.lit(1)).alias("connections"))
    nodes_ = real.join(conn, ["project_id", "path"], "left").withColumn(
        "connections", F.coalesce("connections", F.lit(0)).cast("bigint"))
    if layers is not None:
        nodes_ = nodes_.join(layers.select("project_id", "path", "layer"), ["project_id", "path"], "left")
    else:
        nodes_ = nodes_.withColumn("layer", F.lit(None).cast("string"))
    nodes_ = nodes_.withColumn("layer", F.coalesce("layer", F.lit("Other")))
    share = nodes_.groupBy("project_id").agg(
        (F.sum(F.when(F.col("layer") == "Other", 1).otherwise(0)) / F.count(F.lit(1))).alias("other_share"))
    nodes_ = nodes_.join(share, "project_id").withColumn(
        "grp", F.when(F.col("other_share") > 0.7, module_second_level(F.col("path"))).otherwise(F.col("layer")))
    w = Window.partitionBy("project_id").orderBy(F.desc("connections"), "path")
    top = (nodes_.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= max_nodes)
           .select("project_id", "path", "connections", F.col("grp").alias("group"), "rank"))
    tn = top.select("project_id", "path")
    links = (edges.select("project_id", "src", "dst")
             .join(tn.withColumnRenamed("path", "src"), ["project_id", "src"], "left_semi")
             .join(tn.withColumnRenamed("path", "dst"), ["project_id", "dst"], "left_semi"))
    return top, links
