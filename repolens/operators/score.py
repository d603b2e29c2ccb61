"""Scoring (B01-B05): four 0-100 ladders and the weighted overall score.

Inputs are the edge table, the file table and the anti-pattern table, all
keyed by ``project_id``.  Each metric is a combinable aggregate (count,
max) so Spark does partial aggregation before the shuffle; the per-project
results are a handful of rows joined at the end.

Weights and thresholds are either Python dicts (same for every project) or
come from a ``profiles`` DataFrame keyed by ``project_id`` (B06/B07).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions.core import basename, js_round, ladder_gt, ladder_lt, top_segment

# Fixed values of the scorer: default weights, default thresholds, barrel names.
DEFAULT_WEIGHTS = {"modularity": 0.4, "coupling": 0.25, "cohesion": 0.2, "layering": 0.15}
DEFAULT_THRESHOLDS = {
    "modularity_excellent": 2.0,
    "modularity_good": 6.0,
    "coupling_excellent": 0.15,
    "coupling_good": 0.35,
    "cohesion_excellent": 0.8,
    "cohesion_good": 0.45,
}
BARREL_FILES = ["__init__.py", "index.ts", "index.js", "index.tsx", "index.jsx",
                "mod.rs", "__init__.pyi", "types.ts", "types.js", "logger.ts", "logger.js"]
LAYERING_PATTERNS = ["Leaky Abstraction", "Shotgun Surgery", "Circular Dependency"]
SCORE_COLS = ["modularity", "coupling", "cohesion", "layering"]


def _th(name: str, th: dict | None):
    """Threshold as a column: per-project column if present, else a literal."""
    if th is None:
        return F.col(name)
    return F.lit(float(th[name]))


# ------------------------------------------------------ per-project inputs ----
def graph_metrics(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, files, edges, internal_edges, max_degree) in one row per project.

    ``max_degree`` is the largest count of edge ends on one node after
    dropping edges that touch a barrel file.
    """
    e = edges.select("project_id", "src", "dst",
                     _is_internal(F.col("src"), F.col("dst")).cast("int").alias("internal"),
                     (~basename("src").isin(BARREL_FILES) & ~basename("dst").isin(BARREL_FILES))
                     .cast("int").alias("nb"))
    # one pass over both edge ends: per node its non-barrel degree, per
    # project the edge count and internal edges (counted on the source end)
    ends = e.select("project_id", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.col("internal").alias("int_out"), "nb"),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(0).alias("int_out"), "nb"))).alias("x"))
    per_node = ends.groupBy("project_id", F.col("x.node").alias("node")).agg(
        F.sum("x.nb").alias("deg"), F.sum("x.out").alias("out"), F.sum("x.int_out").alias("int_out"))
    edge_stats = per_node.groupBy("project_id").agg(
        F.sum("out").alias("edges"), F.sum("int_out").alias("internal_edges"), F.max("deg").alias("max_degree"))
    file_stats = files.groupBy("project_id").agg(F.count_distinct("path").alias("files"))
    return (file_stats.join(edge_stats, "project_id", "full")
            .select("project_id",
                    F.coalesce("files", F.lit(0)).cast("bigint").alias("files"),
                    F.coalesce("edges", F.lit(0)).cast("bigint").alias("edges"),
                    F.coalesce("internal_edges", F.lit(0)).cast("bigint").alias("internal_edges"),
                    F.coalesce("max_degree", F.lit(0)).cast("bigint").alias("max_degree")))


def _is_internal(src, dst):
    """Same top-level directory; two bare file names also count as internal."""
    both_flat = (F.size(F.split(src, "/")) <= 1) & (F.size(F.split(dst, "/")) <= 1)
    return both_flat | (top_segment(src) == top_segment(dst))


def layering_counts(anti_patterns: DataFrame) -> DataFrame:
    """(project_id, layering_violations) from anti-pattern rows."""
    return (anti_patterns.where(F.col("name").isin(LAYERING_PATTERNS))
            .groupBy("project_id").agg(F.count(F.lit(1)).alias("layering_violations")))


# --------------------------------------------------------------- ladders ----
def modularity_col(edges, files, th: dict | None = DEFAULT_THRESHOLDS):
    ex, good = _th("modularity_excellent", th), _th("modularity_good", th)
    avg = edges / files
    return F.when(files == 0, F.lit(50)).otherwise(ladder_lt(avg, [
        (ex, 100), ((ex + good) / 2, 85), (good, 70), (good * 1.5, 50)], 30))


def coupling_col(max_degree, files, th: dict | None = DEFAULT_THRESHOLDS):
    ex, good = _th("coupling_excellent", th), _th("coupling_good", th)
    ratio = max_degree / F.greatest(files - 1, F.lit(1))
    return F.when(files <= 1, F.lit(50)).otherwise(ladder_lt(ratio, [
        (ex, 100), ((ex + good) / 2, 85), (good, 75), (good * 1.5, 65),
        (good * 2, 50), (good * 2.5, 35)], 20))


def cohesion_col(internal, edges, th: dict | None = DEFAULT_THRESHOLDS):
    ex, good = _th("cohesion_excellent", th), _th("cohesion_good", th)
    ratio = internal / edges
    return F.when(edges == 0, F.lit(50)).otherwise(ladder_gt(ratio, [
        (ex, 100), ((ex + good) / 2, 85), (good, 75), (good * 0.7, 65), (good * 0.3, 50)], 30))


def layering_col(violations, files):
    file_count = F.greatest(F.when(files == 0, F.lit(50)).otherwise(files), F.lit(10))
    ratio = violations / file_count
    return F.when(violations == 0, F.lit(100)).otherwise(ladder_lt(ratio, [
        (0.05, 95), (0.15, 85), (0.25, 70), (0.40, 50), (0.60, 35)], 20))


# ------------------------------------------------------------ B01..B05 ----
def modularity(edges: DataFrame, files: DataFrame, th: dict = DEFAULT_THRESHOLDS) -> DataFrame:
    m = graph_metrics(edges, files)
    return m.select("project_id", modularity_col(F.col("edges"), F.col("files"), th)
                    .cast("bigint").alias("modularity"))


def coupling(edges: DataFrame, files: DataFrame, th: dict = DEFAULT_THRESHOLDS) -> DataFrame:
    m = graph_metrics(edges, files)
    return m.select("project_id", coupling_col(F.col("max_degree"), F.col("files"), th)
                    .cast("bigint").alias("coupling"))


def cohesion(edges: DataFrame, files: DataFrame, th: dict = DEFAULT_THRESHOLDS) -> DataFrame:
    m = graph_metrics(edges, files)
    return m.select("project_id", cohesion_col(F.col("internal_edges"), F.col("edges"), th)
                    .cast("bigint").alias("cohesion"))


def layering(anti_patterns: DataFrame, files: DataFrame) -> DataFrame:
    fc = files.groupBy("project_id").agg(F.count_distinct("path").alias("files"))
    v = layering_counts(anti_patterns)
    return (fc.join(v, "project_id", "full")
            .select("project_id", layering_col(F.coalesce("layering_violations", F.lit(0)),
                                               F.coalesce("files", F.lit(0)))
                    .cast("bigint").alias("layering")))


def score_parts(edges: DataFrame, files: DataFrame, anti_patterns: DataFrame,
                thresholds: dict | None = DEFAULT_THRESHOLDS,
                profiles: DataFrame | None = None) -> DataFrame:
    """Per project: files, edges and the four part scores.

    With ``profiles`` (project_id + threshold columns) thresholds are read per
    project; ``thresholds=None`` then means "take them from the columns".
    """
    m = graph_metrics(edges, files).join(layering_counts(anti_patterns), "project_id", "left")
    th = thresholds
    if profiles is not None:
        m = m.join(profiles, "project_id", "left")
        th = None
    return m.select(
        "project_id", "files", "edges",
        modularity_col(F.col("edges"), F.col("files"), th).cast("bigint").alias("modularity"),
        coupling_col(F.col("max_degree"), F.col("files"), th).cast("bigint").alias("coupling"),
        cohesion_col(F.col("internal_edges"), F.col("edges"), th).cast("bigint").alias("cohesion"),
        layering_col(F.coalesce("layering_violations", F.lit(0)), F.col("files"))
        .cast("bigint").alias("layering"),
        *([c for c in ("w_modularity", "w_coupling", "w_cohesion", "w_layering")
           if profiles is not None and c in profiles.columns]))


def overall_col(parts_weights: dict | None = DEFAULT_WEIGHTS):
    """Rounded weighted sum of the parts, clamped to 0..100."""
    if parts_weights is None:
        w = {k: F.col(f"w_{k}") for k in SCORE_COLS}
    else:
        w = {k: F.lit(float(parts_weights[k])) for k in SCORE_COLS}
    total = (F.col("modularity") * w["modularity"] + F.col("coupling") * w["coupling"]
             + F.col("cohesion") * w["cohesion"] + F.col("layering") * w["layering"])
    return F.least(F.greatest(js_round(total), F.lit(0)), F.lit(100)).cast("bigint")


def score(edges: DataFrame, files: DataFrame, anti_patterns: DataFrame,
          weights: dict | None = DEFAULT_WEIGHTS, thresholds: dict | None = DEFAULT_THRESHOLDS,
          profiles: DataFrame | None = None, modifiers=None) -> DataFrame:
    """Overall score per project with its four parts.

    ``modifiers`` is a list of DataFrame -> DataFrame functions applied to
    the parts before the overall is computed (U03 score modifier hook).
    """
    parts = score_parts(edges, files, anti_patterns, thresholds, profiles)
    for fn in modifiers or []:
        parts = fn(parts)
    use_w = None if (profiles is not None and "w_modularity" in parts.columns) else weights
    return parts.select("project_id", "files", "edges", *SCORE_COLS,
                        overall_col(use_w).alias("overall"))


def score_components(scores: DataFrame, weights: dict = DEFAULT_WEIGHTS) -> DataFrame:
    """Long form: one row per (project, component) with its weight."""
    long = scores.unpivot(["project_id"], SCORE_COLS, "component", "score")
    wmap = F.create_map(*[x for k in SCORE_COLS for x in (F.lit(k), F.lit(float(weights[k])))])
    return long.select("project_id", "component", F.col("score").cast("bigint").alias("score"),
                       wmap[F.col("component")].alias("weight"))
