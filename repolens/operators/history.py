"""Change history (H01-H07): file and module histories, hotspots, velocity,
change coupling, weekly timeline and totals.

Input ``changes``: (project_id, commit_id, author, ts TIMESTAMP, path,
additions BIGINT, deletions BIGINT), one row per (commit, file).

``as_of`` is explicit everywhere (the reference uses the wall clock).  It
may be a Python datetime / ISO string, or ``None`` to use the newest change
(a single distributed ``max`` whose scalar result is all that reaches the
driver).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import js_round_to, round6
from repolens.functions.paths import module_top
from repolens.operators.pairs import frequent_pairs
from repolens.operators.ranking import numbered

# Fixed values of the history analyser.
PERIOD_WEEKS = 24
ROLLING_WEEKS = 4
HOTSPOT_CHURN = 500
COUPLING_MIN_COCHANGES = 3
COUPLING_TOP = 50
HOTSPOT_TOP = 20
MODULE_HOTSPOT_TOP = 5
VELOCITY_THRESHOLD = 15.0


def resolve_as_of(changes: DataFrame, as_of=None) -> Column:
    """as_of as a TIMESTAMP literal column."""
    if as_of is None:
        as_of = changes.agg(F.max(F.col("ts").cast("timestamp")).alias("m")).first()["m"]
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, _dt.date) and not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime(as_of.year, as_of.month, as_of.day)
    return F.lit(as_of).cast("timestamp")


def period_start(as_of, weeks: int = PERIOD_WEEKS) -> _dt.datetime:
    """Midnight of ``as_of - weeks*7 days``."""
    return _dt.datetime(as_of.year, as_of.month, as_of.day) - _dt.timedelta(days=7 * weeks)


def in_period(changes: DataFrame, as_of=None, weeks: int | None = PERIOD_WEEKS) -> DataFrame:
    """Changes since midnight of ``as_of - weeks*7 days`` up to ``as_of``."""
    a = resolve_as_of(changes, as_of)
    out = changes.where(F.col("ts") <= a)
    if weeks is not None:
        start = F.date_sub(F.to_date(a), weeks * 7).cast("timestamp")
        out = out.where(F.col("ts") >= start)
    return out


def fmt_ts(col) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# ---------------------------------------------------------------- H01 ----
def file_history(changes: DataFrame, as_of=None, rolling_weeks: int = ROLLING_WEEKS,
                 hotspot_churn: int = HOTSPOT_CHURN) -> DataFrame:
    """Per file: commits, additions, deletions, churn, churn_rate, authors,
    last_modified, weekly_rate (commits in the last ``rolling_weeks`` weeks
    divided by the number of weeks) and the hotspot flag.

    One shuffle on (project_id, path); every aggregate except the distinct
    author count is partial.
    """
    a = resolve_as_of(changes, as_of)
    window_start = a - F.expr(f"INTERVAL {rolling_weeks * 7} DAYS")
    weeks = max(rolling_weeks, 1)
    h = changes.groupBy("project_id", "path").agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.count_distinct("author").alias("authors"),
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("ts") >= window_start).alias("recent"))  # rows are one per (commit, file)
    churn = F.col("additions") + F.col("deletions")
    rate = F.col("recent") / F.lit(float(weeks))
    return h.select(
        "project_id", "path", module_top(F.col("path")).alias("module"),
        F.col("commits").cast("bigint").alias("commits"),
        F.col("additions").cast("bigint").alias("additions"),
        F.col("deletions").cast("bigint").alias("deletions"),
        churn.cast("bigint").alias("churn"),
        round6(churn / F.col("commits")).alias("churn_rate"),
        F.col("authors").cast("bigint").alias("authors"),
        fmt_ts(F.col("last_ts")).alias("last_modified"),
        round6(rate).alias("weekly_rate"),
        ((churn >= hotspot_churn) & (rate >= 1)).alias("is_hotspot"))


# ---------------------------------------------------------------- H02 ----
def hotspots(fh: DataFrame, top: int = HOTSPOT_TOP) -> DataFrame:
    """Hotspot files, the ``top`` highest churn per project (ties by path)."""
    w = Window.partitionBy("project_id").orderBy(F.desc("churn"), F.asc("path"))
    return (fh.where("is_hotspot").withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= top))


# ---------------------------------------------------------------- H04 ----
def velocity(fh: DataFrame, keys=("project_id", "module")) -> DataFrame:
    """Per module: files ordered by last change (newest first, ties by path)
    are split at mid = floor(n/2) (at least 1); percent change of the mean
    weekly rate and of the mean churn rate between the halves, half-up
    rounded to one decimal; direction at +-15.  Files are numbered over range
    partitions, so a module with a third of all files is no single task.
    """
    keys = list(keys)
    r = numbered(fh.select(*keys, "last_modified", "path", "weekly_rate", "churn_rate"), keys,
                 [F.desc("last_modified"), "path"], total="n")
    mid = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    r = r.withColumn("recent", F.col("pos") <= mid)
    g = r.groupBy(*keys).agg(
        F.avg(F.when(F.col("recent"), F.col("weekly_rate"))).alias("rr"),
        F.avg(F.when(~F.col("recent"), F.col("weekly_rate"))).alias("orr"),
        F.avg(F.when(F.col("recent"), F.col("churn_rate"))).alias("rc"),
        F.avg(F.when(~F.col("recent"), F.col("churn_rate"))).alias("oc"))
    g = g.withColumn("orr", F.coalesce("orr", "rr")).withColumn("oc", F.coalesce("oc", "rc"))
    acc = F.when(F.col("orr") > 0, (F.col("rr") - F.col("orr")) / F.col("orr") * 100).otherwise(0.0)
    trend = F.when(F.col("oc") > 0, (F.col("rc") - F.col("oc")) / F.col("oc") * 100).otherwise(0.0)
    return g.select(
        *keys,
        js_round_to(acc, 1).alias("commit_acceleration"),
        js_round_to(trend, 1).alias("churn_trend"),
        F.when(acc > VELOCITY_THRESHOLD, "accelerating")
        .when(acc < -VELOCITY_THRESHOLD, "decelerating").otherwise("stable").alias("direction"))


# ---------------------------------------------------------------- H03 ----
def module_history(changes: DataFrame, fh: DataFrame, top: int = MODULE_HOTSPOT_TOP) -> DataFrame:
    """Per module (first path directory): files, summed commits and churn,
    mean weekly rate, distinct authors over the raw changes, the ``top``
    hotspots (comma-joined, by churn desc then path) and the velocity vector.
    """
    agg = fh.groupBy("project_id", "module").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("commits").alias("commits"),
        F.sum("churn").alias("churn"),
        F.avg("weekly_rate").alias("avg_weekly_rate"))
    authors = (changes.select("project_id", module_top(F.col("path")).alias("module"), "author")
               .groupBy("project_id", "module").agg(F.count_distinct("author").alias("authors")))
    w = Window.partitionBy("project_id", "module").orderBy(F.desc("churn"), F.asc("path"))
    hot = (fh.where("is_hotspot").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top)
           .groupBy("project_id", "module").agg(
               F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "path"))),
                                        lambda s: s["path"]), ",").alias("top_hotspots")))
    return (agg.join(authors, ["project_id", "module"], "left")
            .join(hot, ["project_id", "module"], "left")
            .join(velocity(fh), ["project_id", "module"], "left")
            .select("project_id", "module",
                    F.col("files").cast("bigint").alias("files"),
                    F.col("commits").cast("bigint").alias("commits"),
                    F.col("churn").cast("bigint").alias("churn"),
                    round6("avg_weekly_rate").alias("avg_weekly_rate"),
                    F.coalesce("authors", F.lit(0)).cast("bigint").alias("authors"),
                    F.coalesce("top_hotspots", F.lit("")).alias("top_hotspots"),
                    "commit_acceleration", "churn_trend", "direction"))


# ---------------------------------------------------------------- H05 ----
def change_coupling(changes: DataFrame, min_cochanges: int = COUPLING_MIN_COCHANGES,
                    max_files: int | None = None, top: int | None = None) -> DataFrame:
    """Files that change together.

    The paths of a commit form unordered pairs; pairs seen at least
    ``min_cochanges`` times are kept with confidence = count / max(commits of
    a, commits of b), half-up to 2 decimals.  Optional limits, off by default:
    only the first ``max_files`` paths (by path) of a commit, only the ``top``
    pairs by confidence (ties: count desc, a, b) of a project.

    The counting is ``pairs.frequent_pairs``: rarely changed files are dropped
    first without loss, and the pairs of a large commit are made block by block.
    """
    per_commit = changes.select("project_id", "commit_id", "path").distinct()
    if max_files is not None:
        w = Window.partitionBy("project_id", "commit_id").orderBy("path")
        per_commit = per_commit.withColumn("i", F.row_number().over(w)).where(F.col("i") <= max_files).drop("i")
    counts = frequent_pairs(per_commit, ["project_id", "commit_id"], "path", min_cochanges, ["project_id"])
    counts = counts.select("project_id", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), F.col("n").alias("cochanges"))
    fc = changes.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n"))
    fa = fc.select("project_id", F.col("path").alias("file_a"), F.col("n").alias("na"))
    fb = fc.select("project_id", F.col("path").alias("file_b"), F.col("n").alias("nb"))
    out = (counts.join(fa, ["project_id", "file_a"], "left").join(fb, ["project_id", "file_b"], "left")
           .select("project_id", "file_a", "file_b", F.col("cochanges").cast("bigint").alias("cochanges"),
                   js_round_to(F.col("cochanges") / F.greatest(F.coalesce("na", F.lit(1)),
                                                               F.coalesce("nb", F.lit(1))), 2)
                   .alias("confidence")))
    if top is not None:
        wt = Window.partitionBy("project_id").orderBy(F.desc("confidence"), F.desc("cochanges"),
                                                      "file_a", "file_b")
        out = out.withColumn("rank", F.row_number().over(wt)).where(F.col("rank") <= top).drop("rank")
    return out


# ---------------------------------------------------------------- H06 ----
def weekly_timeline(changes: DataFrame, as_of=None, weeks: int = PERIOD_WEEKS) -> DataFrame:
    """Commits, churn and active files (sum of per-commit file counts) per
    Monday week; all ``weeks`` weeks up to the week of ``as_of`` present,
    zero-filled, per project.
    """
    a = resolve_as_of(changes, as_of)
    last_monday = F.to_date(F.date_trunc("week", a))
    per_commit = changes.groupBy("project_id", "commit_id").agg(
        F.min("ts").alias("ts"),
        F.sum(F.col("additions") + F.col("deletions")).alias("churn"),
        F.count(F.lit(1)).alias("files"))
    wk = per_commit.groupBy("project_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        F.count(F.lit(1)).alias("commits"), F.sum("churn").alias("churn"),
        F.sum("files").alias("active_files"))
    projects = changes.select("project_id").distinct()
    cal = projects.select("project_id", F.explode(F.sequence(
        F.date_sub(last_monday, 7 * (weeks - 1)), last_monday, F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return (cal.join(wk, ["project_id", "week"], "left")
            .select("project_id", "week",
                    F.coalesce("commits", F.lit(0)).cast("bigint").alias("commits"),
                    F.coalesce("churn", F.lit(0)).cast("bigint").alias("churn"),
                    F.coalesce("active_files", F.lit(0)).cast("bigint").alias("active_files")))


# ---------------------------------------------------------------- H07 ----
def history_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("project_id").agg(
        F.count_distinct("commit_id").cast("bigint").alias("total_commits"),
        F.count_distinct("author").cast("bigint").alias("total_authors"))
