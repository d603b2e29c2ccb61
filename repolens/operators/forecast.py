"""Temporal scores, score timelines and regression forecasts.

J15, H08, H09 (temporal scorer), H17-H19 (weekly features, backward score
reconstruction, exponential smoothing), H21-H23 (weighted least squares,
trajectory, decay forecast) and H25 (daily least-squares trend).

Regressions are one or two passes of grouped sums (all partial
aggregates), joined back per key; no UDF.  Smoothing (H19) and reconstruction
(H18) work on blocks of a series.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import clamp, js_round, js_round_to, ladder_lt
from repolens.operators.ranking import numbered
from repolens.session import materialize

# Fixed values of the temporal scorer.
PROJECTION_WEEKS = 12
CHURN_WEIGHT = 0.6
COMMIT_WEIGHT = 0.4
# Fixed values of the timeline builder.
TL_CHURN_WEIGHT = 0.5
TL_COMMIT_WEIGHT = 0.3
TL_FILE_WEIGHT = 0.2
MAX_WEEKLY_PENALTY = 3.0
SMOOTHING_ALPHA = 0.3
# Fixed values of the decay regressor.
HALF_LIFE = 8.0
HORIZON = 12
CRITICAL_THRESHOLD = 40.0
MIN_POINTS = 3


# ---------------------------------------------------------------- J15 ----
def static_scores(modules: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Static score per module: given score, else from average churn per commit
    (< 20: 85, < 50: 75, < 100: 65, < 200: 50, else 35)."""
    avg = F.col("churn") / F.greatest(F.col("commits"), F.lit(1))
    fallback = ladder_lt(avg, [(20, 85), (50, 75), (100, 65), (200, 50)], 35)
    m = modules
    if scores is not None:
        m = m.join(scores.select("project_id", "module", F.col("score").alias("_given")),
                   ["project_id", "module"], "left")
    else:
        m = m.withColumn("_given", F.lit(None).cast("double"))
    return m.withColumn("static_score", F.coalesce(F.col("_given"), fallback.cast("double"))).drop("_given")


# ---------------------------------------------------------------- H08 ----
def temporal_scores(modules: DataFrame, scores: DataFrame | None = None,
                    projection_weeks: int = PROJECTION_WEEKS) -> DataFrame:
    """Temporal score per module from its velocity vector and static score.

    ``modules`` needs project_id, module, churn, commits, authors,
    churn_trend, commit_acceleration, direction (``history.module_history``).
    """
    m = static_scores(modules, scores)
    ct, ca = F.col("churn_trend"), F.col("commit_acceleration")
    churn_pen = F.when(ct > 0, ct * CHURN_WEIGHT * 0.3).otherwise(ct * CHURN_WEIGHT * 0.1)
    commit_pen = F.when(ca > 20, (ca - 20) * COMMIT_WEIGHT * 0.2).otherwise(F.lit(0.0))
    total = clamp(churn_pen + commit_pen, F.lit(-20.0), F.lit(30.0))
    m = m.withColumn("penalty", total)
    temporal = clamp(js_round(F.col("static_score") - F.col("penalty")), F.lit(0), F.lit(100))
    trend = (F.when((ct > 30) | (ca > 50), "degrading")
             .when((ct < -10) & (F.col("direction") != "accelerating"), "improving").otherwise("stable"))
    m = m.withColumn("temporal_score", temporal.cast("bigint")).withColumn("trend", trend)
    weekly = F.col("penalty") / max(projection_weeks, 1)
    projected = clamp(js_round(F.col("temporal_score") - weekly * projection_weeks), F.lit(0), F.lit(100))
    instability = F.abs(ct) + F.abs(ca)
    conf = clamp(1 - instability / 200 - projection_weeks / 52, F.lit(0.1), F.lit(1.0))
    t = F.col("temporal_score")
    deg = F.col("trend") == "degrading"
    risk = (F.when((t < 30) | ((t < 50) & deg), "critical")
            .when((t < 50) | (deg & (F.col("authors") <= 1)), "high")
            .when((t < 70) | deg, "medium").otherwise("low"))
    return m.select("project_id", "module", F.col("static_score").cast("bigint").alias("static_score"),
                    "temporal_score", "trend", projected.cast("bigint").alias("projected_score"),
                    js_round_to(conf, 2).alias("confidence"), risk.alias("risk"))


# ---------------------------------------------------------------- H09 ----
def overall_trend(temporal: DataFrame) -> DataFrame:
    """Per project: share of degrading / improving modules (> 30%) and the
    rounded mean temporal score."""
    g = temporal.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("trend") == "degrading", 1).otherwise(0)).alias("deg"),
        F.sum(F.when(F.col("trend") == "improving", 1).otherwise(0)).alias("imp"),
        F.avg("temporal_score").alias("avg_score"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("trend") == "degrading", F.col("module")))), ",")
        .alias("degrading_modules"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("trend") == "improving", F.col("module")))), ",")
        .alias("improving_modules"))
    return g.select("project_id",
                    F.when(F.col("deg") / F.col("n") > 0.3, "degrading")
                    .when(F.col("imp") / F.col("n") > 0.3, "improving").otherwise("stable").alias("overall_trend"),
                    js_round(F.col("avg_score")).cast("bigint").alias("overall_temporal_score"),
                    "degrading_modules", "improving_modules")


# ---------------------------------------------------------------- H17 ----
def weekly_features(timeline: DataFrame, total_files: DataFrame) -> DataFrame:
    """Per project week: commit and churn intensity (vs the period maximum),
    active-file ratio and the complexity signal, 3 decimals; week_offset =
    position of the week in time order.

    ``timeline``: (project_id, week, commits, churn, active_files);
    ``total_files``: (project_id, files).
    """
    mx = timeline.groupBy("project_id").agg(
        F.greatest(F.max("commits"), F.lit(1)).alias("max_c"),
        F.greatest(F.max("churn"), F.lit(1)).alias("max_ch"))
    from pyspark.sql import Window
    t = (timeline.join(mx, "project_id").join(total_files, "project_id", "left")
         .withColumn("eff", F.greatest(F.coalesce(F.col("files"), F.lit(0)), F.lit(1)))
         .withColumn("week_offset", (F.row_number().over(
             Window.partitionBy("project_id").orderBy("week")) - 1).cast("bigint")))
    ci = F.col("commits") / F.col("max_c")
    chi = F.col("churn") / F.col("max_ch")
    ar = F.least(F.lit(1.0), F.col("active_files") / F.col("eff"))
    sig = TL_CHURN_WEIGHT * chi + TL_COMMIT_WEIGHT * ci + TL_FILE_WEIGHT * ar
    return t.select("project_id", "week_offset", "week", js_round_to(ci, 3).alias("commit_intensity"),
                    js_round_to(chi, 3).alias("churn_intensity"), js_round_to(ar, 3).alias("active_file_ratio"),
                    js_round_to(sig, 3).alias("complexity_signal"))


# ------------------------------------------------------------ H18/H19 ----
# Least number of consecutive weeks in a block of a series.
BLOCK_WEEKS = 256


def _block_length(alpha: float) -> int:
    """Weeks after which (1 - alpha)^length is below 2^-60, ``BLOCK_WEEKS`` at
    least; a smoothing that never forgets takes a series as one block."""
    keep = abs(1 - alpha)
    if keep >= 1:
        return 2 ** 31 - 1
    return max(BLOCK_WEEKS, math.ceil(-60 * math.log(2) / math.log(keep))) if keep else BLOCK_WEEKS


def _keyed(df: DataFrame, other: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` joined to ``other`` by ``keys``; null keys are equal."""
    other = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(other, same).drop(*[f"_k{i}" for i in range(len(keys))])


def reconstruct_scores(features: DataFrame, current: DataFrame | float = 75.0,
                       alpha: float = SMOOTHING_ALPHA, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Score per week and ``keys`` rebuilt backwards from the current score.

    The last week holds ``current``; each earlier week adds
    clamp(3 x (signal of the following week - mean signal), -3, 3) and is
    clamped to 0..100; the series is then smoothed (EMA) and rounded to
    one decimal.  ``current``: a number or a (project_id, current) table.

    A series of any length is cut into blocks of consecutive weeks.  Steps of
    the walk x -> clamp(x + d, 0, 100) one after the other are again of the form
    x -> min(hi, max(lo, x + s)), so each block becomes one such step; walking
    those finds the score that a block starts from, and blocks are then walked
    side by side.  The smoothing forgets what was before the block before (``ema``).
    """
    length = _block_length(alpha)
    rows = numbered(features.select(*keys, "week_offset", "complexity_signal"), [*keys],
                    ["week_offset", "complexity_signal"], pos="_q", total="_n")
    heads = rows.groupBy(*keys).agg(F.avg("complexity_signal").alias("_mean"))
    if isinstance(current, DataFrame):
        heads = heads.join(current.select("project_id", F.col("current").cast("double").alias("_cur")), "project_id")
    else:
        heads = heads.withColumn("_cur", F.lit(float(current)))
    # the signal of place q changes the score of place q - 1; the last place has no change
    place = F.when(F.col("_q") == 1, F.col("_n")).otherwise(F.col("_q") - 1)
    change = F.when(F.col("_q") > 1, clamp((F.col("complexity_signal") - F.col("_mean")) * MAX_WEEKLY_PENALTY,
                                           F.lit(-MAX_WEEKLY_PENALTY), F.lit(MAX_WEEKLY_PENALTY)))
    moves = _keyed(rows, heads, keys).select(*keys, "_cur", place.alias("p"), change.alias("d"))
    # latest week first; a block has ``length`` rows at most
    blocks = materialize(moves.groupBy(*keys, F.floor((F.col("p") - 1) / length).alias("_block")).agg(
        F.max("_cur").alias("_cur"), F.sort_array(F.collect_list(F.struct("p", "d")), asc=False).alias("_a")))
    low, high = F.lit(0.0), F.lit(100.0)
    still = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    whole = F.aggregate("_a", still, lambda f, m: F.when(m["d"].isNull(), f).otherwise(F.struct(
        (f["s"] + m["d"]).alias("s"), clamp(f["lo"] + m["d"], low, high).alias("lo"), clamp(f["hi"] + m["d"], low, high).alias("hi"))))
    chain = blocks.select(*keys, "_block", "_cur", whole.alias("f")).groupBy(*keys).agg(
        F.max("_cur").alias("_cur"), F.sort_array(F.collect_list(F.struct("_block", "f")), asc=False).alias("_fs"))
    starts = F.aggregate("_fs", F.array("_cur"), lambda acc, b: F.concat(acc, F.array(
        clamp(F.element_at(acc, -1) + b["f"]["s"], b["f"]["lo"], b["f"]["hi"]))))
    starts = chain.select(*keys, F.explode(F.arrays_zip(F.col("_fs._block").alias("b"), F.slice(starts, 1, F.size("_fs")).alias("x"))).alias("z")).select(
        *keys, F.col("z.b").alias("_block"), F.col("z.x").alias("_x"))
    walked = F.aggregate("_a", F.array("_x"), lambda acc, m: F.concat(acc, F.array(F.when(
        m["d"].isNull(), F.element_at(acc, -1)).otherwise(clamp(F.element_at(acc, -1) + m["d"], low, high)))))
    raw = materialize(_keyed(blocks, starts, (*keys, "_block")).select(
        *keys, "_block", F.reverse(F.slice(walked, 2, F.size("_a"))).alias("_raw")))
    first, rest = F.element_at("_raw", 1), F.slice("_raw", 2, F.size("_raw"))
    step = lambda e, v: F.lit(alpha) * v + F.lit(1 - alpha) * e
    ends = raw.where(F.size("_raw") == length).select(
        *keys, (F.col("_block") + 1).alias("_block"), F.aggregate(rest, first, step).alias("_before"))
    begin = raw.select(*keys, F.col("_block")).where(F.col("_block") == 0).withColumn("_before", F.lit(None).cast("double"))
    b = _keyed(raw, ends.unionByName(begin), (*keys, "_block"))
    e = F.aggregate(rest, F.array(F.when(F.col("_block") == 0, first).otherwise(step(F.col("_before"), first))),
                    lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))
    out = b.select(*keys, "_block", F.posexplode(e).alias("pos", "e"))
    return out.select(*keys, (F.col("_block") * length + F.col("pos")).cast("bigint").alias("week_offset"),
                      js_round_to(F.col("e"), 1).alias("score"))


def ema(df: DataFrame, key: str, order: str, col: str, alpha: float = SMOOTHING_ALPHA) -> DataFrame:
    """Exponential smoothing of ``col`` per ``key`` in ``order``; rows
    without a value take no part.

    A series is cut into blocks of consecutive places, so long that
    (1 - alpha)^length is below 2^-60: what was before a block no longer shows
    in a double at its end (117 places for 0.3).  So the value that a block
    starts from is found in the one block before it alone, and blocks are
    folded side by side, each in the order of its rows.
    """
    x = F.col(col).cast("double")
    if alpha >= 1:
        return df.where(x.isNotNull()).select(key, order, col, x.alias("ema"))
    length = max(1, math.ceil(-60 * math.log(2) / math.log(1 - alpha)))
    rows = numbered(df.where(x.isNotNull()).select(key, order, col), [key], [order, col], pos="_pos")
    blocks = rows.groupBy(key, F.floor((F.col("_pos") - 1) / length).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", order, col))).alias("_a"))
    vals = F.transform("_a", lambda s: s[col].cast("double"))
    step = lambda e, v: F.lit(alpha) * v + F.lit(1 - alpha) * e
    ends = blocks.where(F.size("_a") == length).select(
        F.col(key).alias("_key"), (F.col("_block") + 1).alias("_next"),
        F.aggregate(F.slice(vals, 2, length), F.element_at(vals, 1), step).alias("_start"))
    b = blocks.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_next")), "left")
    first = F.element_at(vals, 1)
    e = F.aggregate(F.slice(vals, 2, length), F.array(F.when(F.col("_start").isNull(), first).otherwise(step(F.col("_start"), first))),
                    lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))
    out = b.select(key, F.explode(F.arrays_zip(F.col("_a").alias("a"), e.alias("e"))).alias("z"))
    return out.select(key, F.col(f"z.a.{order}").alias(order), F.col(f"z.a.{col}").alias(col), F.col("z.e").alias("ema"))


# ---------------------------------------------------------------- H21 ----
def wls(series: DataFrame, key: str = "key", half_life: float = HALF_LIFE) -> DataFrame:
    """Weighted least squares per key with recency weights.

    ``series``: (key, x, y, w) with w nullable; missing weights are
    2^(-(max_x - x)/half_life).  Returns n, slope (3 dp), intercept (2 dp),
    r2 (3 dp), slope standard error (3 dp; NULL = infinite), significance
    (|t| > 2) and last_x.  One pass for the sums, one for residuals.
    """
    lam = math.log(2) / half_life
    mx = series.groupBy(key).agg(F.max("x").alias("last_x"))
    s = series.join(mx, key).withColumn(
        "wt", F.coalesce(F.col("w").cast("double"), F.exp(F.lit(-lam) * (F.col("last_x") - F.col("x")))))
    sums = s.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("last_x").alias("last_x"),
        F.sum("wt").alias("sw"), F.sum(F.col("wt") * F.col("x")).alias("swx"),
        F.sum(F.col("wt") * F.col("y")).alias("swy"),
        F.sum(F.col("wt") * F.col("x") * F.col("x")).alias("swxx"),
        F.sum(F.col("wt") * F.col("x") * F.col("y")).alias("swxy"))
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    flat = (F.col("n") == 1) | (F.abs(det) < 1e-10)
    sums = sums.withColumn("det", det).withColumn(
        "slope_raw", F.when(flat, F.lit(0.0)).otherwise(
            (F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy")) / F.col("det"))).withColumn(
        "icpt_raw", F.when(flat, F.col("swy") / F.col("sw")).otherwise(
            (F.col("swxx") * F.col("swy") - F.col("swx") * F.col("swxy")) / F.col("det")))
    res = (s.join(sums.select(key, "slope_raw", "icpt_raw", "sw", "swy"), key)
           .groupBy(key).agg(
               F.sum(F.col("wt") * F.pow(F.col("y") - F.col("swy") / F.col("sw"), 2)).alias("ss_tot"),
               F.sum(F.col("wt") * F.pow(F.col("y") - (F.col("slope_raw") * F.col("x") + F.col("icpt_raw")), 2))
               .alias("ss_res")))
    j = sums.join(res, key)
    r2 = F.when(F.col("ss_tot") > 0, F.greatest(F.lit(0.0), 1 - F.col("ss_res") / F.col("ss_tot"))).otherwise(0.0)
    mse = F.col("ss_res") / F.greatest(F.col("n") - 2, F.lit(1))
    se = F.sqrt(mse * F.col("sw") / F.greatest(F.col("det"), F.lit(1e-10)))
    j = j.withColumn("se_raw", F.when(flat, F.lit(None).cast("double")).otherwise(se))
    t = (F.when(F.col("se_raw") > 1e-10, F.abs(F.col("slope_raw") / F.col("se_raw")))
         .when(F.abs(F.col("slope_raw")) > 1e-10, F.lit(float("inf"))).otherwise(0.0))
    return j.select(
        key, F.col("n").cast("bigint").alias("n"), F.col("last_x").cast("double").alias("last_x"),
        js_round_to(F.col("slope_raw"), 3).alias("slope"),
        js_round_to(F.col("icpt_raw"), 2).alias("intercept"),
        F.when(F.col("n") == 1, F.lit(1.0)).when(flat, F.lit(0.0)).otherwise(js_round_to(r2, 3)).alias("r2"),
        js_round_to(F.col("se_raw"), 3).alias("slope_se"),
        F.when(flat, F.lit(False)).otherwise(F.coalesce(t > 2, F.lit(False))).alias("significant"))


def clamp_score(x) -> Column:
    return clamp(js_round_to(x, 1), F.lit(0.0), F.lit(100.0))


# ---------------------------------------------------------------- H22 ----
def trajectory(fit: DataFrame, key: str = "key", horizon: int = HORIZON) -> DataFrame:
    """One row per future week: clamped prediction, 95% band, confidence."""
    t = fit.select(key, "last_x", "slope", "intercept", "r2", "slope_se",
                   F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("d"))
    week = F.col("last_x") + F.col("d")
    pred = F.col("slope") * week + F.col("intercept")
    width = F.col("slope_se") * F.col("d") * 1.96
    conf = F.greatest(F.lit(0.05), F.col("r2") * F.exp(F.lit(-0.1) * F.col("d")))
    return t.select(key, week.alias("week_offset"), clamp_score(pred).alias("predicted"),
                    F.when(width.isNull(), F.lit(0.0)).otherwise(clamp_score(pred - width)).alias("lower"),
                    F.when(width.isNull(), F.lit(100.0)).otherwise(clamp_score(pred + width)).alias("upper"),
                    js_round_to(conf, 2).alias("confidence"))


# ---------------------------------------------------------------- H23 ----
def decay_forecast(series: DataFrame, key: str = "key", order: str = "x", horizon: int = HORIZON,
                   threshold: float = CRITICAL_THRESHOLD, min_points: int = MIN_POINTS) -> DataFrame:
    """Decay forecast per key with at least ``min_points`` points: current
    and predicted score, delta, weekly delta, weeks to the critical threshold
    (NULL = never) and confidence."""
    fit = wls(series, key).where(F.col("n") >= min_points)
    cur = series.groupBy(key).agg(F.max_by("y", F.struct("x", order)).alias("current")) if order != "x" else \
        series.groupBy(key).agg(F.max_by("y", "x").alias("current"))
    j = fit.join(cur, key)
    pred = clamp_score(F.col("slope") * (F.col("last_x") + horizon) + F.col("intercept"))
    tw = (F.lit(threshold) - F.col("intercept")) / F.col("slope") - F.col("last_x")
    weeks = (F.when(F.col("slope") >= 0, F.lit(None).cast("bigint"))
             .when(F.col("current") <= threshold, F.lit(0).cast("bigint"))
             .when(tw > 0, F.ceil(tw).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    conf = F.col("r2") + F.least(F.lit(0.2), F.col("n") / 120.0)
    conf = F.when(F.col("significant"), conf).otherwise(conf * 0.5)
    conf = clamp(conf, F.lit(0.05), F.lit(0.95))
    return j.select(key, F.col("current").cast("double").alias("current"), pred.alias("predicted"),
                    js_round_to(pred - F.col("current"), 1).alias("delta"),
                    js_round_to(F.col("slope"), 2).alias("weekly_delta"), weeks.alias("weeks_to_threshold"),
                    js_round_to(conf, 2).alias("confidence"), "n")


# ---------------------------------------------------------------- H25 ----
def daily_trend(history: DataFrame, key: str = "project_id", min_points: int = 3) -> DataFrame:
    """Least-squares trend of the overall score per day over stored history:
    slope, r2 (4 dp), 30- and 90-day projections (1 dp), label at +-0.1."""
    first = history.groupBy(key).agg(F.min("ts").alias("t0"))
    h = history.join(first, key).withColumn(
        "x", (F.unix_micros("ts") - F.unix_micros("t0")) / 86400e6).withColumn("y", F.col("overall"))
    s = h.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                           F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
                           F.max("x").alias("last_x")).where(F.col("n") >= min_points)
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = s.withColumn("slope", F.when(den != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / den)
                     .otherwise(0.0))
    s = s.withColumn("icpt", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    r = (h.join(s.select(key, "slope", "icpt", "sy", "n"), key).groupBy(key).agg(
        F.sum(F.pow(F.col("y") - (F.col("slope") * F.col("x") + F.col("icpt")), 2)).alias("ss_res"),
        F.sum(F.pow(F.col("y") - F.col("sy") / F.col("n"), 2)).alias("ss_tot")))
    j = s.join(r, key)
    r2 = F.when(F.col("ss_tot") != 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(0.0)
    p30 = clamp(F.col("slope") * (F.col("last_x") + 30) + F.col("icpt"), F.lit(0.0), F.lit(100.0))
    p90 = clamp(F.col("slope") * (F.col("last_x") + 90) + F.col("icpt"), F.lit(0.0), F.lit(100.0))
    return j.select(key, F.col("n").cast("bigint").alias("n"), js_round_to(F.col("slope"), 4).alias("slope_per_day"),
                    js_round_to(r2, 4).alias("r2"), js_round_to(p30, 1).alias("projected_30d"),
                    js_round_to(p90, 1).alias("projected_90d"),
                    F.when(F.col("slope") > 0.1, "improving").when(F.col("slope") < -0.1, "degrading")
                    .otherwise("stable").alias("trend"))


# ------------------------------------------------------------ H10-H16 ----
# Fixed values of the forecast engine.
FC_ANTI_PATTERN_THRESHOLD = 40
FC_GOD_CHURN = 150
FC_SHOTGUN_COUPLINGS = 5
FC_BUS_FACTOR = 1
FC_WEEKS = 26
PATTERN_COLS = ["project_id", "module", "type", "severity", "weeks_to_threshold", "confidence", "subject"]


def _velocity_cols(temporal: DataFrame, modules: DataFrame) -> DataFrame:
    return temporal.join(modules.select("project_id", "module", "churn_trend", "commit_acceleration", "direction",
                                        "authors", F.col("commits").alias("module_commits")),
                         ["project_id", "module"])


def emerging_god_class(files: DataFrame, tv: DataFrame, churn_threshold: float = FC_GOD_CHURN,
                       weeks: int = FC_WEEKS) -> DataFrame:
    """Files whose churn per commit >= threshold in modules with rising
    churn, projected to reach twice the threshold within ``weeks``."""
    j = files.join(tv.select("project_id", "module", "churn_trend"), ["project_id", "module"]).where(
        (F.col("churn_rate") >= churn_threshold) & (F.col("churn_trend") > 0))
    growth = F.col("churn_rate") * (F.col("churn_trend") / 100) / 4
    w = F.ceil((F.lit(2.0 * churn_threshold) - F.col("churn_rate")) / growth)
    j = j.withColumn("w", w).where(F.col("w") <= weeks)
    return j.select("project_id", "module", F.lit("emerging-god-class").alias("type"),
                    F.when(F.col("w") <= 8, "alert").when(F.col("w") <= 16, "warning").otherwise("watch").alias("severity"),
                    F.col("w").cast("bigint").alias("weeks_to_threshold"),
                    js_round_to(F.least(F.lit(0.9), 0.5 + F.col("commits") / 50), 6).alias("confidence"),
                    F.col("path").alias("subject"))


def _coupling_modules(couplings: DataFrame) -> DataFrame:
    """Each coupling pair once per module it touches (module = first directory)."""
    from repolens.functions.paths import module_top
    return couplings.select("project_id", "confidence", "file_b", F.explode(F.array_distinct(F.array(
        module_top(F.col("file_a")), module_top(F.col("file_b"))))).alias("module"))


def emerging_shotgun(couplings: DataFrame, threshold: int = FC_SHOTGUN_COUPLINGS) -> DataFrame:
    """Modules touched by >= ``threshold`` coupled pairs."""
    g = _coupling_modules(couplings).groupBy("project_id", "module").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_conf")).where(F.col("n") >= threshold)
    return g.select("project_id", "module", F.lit("emerging-shotgun-surgery").alias("type"),
                    F.when(F.col("n") > 10, "alert").otherwise("warning").alias("severity"),
                    F.lit(4).cast("bigint").alias("weeks_to_threshold"), js_round_to(F.col("avg_conf"), 6).alias("confidence"),
                    F.col("n").cast("string").alias("subject"))


def bus_factor_risk(tv: DataFrame, max_authors: int = FC_BUS_FACTOR, weeks: int = FC_WEEKS) -> DataFrame:
    """Modules with <= ``max_authors`` authors and at least 5 commits."""
    f = tv.where((F.col("authors") <= max_authors) & (F.col("module_commits") >= 5))
    return f.select("project_id", "module", F.lit("bus-factor-risk").alias("type"),
                    F.when(F.col("trend") == "degrading", "alert").otherwise("warning").alias("severity"),
                    F.lit(weeks).cast("bigint").alias("weeks_to_threshold"), F.lit(0.8).alias("confidence"),
                    F.col("authors").cast("string").alias("subject"))


def complexity_spiral(tv: DataFrame, threshold: int = FC_ANTI_PATTERN_THRESHOLD, weeks: int = FC_WEEKS,
                      projection_weeks: int = PROJECTION_WEEKS) -> DataFrame:
    """Churn trend > 20 and accelerating, temporal score reaching the
    threshold within ``weeks`` at the projected decay."""
    decay = (F.col("static_score") - F.col("projected_score")) / projection_weeks
    w = F.when(decay > 0, F.ceil((F.col("temporal_score") - threshold) / decay))
    f = (tv.where((F.col("churn_trend") > 20) & (F.col("direction") == "accelerating"))
         .withColumn("w", w).where(F.col("w").isNotNull() & (F.col("w") <= weeks)))
    return f.select("project_id", "module", F.lit("complexity-spiral").alias("type"),
                    F.when(F.col("w") <= 8, "alert").otherwise("warning").alias("severity"),
                    F.col("w").cast("bigint").alias("weeks_to_threshold"), F.col("confidence"),
                    F.col("temporal_score").cast("string").alias("subject"))


def coupling_magnet(couplings: DataFrame, tv: DataFrame, min_inbound: int = 3,
                    min_confidence: float = 0.5) -> DataFrame:
    """>= 3 high-confidence (> ``min_confidence``) couplings whose second
    file is in the module, while the module's commit rate is rising."""
    from repolens.functions.paths import module_top
    inb = (couplings.where(F.col("confidence") > min_confidence)
           .groupBy("project_id", module_top(F.col("file_b")).alias("module")).agg(F.count(F.lit(1)).alias("n")))
    f = inb.join(tv.select("project_id", "module", "commit_acceleration"), ["project_id", "module"]).where(
        (F.col("n") >= min_inbound) & (F.col("commit_acceleration") > 0))
    return f.select("project_id", "module", F.lit("coupling-magnet").alias("type"), F.lit("watch").alias("severity"),
                    F.lit(12).cast("bigint").alias("weeks_to_threshold"), F.lit(0.6).alias("confidence"),
                    F.col("n").cast("string").alias("subject"))


def module_forecast(tv: DataFrame, patterns: DataFrame) -> DataFrame:
    """Health, 6-month outlook, bottleneck probability and risk factors per module."""
    pc = patterns.groupBy("project_id", "module").agg(
        F.count(F.lit(1)).alias("n_patterns"),
        F.sum(F.when(F.col("severity") == "alert", 1).otherwise(0)).alias("n_alerts"))
    j = tv.join(pc, ["project_id", "module"], "left").na.fill(0, ["n_patterns", "n_alerts"])
    t, deg = F.col("temporal_score"), F.col("trend") == "degrading"
    health = (F.when(t < 30, "critical").when((t < 50) | deg, "degrading").when(t < 70, "at-risk")
              .otherwise("healthy"))
    outlook = (F.when((F.col("n_alerts") > 0) | (F.col("projected_score") < 30), "breakdown")
               .when(deg | (F.col("n_patterns") > 0), "declining").otherwise("stable"))
    prob = (F.when(t < 50, 0.3).when(t < 70, 0.1).otherwise(0.0)
            + F.when(deg, 0.2).otherwise(0.0)
            + F.least(F.lit(0.3), F.col("n_patterns") * 0.1)
            + F.when(F.col("authors") <= 1, 0.1).otherwise(0.0)
            + F.when(F.col("churn_trend") > 30, 0.1).otherwise(0.0))
    risks = (F.when(deg, 1).otherwise(0) + F.when(F.col("authors") <= 1, 1).otherwise(0)
             + F.when(F.col("churn_trend") > 30, 1).otherwise(0) + F.when(F.col("n_patterns") > 0, 1).otherwise(0))
    return j.select("project_id", "module", health.alias("current_health"), outlook.alias("forecast_6_months"),
                    F.least(F.lit(1.0), js_round_to(prob, 2)).alias("bottleneck_probability"),
                    risks.cast("bigint").alias("risk_factors"), F.col("n_patterns").cast("bigint").alias("patterns"))


def outlook(overall: DataFrame, patterns: DataFrame) -> DataFrame:
    """Stormy / cloudy / sunny per project."""
    pc = patterns.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("severity") == "alert", 1).otherwise(0)).alias("alerts"))
    j = overall.select("project_id", "overall_trend").join(pc, "project_id", "left").na.fill(0, ["n", "alerts"])
    return j.select("project_id",
                    F.when((F.col("alerts") >= 2) | (F.col("overall_trend") == "degrading"), "stormy")
                    .when((F.col("alerts") >= 1) | (F.col("n") >= 3), "cloudy").otherwise("sunny").alias("outlook"),
                    F.col("n").cast("bigint").alias("patterns"), F.col("alerts").cast("bigint").alias("alerts"))


# ---------------------------------------------------------------- H20 ----
def module_signals(modules: DataFrame, max_weeks: int | None = None) -> DataFrame:
    """Synthetic weekly complexity signal per module: its churn spread over
    its active weeks, tilted by its churn trend; over the first ``max_weeks``
    weeks if given.  Columns: project_id, module, n (weeks), week_offset,
    complexity_signal.

    ``modules``: module history (commits, churn, avg_weekly_rate, churn_trend).
    """
    tw = F.greatest(F.lit(1), F.ceil(F.col("commits") / F.greatest(F.col("avg_weekly_rate"), F.lit(0.1))))
    m = modules.select("project_id", "module", "commits", "churn", "churn_trend", tw.alias("tw"))
    m = m.withColumn("n", F.col("tw") if max_weeks is None else F.least(F.col("tw"), F.lit(max_weeks)))
    # weeks by thousands, so that no row holds a whole series
    x = m.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 1000))).alias("k"))
    x = x.select("*", F.explode(F.sequence(F.col("k") * 1000, F.least(F.col("k") * 1000 + 999, F.col("n") - 1))).alias("w"))
    sig = F.least(F.lit(1.0), (F.col("churn") / F.col("tw")) * (1 + (F.col("churn_trend") / 100) * (F.col("w") / F.col("tw")))
                  / F.greatest(F.col("churn"), F.lit(1)))
    return x.select("project_id", "module", "n", F.col("w").alias("week_offset"), js_round_to(sig, 3).alias("complexity_signal"))


def module_timelines(modules: DataFrame, max_weeks: int | None = None) -> DataFrame:
    """Per module the mean of its weekly signals and their half-vs-half trend
    at +-15%."""
    x = module_signals(modules, max_weeks).withColumnRenamed("week_offset", "w").withColumnRenamed("complexity_signal", "sig")
    half = F.floor(F.col("n") / 2)
    g = x.groupBy("project_id", "module").agg(
        F.first("n").alias("n"),
        F.avg(F.when(F.col("w") < half, F.col("sig"))).alias("a1"),
        F.avg(F.when(F.col("w") >= half, F.col("sig"))).alias("a2"),
        F.avg("sig").alias("avg"))
    a1, a2 = F.coalesce(F.col("a1"), F.lit(0.0)), F.coalesce(F.col("a2"), F.lit(0.0))
    return g.select("project_id", "module", F.col("n").cast("bigint").alias("weeks"),
                    js_round_to(F.col("avg"), 3).alias("avg_complexity"),
                    F.when(a2 > a1 * 1.15, "increasing").when(a2 < a1 * 0.85, "decreasing").otherwise("stable")
                    .alias("complexity_trend"))


def module_scores(modules: DataFrame, current: DataFrame | float, max_weeks: int | None = None) -> DataFrame:
    """Weekly score per module, rebuilt from its signals and the project's
    current score: (project_id, module, week_offset, score)."""
    return reconstruct_scores(module_signals(modules, max_weeks), current, keys=("project_id", "module"))


def current_scores(modules: DataFrame) -> DataFrame:
    """(project_id, current): mean static score of the project's modules, 1 decimal."""
    return static_scores(modules).groupBy("project_id").agg(js_round_to(F.avg("static_score"), 1).alias("current"))


# ---------------------------------------------------------------- H24 ----
# Fixed values of the module predictions.
WARNING_THRESHOLD = 60.0
HIGH_COMPLEXITY = 0.7
DRIVER_CHURN = 30
DRIVER_COMMITS = 20
FALLBACK_CONFIDENCE = 0.1
RISK_ORDER = ["critical", "high", "medium", "low"]
NAMED_MODULES = 3


def predict_modules(timelines: DataFrame, scores: DataFrame, temporal: DataFrame | None = None,
                    horizon: int = HORIZON) -> DataFrame:
    """Decay forecast per module with its risk and drivers.

    ``timelines``: ``module_timelines``; ``scores``: ``module_scores``;
    ``temporal``: (project_id, module, trend, churn_trend,
    commit_acceleration), may lack modules.  Modules with too few points for
    a fit give no row.  ``drivers`` lists codes, ``none`` if nothing drives.
    """
    series = scores.select(F.struct("project_id", "module").alias("key"), F.col("week_offset").cast("double").alias("x"),
                           F.col("score").alias("y"), F.lit(None).cast("double").alias("w"))
    f = decay_forecast(series, "key", horizon=horizon).select("key.*", "current", "predicted", "delta", "weekly_delta",
                                                              "weeks_to_threshold", "confidence")
    j = f.join(timelines.select("project_id", "module", "avg_complexity", "complexity_trend"), ["project_id", "module"])
    if temporal is None:
        j = j.withColumns({"trend": F.lit(None).cast("string"), "churn_trend": F.lit(None).cast("double"),
                           "commit_acceleration": F.lit(None).cast("double")})
    else:
        j = j.join(temporal.select("project_id", "module", "trend", "churn_trend", "commit_acceleration"),
                   ["project_id", "module"], "left")
    rising = F.col("complexity_trend") == "increasing"
    percent = lambda c: F.concat(F.lit("+"), js_round(F.col(c)).cast("bigint").cast("string"), F.lit("%"))
    drivers = F.filter(F.array(
        F.when(rising, "complexity rises"), F.when(F.col("avg_complexity") > HIGH_COMPLEXITY, "complexity is high"),
        F.when(F.col("churn_trend") > DRIVER_CHURN, F.concat(F.lit("churn "), percent("churn_trend"))),
        F.when(F.col("commit_acceleration") > DRIVER_COMMITS, F.concat(F.lit("commits "), percent("commit_acceleration"))),
        F.when(F.col("trend") == "degrading", "degrades")), lambda d: d.isNotNull())
    risk = (F.when(F.col("predicted") < CRITICAL_THRESHOLD, "critical")
            .when((F.col("predicted") < WARNING_THRESHOLD) & rising, "high").when(F.col("delta") < -5, "medium").otherwise("low"))
    return j.select("project_id", "module", "current", "predicted", "delta", "weekly_delta", "weeks_to_threshold", "confidence",
                    risk.alias("risk"), "complexity_trend",
                    F.when(F.size(drivers) == 0, "none").otherwise(F.array_join(drivers, ", ")).alias("drivers"))


def at_risk_modules(predictions: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Predictions that reach the critical threshold within twice the horizon."""
    return predictions.where(F.col("weeks_to_threshold") <= 2 * horizon)


def project_risk(current: DataFrame, scores: DataFrame, predictions: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Forecast and overall risk per project of ``current``
    (project_id, current), with what to do about it.

    ``scores``: weekly scores of projects (H18).  A project without a fit
    keeps its current score, with no decay and the lowest confidence.
    ``steps`` lists codes, ``none`` if nothing is to be done; ``rising`` names
    the worst modules whose complexity rises.
    """
    series = scores.select("project_id", F.col("week_offset").cast("double").alias("x"), F.col("score").alias("y"),
                           F.lit(None).cast("double").alias("w"))
    f = decay_forecast(series, "project_id", horizon=horizon).withColumnRenamed("current", "last")
    c = predictions.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("modules"), F.count_if(F.col("weeks_to_threshold") <= 2 * horizon).alias("at_risk"),
        F.count_if((F.col("weeks_to_threshold") <= 2 * horizon) & (F.col("risk") == "critical")).alias("critical"),
        F.count_if(F.col("complexity_trend") == "increasing").alias("increasing"))
    place = Window.partitionBy("project_id").orderBy(F.array_position(F.array(*[F.lit(r) for r in RISK_ORDER]), F.col("risk")), "module")
    named = (predictions.where(F.col("complexity_trend") == "increasing").withColumn("r", F.row_number().over(place))
             .where(F.col("r") <= NAMED_MODULES).groupBy("project_id")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "module"))), lambda m: m["module"]), ", ").alias("rising")))
    j = current.join(f, "project_id", "left").join(c, "project_id", "left").join(named, "project_id", "left")
    j = j.na.fill(0, ["modules", "at_risk", "critical", "increasing"]).na.fill("", ["rising"])
    cur = F.coalesce("last", F.col("current").cast("double"))
    pred, delta = F.coalesce("predicted", cur), F.coalesce("delta", F.lit(0.0))
    weekly, points = F.coalesce("weekly_delta", F.lit(0.0)), F.coalesce("n", F.lit(0)).cast("bigint")
    risk = (F.when((pred < CRITICAL_THRESHOLD) | (F.col("critical") >= 2), "critical").when((delta < -10) | (F.col("critical") >= 1), "high")
            .when((delta < -5) | (F.col("at_risk") > 0), "medium").otherwise("low"))
    steps = F.filter(F.array(
        F.when(F.col("critical") > 0, "stabilize modules"), F.when(F.col("increasing") > 0, "reduce complexity"),
        F.when(weekly < -0.5, "review decline"), F.when(F.col("weeks_to_threshold") <= FC_WEEKS, "act before threshold")),
        lambda d: d.isNotNull())
    count = lambda n: F.col(n).cast("bigint").alias(n)
    return j.select("project_id", cur.alias("current"), pred.alias("predicted"), delta.alias("delta"), weekly.alias("weekly_delta"),
                    "weeks_to_threshold", F.coalesce("confidence", F.lit(FALLBACK_CONFIDENCE)).alias("confidence"), points.alias("points"),
                    count("modules"), count("at_risk"), count("critical"), count("increasing"), "rising", risk.alias("risk"),
                    F.when(F.size(steps) == 0, "none").otherwise(F.array_join(steps, ", ")).alias("steps"))
