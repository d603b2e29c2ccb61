"""Structured Streaming jobs (T01-T06) and their batch twins.

Every job is written as a DataFrame transformation that works on a
streaming or a batch DataFrame; the ``start_*`` helpers wire a stream to a
sink.  Event time is ``ts``; late data is bounded by a watermark where the
job aggregates by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEGRADATION_DROP = 3.0
FLOOR_BUFFER = 2.0

# The five event kinds of the event log.
EVENT_KINDS = ["violation.detected", "analysis.completed", "score.degraded", "constraint.created",
               "rule.suggested"]

PAYLOAD_SCHEMA = "k BIGINT"


# ---------------------------------------------------------------- T06 ----
def event_log(raw: DataFrame) -> DataFrame:
    """Typed event log from raw rows (event_id, ts, project_id, kind, value,
    payload JSON): parsed payload, kind-specific columns, unknown kinds
    dropped."""
    p = F.from_json(F.col("payload"), PAYLOAD_SCHEMA)
    r = raw.where(F.col("kind").isin(EVENT_KINDS)).withColumn("p", p)
    k = F.col("p.k")
    kind = F.col("kind")
    return r.select(
        "event_id", "ts", "project_id", "kind",
        F.when(kind.isin("analysis.completed", "violation.detected"), F.col("value")).alias("score"),
        F.when(kind.isin("analysis.completed", "violation.detected"), k).alias("anti_pattern_count"),
        F.when(kind == "score.degraded", F.col("value") + k).alias("previous_score"),
        F.when(kind == "score.degraded", F.col("value")).alias("current_score"),
        F.when(kind == "score.degraded", -k.cast("double")).alias("delta"),
        F.when(kind == "constraint.created", F.concat(F.lit("rule-"), (k % 4).cast("string"))).alias("rule_type"))


# ---------------------------------------------------------------- T01 ----
def constraints_batch(violations: DataFrame) -> DataFrame:
    """Batch twin: first violation (by ts) per (project, rule) becomes an
    active constraint."""
    w = Window.partitionBy("project_id", "rule").orderBy("ts", "level", "message")
    return (violations.withColumn("rn", F.row_number().over(w)).where("rn = 1")
            .select("project_id", F.col("rule").alias("rule_type"), "level", "message",
                    F.col("ts").alias("created_at"), F.lit(True).alias("active")))


def constraints_stream(violations: DataFrame) -> DataFrame:
    """Stream: the earliest violation (by ts, level, message) of each (project,
    rule) pair, whatever order they arrive in; the state holds one row per
    pair.  For the update or complete output mode: a pair is emitted again if
    an earlier violation arrives."""
    first = violations.groupBy("project_id", "rule").agg(F.min(F.struct("ts", "level", "message")).alias("v"))
    return first.select("project_id", F.col("rule").alias("rule_type"), "v.level", "v.message",
                        F.col("v.ts").alias("created_at"), F.lit(True).alias("active"))


# ---------------------------------------------------------------- T02 ----
DEGRADATION_SCHEMA = T.StructType([
    T.StructField("project_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("previous_score", T.DoubleType()), T.StructField("current_score", T.DoubleType()),
    T.StructField("delta", T.DoubleType())])
STATE_SCHEMA = T.StructType([T.StructField("last_ts", T.TimestampType()),
                             T.StructField("last_id", T.LongType()),
                             T.StructField("last_score", T.DoubleType())])


def degradation_batch(analyses: DataFrame, drop: float = DEGRADATION_DROP) -> DataFrame:
    """Batch twin: an event whenever a score is more than ``drop`` below the
    previous one of the same project (time order, ties by analysis id)."""
    w = Window.partitionBy("project_id").orderBy("ts", "analysis_id")
    r = analyses.withColumn("previous_score", F.lag("overall").over(w))
    return (r.where(F.col("overall") - F.col("previous_score") < -drop)
            .select("project_id", "ts", "previous_score", F.col("overall").alias("current_score"),
                    (F.col("overall") - F.col("previous_score")).alias("delta")))


def _degradation_state_fn(drop: float):
    import pandas as pd

    def fn(key, pdfs, state):
        project = key[0]
        if state.exists:
            last_ts, last_id, last_score = state.get
        else:
            last_ts, last_id, last_score = None, None, None
        # what one micro-batch holds of the project, in time order, each row once
        batch = pd.concat(list(pdfs)).sort_values(["ts", "analysis_id"], kind="stable").drop_duplicates(["ts", "analysis_id"])
        if last_ts is not None:  # older than what the state has seen: ignored
            batch = batch[(batch["ts"] > last_ts) | ((batch["ts"] == last_ts) & (batch["analysis_id"] > last_id))]
        score = batch["overall"].astype("float64")
        previous = score.shift(1)
        if len(batch):
            previous.iloc[0] = float("nan") if last_score is None else last_score
            last = batch.iloc[-1]
            state.update((last["ts"], int(last["analysis_id"]), float(last["overall"])))
        out = pd.DataFrame({"project_id": project, "ts": batch["ts"], "previous_score": previous, "current_score": score, "delta": score - previous})
        yield out[out["delta"] < -drop]
    return fn


def degradation_stream(analyses: DataFrame, drop: float = DEGRADATION_DROP) -> DataFrame:
    """Stream: per project state holds the last (ts, id, score); each new
    snapshot more than ``drop`` below it emits an event.  Rows older than the
    state are ignored."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    return (analyses.select("project_id", "ts", "analysis_id", "overall").groupBy("project_id")
            .applyInPandasWithState(_degradation_state_fn(drop), DEGRADATION_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.NoTimeout))


# ---------------------------------------------------------------- T03 ----
def floor_constraints(degradations: DataFrame, buffer: float = FLOOR_BUFFER) -> DataFrame:
    """One warning-level constraint per degradation: floor(current - 2)."""
    return degradations.select(
        "project_id", "ts", F.lit("warning").alias("level"), F.lit("auto.min_score_floor").alias("rule"),
        F.format_string("Auto-generated: score dropped from %.1f to %.1f",
                        F.floor(F.col("previous_score") * 10 + 0.5) / 10,
                        F.floor(F.col("current_score") * 10 + 0.5) / 10).alias("message"),
        F.col("current_score").alias("actual"),
        F.floor(F.col("current_score") - buffer).cast("bigint").alias("expected"))


# ---------------------------------------------------------------- T04 ----
def timeline_windows(commits: DataFrame, delay: str | None = "14 days") -> DataFrame:
    """Weekly (Monday-based) commits, churn and active files per project.

    ``commits``: (project_id, commit_id, ts, churn, files).  With ``delay``
    the stream accepts commits up to that late and emits each week once
    (append mode) when the watermark passes it.
    """
    c = commits.withWatermark("ts", delay) if delay else commits
    g = c.groupBy("project_id", F.window("ts", "7 days", "7 days", "4 days").alias("w")).agg(
        F.count(F.lit(1)).alias("commits"), F.sum("churn").alias("churn"), F.sum("files").alias("active_files"))
    return g.select("project_id", F.to_date(F.col("w.start")).alias("week"),
                    F.col("commits").cast("bigint").alias("commits"), F.col("churn").cast("bigint").alias("churn"),
                    F.col("active_files").cast("bigint").alias("active_files"))


# ---------------------------------------------------------------- T05 ----
def check_snapshots(analyses: DataFrame, ap: DataFrame, rules: DataFrame) -> DataFrame:
    """Validate every snapshot in the input against the quality gates.

    Returns (project_id, analysis_id, level, rule, message, actual, expected).
    """
    from repolens.operators import rules as RU
    per = (analyses.select(F.col("analysis_id").cast("string").alias("snap"), "project_id",
                           js_overall(F.col("overall")).alias("overall"))
           .join(ap.select(F.col("analysis_id").cast("string").alias("snap"), "severity"), "snap", "left"))
    scores = per.select(F.col("snap").alias("project_id"), "overall").distinct()
    aps = per.where(F.col("severity").isNotNull()).select(F.col("snap").alias("project_id"), "severity")
    proj = per.select("snap", F.col("project_id").alias("real_project")).distinct()
    # a snapshot stands as a project of its own: write the rules of its real project out for it
    of = proj.select(F.col("snap"), F.col("real_project").alias("project_id"))
    r = (RU.per_project(rules, of).join(of, "project_id").drop("project_id")
         .withColumnRenamed("snap", "project_id").select(*rules.columns))
    v = RU.quality_gates(scores, aps, r)
    return (v.join(proj, v.project_id == proj.snap)
            .select(F.col("real_project").alias("project_id"), F.col("snap").cast("bigint").alias("analysis_id"),
                    "level", "rule", "message", "actual", "expected"))


def js_overall(c):
    """Stored scores are doubles; gates compare the integer score."""
    return F.floor(c + 0.5).cast("bigint")


def start_check_stream(snapshots: DataFrame, ap: DataFrame, rules: DataFrame, out_path: str,
                       checkpoint: str):
    """foreachBatch: validate each micro-batch of snapshots (stream-static
    join to the anti-pattern and rule tables) and overwrite the batch's own
    output folder, so a replayed batch id rewrites the same result."""
    def run(batch_df, batch_id):
        res = check_snapshots(batch_df, ap, rules)
        res.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out_path.rstrip('/')}/batch_id={batch_id}")
    return (snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
