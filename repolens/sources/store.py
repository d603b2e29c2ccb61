"""Snapshot store on parquet.

The store is a set of parquet tables partitioned by ``project_id``:
``analyses`` (one header row per snapshot), ``anti_patterns`` and ``edges``
(child rows keyed by ``analysis_id``), ``projects``, ``decisions``,
``validations``, ``forecasts``.  Appends are plain parquet appends; the
header is written last so a reader joining children to headers never sees a
half-written snapshot.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.functions.core import round6
from repolens.operators.ranking import numbered
from repolens.operators.snapshots import fmt_ts


def _path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


# ---------------------------------------------------------------- S05 ----
def write_snapshot(analysis: DataFrame, anti_patterns: DataFrame, edges: DataFrame, base: str,
                   batch_id: str | None = None) -> str:
    """Append one batch of snapshots.

    ``analysis``: one row per project (project_id + score columns), without
    ``analysis_id``; a batch-scoped id ``<batch_id>:<project_id>`` is
    attached to all three writes.  Children first, header last.
    """
    import uuid
    bid = batch_id or uuid.uuid4().hex
    aid = F.concat(F.lit(bid + ":"), F.col("project_id"))
    (anti_patterns.withColumn("analysis_id", aid)
     .write.mode("append").partitionBy("project_id").parquet(_path(base, "anti_patterns")))
    (edges.withColumn("analysis_id", aid)
     .write.mode("append").partitionBy("project_id").parquet(_path(base, "edges")))
    (analysis.withColumn("analysis_id", aid).withColumn("ts", F.current_timestamp())
     .write.mode("append").partitionBy("project_id").parquet(_path(base, "analyses")))
    return bid


def read_store(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(_path(base, table))


def complete_children(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Child rows whose header exists (hides snapshots still being written)."""
    heads = read_store(spark, base, "analyses").select("analysis_id")
    return read_store(spark, base, table).join(heads, "analysis_id", "left_semi")


# ---------------------------------------------------------------- S06 ----
def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge project records by unique ``path``: the newest ``updated_at``
    wins for every attribute, ``created_at`` keeps the earliest value.

    Plain parquet has no MERGE, so the caller rewrites the table with the
    result (one shuffle on ``path``).
    """
    u = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy(F.desc("updated_at"), F.desc("project_id"))
    first_created = F.min("created_at").over(Window.partitionBy("path"))
    return (u.withColumn("created_at", first_created)
            .withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn"))


# ---------------------------------------------------------------- S07 ----
def append_records(df: DataFrame, base: str, table: str) -> None:
    """Append validations / forecasts / decision records."""
    df.write.mode("append").partitionBy("project_id").parquet(_path(base, table))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Current status per decision = status of its newest record."""
    return decisions.groupBy("project_id", "decision_id").agg(
        F.max_by("title", F.struct("updated_at", "record_id")).alias("title"),
        F.max_by("status", F.struct("updated_at", "record_id")).alias("status"),
        F.count(F.lit(1)).cast("bigint").alias("updates"))


# ---------------------------------------------------------------- S08 ----
EXPORT_BLOCK = 1000


def _blocks(items: DataFrame, section: str, order: list, fields: list, block: int) -> DataFrame:
    """(project_id, section, block, items, doc): ``fields`` of the items in
    ``order`` as one JSON array per project and block of places."""
    n = numbered(items, ["project_id"], order, pos="pos_").select(
        "project_id", "pos_", F.floor((F.col("pos_") - 1) / block).alias("block"), F.struct(*fields).alias("item"))
    got = F.transform(F.sort_array(F.collect_list(F.struct("pos_", "item"))), lambda x: x["item"])
    return n.groupBy("project_id", "block").agg(F.count(F.lit(1)).cast("bigint").alias("items"), got.alias("got")).select(
        "project_id", F.lit(section).alias("section"), F.col("block").cast("bigint").alias("block"), "items",
        F.to_json("got", {"ignoreNullFields": "false"}).alias("doc"))


def export_history(projects: DataFrame, analyses: DataFrame, trends: DataFrame,
                   decisions: DataFrame | None = None, block: int = EXPORT_BLOCK) -> DataFrame:
    """Project histories as JSON documents, one row per project, section and
    block of at most ``block`` items; an index of a project is its rows.

    Sections: ``project`` (one item), ``analyses`` (newest first),
    ``score_history`` (oldest first), ``anti_pattern_trends`` (most frequent
    first), ``decisions`` (newest first).  A document is the JSON array of
    its items; the arrays of a section's blocks, in order, are the section.
    Items of projects without a record stay out; a section without items has
    no rows; null fields are written as null.  However long a history, a row
    holds one block, and places are counted without a window over a project.
    """
    scores = [round6(c).alias(c) for c in ("overall", "modularity", "coupling", "cohesion", "layering")]
    known = projects.select("project_id").distinct()
    ours = lambda df: df.join(known, "project_id", "left_semi")
    times = [c for c, t in projects.dtypes if t.startswith("timestamp")]
    record = F.struct(*[fmt_ts(c).alias(c) if c in times else F.col(c) for c in projects.columns])
    head = projects.select("project_id", F.lit("project").alias("section"), F.lit(0).cast("bigint").alias("block"),
                           F.lit(1).cast("bigint").alias("items"),
                           F.to_json(F.array(record), {"ignoreNullFields": "false"}).alias("doc"))
    a, ts = ours(analyses), fmt_ts("ts").alias("ts")
    parts = [
        _blocks(a, "analyses", [F.desc("ts"), F.desc("analysis_id")], [ts, "analysis_id", *scores], block),
        _blocks(a, "score_history", ["ts", "analysis_id"], [ts, scores[0]], block),
        _blocks(ours(trends), "anti_pattern_trends", [F.desc("occurrences"), "name", "severity"],
                ["name", "severity", "occurrences", "first_seen", "last_seen"], block)]
    if decisions is not None:
        parts.append(_blocks(ours(decisions), "decisions", [F.desc("updated_at"), F.desc("record_id")],
                             [fmt_ts("updated_at").alias("updated_at"), "decision_id", "title", "status"], block))
    for p in parts:
        head = head.unionByName(p)
    return head


# ---------------------------------------------------------------- S09 ----
RULE_SCHEMA = "project_id string, rule string, threshold double, from_pattern string, to_pattern string"


def rules_df(spark: SparkSession, rules: dict, project_id: str = "*") -> DataFrame:
    """Rule set (quality gates + boundaries) as a small table.

    ``rules`` follows the YAML layout: ``quality_gates`` (min_overall_score,
    max_critical_anti_patterns, max_high_anti_patterns) and ``boundaries``
    (allow_circular_dependencies, banned_imports [str | {from, to}]).
    ``project_id='*'`` applies to every project.
    """
    rows = []
    qg = rules.get("quality_gates") or {}
    for k in ("min_overall_score", "max_critical_anti_patterns", "max_high_anti_patterns"):
        if qg.get(k) is not None:
            rows.append((project_id, k, float(qg[k]), None, None))
    b = rules.get("boundaries") or {}
    if b.get("allow_circular_dependencies") is False:
        rows.append((project_id, "no_circular", None, None, None))
    for item in b.get("banned_imports") or []:
        if isinstance(item, str):
            rows.append((project_id, "banned_import", None, None, item))
        else:
            rows.append((project_id, "banned_import", None, item.get("from"), item.get("to")))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules stored as JSON lines ``{project_id, rule, threshold, from_pattern, to_pattern}``."""
    return spark.read.schema(RULE_SCHEMA).json(path)


def dumps_rules(rules: dict) -> str:
    return json.dumps(rules, sort_keys=True)
