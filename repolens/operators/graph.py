"""Reference graph: edge lists, degrees, semi/anti joins, cycles.

Edge tables have the columns ``project_id, src, dst, type, weight``; file /
node tables have ``project_id, path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import basename, parent_dir

EDGE_COLS = ["project_id", "src", "dst", "type", "weight"]


# ---------------------------------------------------------------- J05 ----
def build_edges(refs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) per project as ``import`` edges of weight 1."""
    return (refs.select("project_id", F.col(src).alias("src"), F.col(dst).alias("dst"))
            .where(F.col("src").isNotNull() & F.col("dst").isNotNull())
            .dropDuplicates(["project_id", "src", "dst"])
            .withColumn("type", F.lit("import"))
            .withColumn("weight", F.lit(1.0)))


def nodes(edges: DataFrame) -> DataFrame:
    """Node set = union of both edge ends."""
    return (edges.select("project_id", F.col("src").alias("path"))
            .union(edges.select("project_id", F.col("dst").alias("path")))
            .distinct())


# ---------------------------------------------------------------- J06 ----
def degrees(edges: DataFrame, node_df: DataFrame | None = None) -> DataFrame:
    """Fan-in / fan-out per file, zero-filled over ``node_df`` (default: edge ends).

    One shuffle per side; both are partial (map-side combined) counts, so a
    hub holding a large share of the edges does not overload a task.
    """
    fan_out = edges.groupBy("project_id", F.col("src").alias("path")).agg(
        F.count(F.lit(1)).alias("fan_out"))
    fan_in = edges.groupBy("project_id", F.col("dst").alias("path")).agg(
        F.count(F.lit(1)).alias("fan_in"))
    if node_df is None:
        node_df = nodes(edges)
    return (node_df.select("project_id", "path")
            .join(fan_in, ["project_id", "path"], "left")
            .join(fan_out, ["project_id", "path"], "left")
            .select("project_id", "path",
                    F.coalesce("fan_in", F.lit(0)).cast("bigint").alias("fan_in"),
                    F.coalesce("fan_out", F.lit(0)).cast("bigint").alias("fan_out")))


# ---------------------------------------------------------------- J07 ----
def file_dependencies(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """For chosen files (project_id, path): what they import and who imports them.

    Returns (project_id, path, direction, other) with direction in
    {'imports', 'imported_by'}.
    """
    ch = chosen.select("project_id", "path").distinct()
    out_e = (edges.join(ch.withColumnRenamed("path", "src"), ["project_id", "src"], "left_semi")
             .select("project_id", F.col("src").alias("path"),
                     F.lit("imports").alias("direction"), F.col("dst").alias("other")))
    in_e = (edges.join(ch.withColumnRenamed("path", "dst"), ["project_id", "dst"], "left_semi")
            .select("project_id", F.col("dst").alias("path"),
                    F.lit("imported_by").alias("direction"), F.col("src").alias("other")))
    return out_e.unionByName(in_e)


# ---------------------------------------------------------------- J12 ----
def affected_scope(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed files plus their importers that are not themselves changed.

    ``changes``: (project_id, path).  Returns (project_id, path, reason) with
    reason 'changed' or 'importer'.
    """
    ch = changes.select("project_id", "path").distinct()
    importers = (edges.join(ch.withColumnRenamed("path", "dst"), ["project_id", "dst"], "left_semi")
                 .select("project_id", F.col("src").alias("path")).distinct()
                 .join(ch, ["project_id", "path"], "left_anti"))
    return (ch.withColumn("reason", F.lit("changed"))
            .unionByName(importers.withColumn("reason", F.lit("importer"))))


# ---------------------------------------------------------------- J13 ----
def dot_variants(files: DataFrame) -> DataFrame:
    """Reference names a Python-style file can be reached by.

    ``a/b.py`` is referenced by ``a.b`` (dotted module path) or ``.b``
    (relative module).  Returns (project_id, path, variant).
    """
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    dotted = F.regexp_replace(stem, "/", ".")
    rel = F.concat(F.lit("."), F.regexp_replace(basename(F.col("path")), r"\.[^.]+$", ""))
    return (files.select("project_id", "path",
                         F.explode(F.array_distinct(F.array(dotted, rel))).alias("variant")))


def parent_of(col) -> "F.Column":
    return parent_dir(col)


def with_window_rank(df: DataFrame, part, order, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
