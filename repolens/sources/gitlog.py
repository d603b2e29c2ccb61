"""Commit-log dumps (S02): ``git log --format='%H|%an|%aI|%s' --numstat``
text, one or more files per repository, to one row per (commit, file).

A dump made with a separator before each commit (``--format='%x1e%H|...'``) is
read commit by commit: Spark splits such a file at any size among many tasks.
A plain dump has no such mark; its files are read whole and cut at every line
that starts with a hex hash and a ``|``, so each file is one task.  Numstat
lines become rows; binary entries (``-``) and renames (paths with ``{``) are
skipped.  The subject may itself contain ``|``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII record separator, ``%x1e`` in a git format.
SEPARATOR = "\x1e"
#: Commits a written file holds at most.
COMMITS_PER_FILE = 200_000
HEADER = r"^([0-9a-f]{7,})\|([^|\n]*)\|([^|\n]*)\|([^\n]*)"
NUMSTAT = r"^(\d+)\t(\d+)\t(.+)$"


def parse_commit_log(text: DataFrame, project_col: str = "project_id") -> DataFrame:
    """``text``: (project_id, value) with one dump, or one commit, per row.
    Null and empty values and text before the first header give no rows."""
    blocks = text.select(project_col, F.explode(F.split("value", r"\n(?=[0-9a-f]{7,}\|)")).alias("b"))
    b = blocks.select(
        project_col,
        F.regexp_extract("b", HEADER, 1).alias("commit_id"),
        F.regexp_extract("b", HEADER, 2).alias("author"),
        F.regexp_extract("b", HEADER, 3).alias("date"),
        F.regexp_extract("b", HEADER, 4).alias("subject"),
        F.explode(F.slice(F.split("b", "\n"), 2, 1_000_000_000)).alias("line"))
    n = b.where(F.col("commit_id") != "").select(
        project_col, "commit_id", "author", "subject",
        F.to_timestamp("date").alias("ts"),
        F.regexp_extract("line", NUMSTAT, 1).alias("a"), F.regexp_extract("line", NUMSTAT, 2).alias("d"),
        F.regexp_extract("line", NUMSTAT, 3).alias("path"))
    return (n.where((F.col("path") != "") & ~F.col("path").contains("{"))
            .select(project_col, "commit_id", "author", "ts", "path",
                    F.col("a").cast("bigint").alias("additions"), F.col("d").cast("bigint").alias("deletions")))


def read_commit_log(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Read dumps laid out as ``<path>/project_id=<id>/...``.

    ``separator``: what stands before each commit; without it files are read
    whole.  Deeper folders (``month=...``) only prune what is read."""
    if separator is None:
        text = spark.read.text(path, wholetext=True)
    else:
        text = spark.read.text(path, lineSep=separator)
    return parse_commit_log(text)


def write_commit_log(changes: DataFrame, path: str, separator: str = SEPARATOR,
                     commits_per_file: int = COMMITS_PER_FILE) -> None:
    """Write change rows as log dumps, one folder per project and month of
    the commit (UTC), each commit after a ``separator``.

    Commits are rebalanced by project and month: Spark puts small months
    together and splits large ones, so a project with a third of the log is
    written by many tasks, and no file holds more than ``commits_per_file``.
    """
    per_commit = changes.groupBy("project_id", "commit_id").agg(
        F.first("author").alias("author"), F.min("ts").alias("ts"),
        F.array_join(F.sort_array(F.collect_list(F.format_string("%d\t%d\t%s", "additions", "deletions", "path"))),
                     "\n").alias("numstat"))
    block = F.concat_ws("\n", F.concat_ws("|", F.sha1(F.col("commit_id")), F.col("author"),
                                          F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"),
                                          F.concat(F.lit("order "), F.col("commit_id"), F.lit(" | synced"))),
                        F.lit(""), F.col("numstat"), F.lit(""))
    (per_commit.select("project_id", F.date_format("ts", "yyyy-MM").alias("month"), block.alias("value"))
     .hint("rebalance", "project_id", "month").write.mode("overwrite").option("lineSep", separator)
     .option("maxRecordsPerFile", commits_per_file).partitionBy("project_id", "month").text(path))
