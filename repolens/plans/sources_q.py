"""Sources: commit-log dumps written from the change table and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.session import ensure_checkpoint_dir
from repolens.sources import gitlog


def q_commit_log(spark, base):
    """Export the order-based change log as ``git log --numstat`` dumps under
    the session's checkpoint folder, by project and month, then parse the
    dumps back commit by commit."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/commit-log-{uuid.uuid4().hex}"
    gitlog.write_commit_log(adapters.file_changes(spark, base), folder)
    parsed = gitlog.read_commit_log(spark, folder, gitlog.SEPARATOR)
    return parsed.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {"s02_commit_log": q_commit_log}

SQL = {
    "s02_commit_log": O.with_views(O.FILE_CHANGES, """x AS (SELECT 1)
SELECT project_id, sha1(commit_id) AS commit_id, author, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, path,
       additions, deletions FROM changes"""),
}
