"""Session helpers.

On a cluster the session is built by the platform; we only read its
settings.  ``get_spark`` exists for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # parquet TIMESTAMP without zone is read as TIMESTAMP_NTZ; adapters cast.
}


def get_spark(app: str = "repolens", master: str | None = None,
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode runs everything in the driver JVM
            builder = builder.config("spark.driver.memory", os.environ.get("REPOLENS_DRIVER_MEMORY", "12g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it
    as is.  Only in local mode (tests) do we create a private scratch folder
    when nothing is configured; on a cluster that would be a folder of one
    machine, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="repolens-ckpt-",
                                      dir=os.environ.get("REPOLENS_SCRATCH"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def read_table(spark: SparkSession, base: str, name: str):
    """Read one parquet table ``<base>/<name>.parquet``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def materialize(df):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back, cutting its lineage.

    Used where one intermediate feeds several branches of a plan or an
    iteration.  A reliable RDD ``checkpoint()`` would compute the lineage
    twice (once for the action, once to save it); a written table is
    computed once, survives executor loss (shared storage, never a local
    checkpoint) and keeps column pruning and filter pushdown for readers.
    """
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/materialized/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, whose results
    were written; it does so once their plans are collected as garbage."""
    import gc
    gc.collect()
    spark._jvm.System.gc()
