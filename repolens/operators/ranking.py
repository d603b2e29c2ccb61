"""Places of rows within groups of any size.

A window over a whole group puts a hot group into one task.  Here rows are
range-partitioned by group and order, so a large group spreads over many
partitions; places are counted inside the partitions, and only one row per
group and partition meets in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.session import materialize


def _sorted_parts(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` range-partitioned and sorted by group and order, written once,
    with ``_part`` and, ascending within it, ``_row``."""
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    return materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))


def _with_heads(rows: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to one row per group and partition; null keys are equal."""
    heads = heads.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_part": "_p"})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col("_part") == F.col("_p"))
    return rows.join(heads, same)


def _before(column: str, keys: list[str]) -> Column:
    """Sum of ``column`` over a group's earlier partitions."""
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], pos: str = "pos",
             total: str | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group, and the size
    of the group if ``total`` names a column for it.

    ``order`` should be total; rows equal in it share a partition and get
    consecutive places in no fixed order.  Null keys are a group.  The sorted
    rows are written once, so places hold if a task is run again.
    """
    rows = _sorted_parts(df, keys, order)
    heads = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    heads = heads.select(*keys, "_part", "_first", _before("_n", keys).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    out = _with_heads(rows, heads, keys).withColumn(pos, F.col("_before") + F.col("_row") - F.col("_first") + 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, pos, *([total] if total else []))


def running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of the integer ``value`` (null: 0) over the rows of
    its group up to each row, in ``order`` (total; ties in no fixed order)."""
    rows = _sorted_parts(df, keys, order)
    heads = rows.groupBy(*keys, "_part").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_n"))
    heads = heads.select(*keys, "_part", _before("_n", keys).alias("_before"))
    w = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_inside", F.sum(F.coalesce(value, F.lit(0))).over(w))
    return _with_heads(rows, heads, keys).withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint")).select(*df.columns, out)
