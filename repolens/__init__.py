"""repolens: Spark-native analytics over many source repositories at once.

Every operator takes and returns PySpark DataFrames keyed by ``project_id``.
Heavy work is expressed with DataFrame joins, aggregations and windows so
Catalyst / AQE choose the physical plan.
"""

from repolens.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
