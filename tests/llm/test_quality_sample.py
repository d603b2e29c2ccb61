"""Operator 5: the sample of the rows is taken without a shuffle of them all."""

from pyspark.sql import functions as F

from repolens.llm import quality


def test_features_outside_the_sample_stay(spark):
    rows = spark.range(60).select((F.col("id") % 50).alias("doc_id"), (F.col("id") % 50 % 2).cast("int").alias("label"), F.format_string("%03d", "id").cast("binary").alias("features"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quality.sampled(rows, 7)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.label for r in got) == [0] * 7 + [1] * 7 and len({r.doc_id for r in got}) == 14
    assert all(r.features == b"%03d" % r.doc_id for r in got)
