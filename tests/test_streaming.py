"""Streams driven by a parquet file source with availableNow; each must agree
with its batch twin."""

import os

from pyspark.sql import functions as F

from repolens import adapters
from repolens.streaming import jobs as J

from conftest import SF_SMALL


def _write_chunks(df, path, col="ts"):
    """Write ``df`` as several files (one per day) so the stream sees several batches."""
    df.withColumn("_d", F.dayofmonth(col)).repartition("_d").write.mode("overwrite").partitionBy("_d").parquet(path)


def _stream(spark, path, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 3)
            .option("recursiveFileLookup", "true").parquet(path))


def _run(q):
    q.awaitTermination(300)
    assert q.exception() is None


def test_degradation_stream_matches_batch(spark, scratch):
    a = adapters.analyses(spark, SF_SMALL)
    src = os.path.join(scratch, "analyses")
    _write_chunks(a, src)
    s = _stream(spark, src, a.schema)
    q = (J.degradation_stream(s).writeStream.format("memory").queryName("degr_out")
         .option("checkpointLocation", os.path.join(scratch, "ck1")).outputMode("append")
         .trigger(availableNow=True).start())
    _run(q)
    got = sorted((r.project_id, str(r.ts), round(r.delta, 6)) for r in spark.sql("SELECT * FROM degr_out").collect())
    want = sorted((r.project_id, str(r.ts), round(r.delta, 6)) for r in J.degradation_batch(a).collect())
    assert got == want and len(want) > 0


def test_constraints_stream_first_per_rule(spark, scratch):
    v = adapters.violations(spark, SF_SMALL)
    src = os.path.join(scratch, "viol")
    _write_chunks(v, src)
    q = (J.constraints_stream(_stream(spark, src, v.schema)).writeStream.format("memory").queryName("cons_out")
         .option("checkpointLocation", os.path.join(scratch, "ck2")).outputMode("complete")
         .trigger(availableNow=True).start())
    _run(q)
    whole = lambda r: (r.project_id, r.rule_type, str(r.created_at), r.level, r.message)
    assert sorted(map(whole, spark.sql("SELECT * FROM cons_out").collect())) == sorted(map(whole, J.constraints_batch(v).collect()))


def test_weekly_window_stream_matches_batch(spark, scratch):
    c = adapters.commits(spark, SF_SMALL)
    src = os.path.join(scratch, "commits")
    c.withColumn("_y", F.year("ts")).write.partitionBy("_y").parquet(src)
    q = (J.timeline_windows(_stream(spark, src, c.schema), delay="3650 days").writeStream.format("memory")
         .queryName("weeks_out").outputMode("update")
         .option("checkpointLocation", os.path.join(scratch, "ck3")).trigger(availableNow=True).start())
    _run(q)
    got = spark.sql("SELECT project_id, week, max(commits) AS commits FROM weeks_out GROUP BY 1, 2")
    want = J.timeline_windows(c, delay=None).select("project_id", "week", "commits")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_check_stream_is_idempotent_per_batch(spark, scratch):
    from repolens.plans.rules_q import RULES
    from repolens.sources.store import rules_df
    a = adapters.analyses(spark, SF_SMALL)
    ap = adapters.anti_patterns(spark, SF_SMALL)
    rules = rules_df(spark, {"quality_gates": RULES["quality_gates"]})
    src = os.path.join(scratch, "snaps")
    _write_chunks(a, src)
    out = os.path.join(scratch, "checks")
    q = J.start_check_stream(_stream(spark, src, a.schema), ap, rules, out, os.path.join(scratch, "ck4"))
    _run(q)
    got = spark.read.parquet(out).drop("batch_id")
    want = J.check_snapshots(a, ap, rules)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_event_log_stream(spark, scratch):
    raw = adapters.raw_events(spark, SF_SMALL)
    src = os.path.join(scratch, "raw")
    _write_chunks(raw, src)
    q = (J.event_log(_stream(spark, src, raw.schema)).writeStream.format("memory").queryName("ev_out")
         .option("checkpointLocation", os.path.join(scratch, "ck5")).trigger(availableNow=True).start())
    _run(q)
    assert spark.sql("SELECT * FROM ev_out").count() == J.event_log(raw).count()
