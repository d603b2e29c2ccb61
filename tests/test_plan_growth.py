"""Names are looked for only where one can stand; checks of a step share
one shuffle."""

import random

from pyspark.sql import functions as F

from repolens.operators import plan_checks as PC
from repolens.operators import substrings as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_pieces_of_a_text_meet_names(spark, monkeypatch):
    names = spark.createDataFrame([(f"p{n}.ts",) for n in (1, 23, 456, 78901)], "name string")
    keyed = names.withColumn("_key", F.col("name")).withColumn("_size", F.length("name"))
    text = spark.createDataFrame([("Update imports after p456.ts moved",)], "text string")
    cut = [text.select(F.explode(F.regexp_extract_all("text", F.lit(p), 1)).alias("k")).count() for p in S.shapes(keyed).values()]
    assert sum(cut) <= len(cut)  # every place of every length before
    assert [r.name for r in S.containing(text, names).collect()] == ["p456.ts"]


def test_names_of_any_shape(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_SEPARATORS", 3)
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ab1_.-/é\n]^\\😀") for _ in range(n))
    texts, names = {draw(rng.randint(0, 30)) for _ in range(60)}, {draw(rng.randint(1, 6)) for _ in range(150)}
    t, n = (spark.createDataFrame([(x,) for x in sorted(v)], f"{c} string") for v, c in ((texts, "text"), (names, "name")))
    for gram in (3, 12):
        assert {tuple(r) for r in S.containing(t, n, gram=gram).select("text", "name").collect()} == {(x, y) for x in texts for y in names if y in x}


def test_split_checks_share_one_shuffle(spark):
    ops = spark.range(100).select(F.lit("p").alias("project_id"), F.col("id").alias("step_id"), F.lit("CREATE").alias("type"), F.lit("a/b").alias("path"), F.lit("x").alias("description"))
    steps = spark.range(100).select(F.lit("p").alias("project_id"), F.col("id").alias("step_id"), F.lit("hub-splitter").alias("rule"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = PC.split_issues(steps, ops)
        assert _plan(out).count("Exchange hashpartitioning") <= 4  # operations and hubs, for each of two issues
        assert {(r.kind, r.step_id) for r in out.collect()} == {(k, s) for k in ("no_consumer_change", "hub_not_changed") for s in range(100)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
