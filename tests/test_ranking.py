"""Places within groups and block-wise smoothing, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from repolens.operators.forecast import ema
from repolens.operators.ranking import numbered, running_sum


def test_numbered_spreads_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), rnd.randrange(10**6), k) for k in range(5000)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    got = numbered(df, ["g"], [F.desc("v"), "k"], total="n").collect()
    groups = {}
    for g, v, k in rows:
        groups.setdefault(g, []).append((-v, k))
    want = {k: (i + 1, len(g)) for g in groups.values() for i, (_, k) in enumerate(sorted(g))}
    assert {r.k: (r.pos, r.n) for r in got} == want


def test_running_sum_spreads_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), k, rnd.choice([None, 1, 5, -2])) for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint").repartition(7)
    sums, want = {}, {}
    for g, k, v in rows:
        want[k] = sums[g] = sums.get(g, 0) + (v or 0)
    assert {r.k: r.s for r in running_sum(df, ["g"], ["k"], "v", "s").collect()} == want


def test_numbered_on_an_empty_table(spark):
    got = numbered(spark.createDataFrame([], "g string, v int"), ["g"], ["v"])
    assert got.columns == ["g", "v", "pos"] and got.count() == 0


@pytest.mark.parametrize("alpha", [0.3, 0.9, 0.05, 1.0])
def test_ema_over_many_blocks(spark, alpha):
    rnd = random.Random(2)
    series = {"long": [rnd.uniform(0, 100) for _ in range(2500)], "one": [7.0], None: [1.0, 2.0, 4.0]}
    rows = [(key, i, v) for key, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows + [("long", 99999, None)], "key string, i int, v double").repartition(5)
    got = {(r.key, r.i): r.ema for r in ema(df, "key", "i", "v", alpha).collect()}
    assert len(got) == len(rows)
    for key, vs in series.items():
        e = vs[0]
        for i, v in enumerate(vs):
            e = v if i == 0 else alpha * v + (1 - alpha) * e
            assert got[key, i] == pytest.approx(e, rel=1e-14)
