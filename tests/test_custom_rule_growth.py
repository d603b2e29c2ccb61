"""U02 over large tables: the graph is built once, and edges are shuffled
only where a rule needs them."""

import random

from pyspark.sql import functions as F

from repolens.operators import refactor as RF
from repolens.plans import hooks

SF_SMALL = "/root/testdata/sf0.001"

EDGES = "project_id string, src string, dst string, type string, weight double"


def edges(spark, seed=5):
    rng = random.Random(seed)
    dirs = ["src/a", "src/b", "lib/c", "lib/types", "x"]
    files = [f"{d}/{n}" for d in dirs for n in ("index.ts", "m.ts", "n.ts", "o.ts", "p.ts", "__init__.py")] + ["top.ts", "pkg.mod.part"]
    rows = [(rng.choice(["p", "q", None]), rng.choice(files), rng.choice([*files, files[1], files[1], None]), "import", 1.0) for _ in range(900)]
    return rows, spark.createDataFrame([*rows, *rows[:60]], EDGES)


def test_plan_reads_the_written_graph(spark):
    files = hooks.q_plan_with_rule(spark, SF_SMALL).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]


def test_hubs_count_edges_once(spark):
    """Against the definition, with null and repeated edges."""
    _, e = edges(spark)
    counts = {}
    for r in e.collect():
        if r.project_id is not None and r.dst is not None:
            parts = r.src.split("/") if "/" in r.src else r.src.split(".")
            counts.setdefault((r.project_id, r.dst), []).append(parts[-2] if len(parts) >= 2 else "core")
    barrels = RF.HUB_BARRELS["typescript"]
    want = {(p, d, len(set(g)), len(g)) for (p, d), g in counts.items()
            if len(g) >= 8 and len(set(g)) >= 2 and d.split("/")[-1] not in barrels and "types" not in d.lower()}
    out = RF.hub_splits(e)
    assert {(r.project_id, r.hub, r.groups, r.fan_in) for r in out.collect()} == want and len(want) > 10
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_barrels_few_or_many(spark, monkeypatch):
    """Same rows by broadcast and by shuffle, against the definition."""
    _, e = edges(spark, 8)
    all_edges = {(r.project_id, r.src, r.dst) for r in e.collect() if r.project_id is not None and r.dst is not None}
    rows = [(r.project_id, r.src, r.dst) for r in e.collect() if r.project_id is not None]
    name = lambda p: p.split("/")[-1]
    want = {}
    for p, b in {(p, s) for p, s, _ in rows if name(s) in RF.OPTIMIZER_BARRELS}:
        targets = {d for q, s, d in all_edges if (q, s) == (p, b)}
        users = {s for q, s, d in all_edges if q == p and d == b}
        n = sum(1 for q, s, _ in rows if (q, s) == (p, b))
        used = {u for u in users if {d for q, s, d in all_edges if (q, s) == (p, u)} & targets}
        if n >= 3:
            want[p, b] = (n, len(used))
    got = []
    for limit in (10_000, 0):
        monkeypatch.setattr(RF, "BROADCAST_EDGES", limit, raising=False)
        out = RF.barrel_candidates(e).where(F.col("project_id").isNotNull())
        got.append({(r.project_id, r.barrel): (r.outgoing, r.consumers) for r in out.collect()})
    assert got[0] == got[1] == {k: v for k, v in want.items() if k in got[0]} and len(got[0]) > 5
    assert all(v[1] == 0 for k, v in want.items() if k not in got[0])
