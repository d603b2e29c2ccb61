"""Import cycles as strongly connected components.

Distributed forward-backward colouring, run for all projects at once:

1. trim: repeatedly drop nodes without an incoming or outgoing edge (they
   cannot lie on a cycle);
2. colour: every node takes the smallest node that can reach it (min-label
   propagation along edges until nothing changes);
3. a colour's root (the node whose colour is its own) collects, by backward
   steps over same-colour edges, every node that reaches it: that set is the
   root's SCC;
4. remove the found SCCs and cross-colour edges, repeat on what is left.

The loop runs on edges of two numbers (a 64-bit hash of project and path,
checked to name one node each): names are shuffled once and met again by the
found members alone, where the smallest path names the component.  A round
pushes only what changed in the round before; only row counts come back to
the driver.  Each round is written once under ``spark.checkpoint.dir``, so that
its size is known and small frontiers are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.session import ensure_checkpoint_dir, materialize

TRIM_ROUNDS = 50
HASH_TRIES = 8


def _hashed(edges: DataFrame, hash_of=F.xxhash64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges ``s, d``, names ``v, project_id, path``, loops ``project_id, v``):
    all edges between two nodes, their ends, and the nodes with a
    self-reference; another salt is taken if two names meet in one number."""
    for salt in range(HASH_TRIES):
        v = lambda c: hash_of(F.lit(salt), F.col("project_id"), F.col(c))
        written = materialize(edges.select("project_id", "src", "dst", v("src").alias("s"), v("dst").alias("d"))
                              .where(F.col("src").isNotNull() & F.col("dst").isNotNull()))
        e = written.where(F.col("project_id").isNotNull() & (F.col("src") != F.col("dst")))
        names = materialize(e.select(F.col("s").alias("v"), "project_id", F.col("src").alias("path"))
                            .union(e.select("d", "project_id", "dst")).distinct())
        if names.groupBy("v").count().where("count > 1").limit(1).count() == 0:
            loops = written.where(F.col("src") == F.col("dst")).select("project_id", F.col("src").alias("v")).distinct()
            return e.select("s", "d"), names, loops
    raise RuntimeError(f"two names share a number under each of {HASH_TRIES} salts")


def _ends(e: DataFrame) -> DataFrame:
    """(v, i, o): edges into and out of each node."""
    ends = (e.select(F.col("s").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o"))
            .union(e.select("d", F.lit(1), F.lit(0))))
    return ends.groupBy("v").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))


def _trim(e: DataFrame, max_rounds: int = TRIM_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes ``v``) without nodes that have no in- or no out-edge, to a
    fixpoint (at most ``max_rounds``; the colouring is exact on whatever is
    left).  Counts of edges are kept per node and lowered by the edges that go.

    Trimming to the fixpoint measured faster than stopping after two rounds:
    every node left behind costs extra colouring rounds."""
    ends = materialize(_ends(e))
    for _ in range(max_rounds):
        dead = materialize(ends.where("i = 0 OR o = 0").select("v"))
        if dead.count() == 0:
            break
        out_of, into = dead.withColumnRenamed("v", "s"), dead.withColumnRenamed("v", "d")
        gone = e.join(out_of, "s", "left_semi").union(e.join(out_of, "s", "left_anti").join(into, "d", "left_semi").select("s", "d"))
        fewer = _ends(gone).withColumnsRenamed({"i": "i2", "o": "o2"})
        ends = materialize(ends.join(dead, "v", "left_anti").join(fewer, "v", "left").select(
            "v", (F.col("i") - F.coalesce("i2", F.lit(0))).alias("i"), (F.col("o") - F.coalesce("o2", F.lit(0))).alias("o")))
        e = materialize(e.join(out_of, "s", "left_anti").join(into, "d", "left_anti").select("s", "d"))
    return e, ends.select("v")


def _forward_colour(e: DataFrame, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """(v, colour): smallest node among those that reach v."""
    colour = nodes.withColumn("colour", F.col("v"))
    pushed = e.groupBy(F.col("d").alias("v")).agg(F.min("s").alias("c2"))  # every node's own colour
    for _ in range(max_rounds):
        nxt = materialize(colour.join(pushed, "v", "left").select(
            "v", F.least("colour", F.coalesce("c2", "colour")).alias("colour"), (F.col("c2") < F.col("colour")).alias("changed")))
        colour = nxt.select("v", "colour")
        changed = materialize(nxt.where("changed").select(F.col("v").alias("s"), "colour"))
        if changed.count() == 0:
            return colour
        pushed = e.join(changed, "s").groupBy(F.col("d").alias("v")).agg(F.min("colour").alias("c2"))
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds of colours: raise max_rounds")


def _backward_from_roots(e: DataFrame, colour: DataFrame, max_rounds: int) -> DataFrame:
    """(v, colour) for every node that reaches its colour's root through edges
    whose two ends share that colour; each edge is met once."""
    last = reached = materialize(colour.where(F.col("v") == F.col("colour")))
    for _ in range(max_rounds):
        step = e.join(last.withColumnRenamed("v", "d"), "d").select(F.col("s").alias("v"), "colour").distinct()
        last = materialize(step.join(colour, ["v", "colour"], "left_semi").join(reached, ["v", "colour"], "left_anti"))
        if last.count() == 0:
            return reached
        reached = materialize(reached.unionByName(last))
    raise RuntimeError(f"no fixpoint after {max_rounds} backward rounds: raise max_rounds")


def scc_members(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(project_id, scc_id, path) for every node on an import cycle.

    One row per node of each strongly connected component with more than
    one node, or a single node with a self-reference.  ``scc_id`` is the
    smallest path of the component.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e, names, loops = _hashed(edges)
    e, nodes = _trim(e)
    found = None
    rounds = 0
    while nodes.count() > 0:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds: raise max_rounds")
        colour = _forward_colour(e, nodes, max_rounds)
        comp = _backward_from_roots(e, colour, max_rounds)
        found = comp if found is None else materialize(found.unionByName(comp))
        # keep only same-colour edges between nodes not yet assigned
        left = materialize(colour.join(comp.select("v"), "v", "left_anti"))
        e = materialize(e.join(left.select(F.col("v").alias("s"), "colour"), "s")
                        .join(left.select(F.col("v").alias("d"), "colour"), ["d", "colour"]).select("s", "d"))
        e, nodes = _trim(e)
    if found is None:
        found = edges.sparkSession.createDataFrame([], "v long, colour long")
    sizes = found.groupBy("colour").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    named = materialize(found.join(sizes.select("colour"), "colour", "left_semi").join(names, "v"))
    first = named.groupBy("colour").agg(F.min("path").alias("scc_id"))
    big = named.join(first, "colour").select("project_id", "scc_id", "path")
    # a node with a self-reference whose component is otherwise trivial
    self_only = (loops.join(big.select("project_id", F.col("path").alias("v")), ["project_id", "v"], "left_anti")
                 .select("project_id", F.col("v").alias("scc_id"), F.col("v").alias("path")))
    return big.unionByName(self_only)


def cycles(members: DataFrame) -> DataFrame:
    """(project_id, scc_id, size) per component."""
    return members.groupBy("project_id", "scc_id").agg(F.count(F.lit(1)).cast("bigint").alias("size"))
