"""Operator 11: Merkle dataset manifest by concatenated-level strings.

Each row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value.  Per source, leaves ascend by doc_id;
every ``RUN`` consecutive nodes become their parent until one is left, the
source's subroot; the subroots, ordered by source, likewise give the root.

Nodes are dealt into aligned blocks of ``RUN ** BLOCK_LEVELS``.  A block keeps
each of its levels as one hex string: fixed-width substrings of a level hash
to the next one, and what flanks a node in its run's substring is its sibling
segment.  The blocks' tops are the nodes of the next tier, so roots recurse:
n leaves need log(n) / log(81) tiers, each a table of 1/81 of the one before.
Only the largest leaf count of a source reaches the driver, to know how many.

Rows are numbered in their source by range partitions and running totals of
(partition, source), so a source that holds most rows is spread; texts are
hashed in the scan and never shuffled.

Defined results: null fields count as ``-`` (a null source is a source of its
own, the first); rows that agree in doc_id stand in the order of their leaves;
repeated rows are leaves of their own; an empty text is ``0:``; an empty table
has no rows, thus no root; columns other than ``FIELDS`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
#: Levels of a tree that one block holds, so 81 nodes and 8 KB of strings.
BLOCK_LEVELS = 4
BLOCK = RUN ** BLOCK_LEVELS
#: Characters of a digest.
DIGEST = 64


def leaf(**given: Column) -> Column:
    """The digest of a row's ``FIELDS``; ``given`` columns stand for theirs."""
    parts = []
    for name in FIELDS:
        value = given.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ordered_key(source: Column) -> Column:
    """A text that orders as the sources do, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, order: list[str], scratch: C.Scratch) -> DataFrame:
    """``rows`` (with ``key``) with ``pos``, their place among the rows of
    their key in ``order``, and ``total``, how many those are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = scratch.put(rows)
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = scratch.put(stored.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, "key", *by, "_tie")
                         .withColumn("_part", F.spark_partition_id()))
    scratch.drop(stored)
    of_key = Window.partitionBy("key")
    ahead = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (ranged.groupBy("_part", "key").agg(F.count("*").alias("_n"))
              .select("_part", "key", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(of_key).alias("total")))
    inside = F.row_number().over(Window.partitionBy("_part", "key").orderBy(*by, "_tie"))
    return (ranged.withColumn("_inside", inside).join(totals, ["_part", "key"])
            .withColumn("pos", F.col("_ahead") + F.col("_inside") - 1).drop("_part", "_tie", "_ahead", "_inside"))


def _parents(level: Column) -> Column:
    width = RUN * DIGEST
    last = ((F.length(level) - 1) / width).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "")


def _levels(first: Column, more: Column) -> Column:
    """The level strings of a block: up to ``BLOCK_LEVELS`` above the first
    where its key has ``more`` blocks, else until one node is left."""
    def grow(levels, _):
        top = F.element_at(levels, -1)
        return F.when(more | (F.length(top) > DIGEST), F.concat(levels, F.array(_parents(top)))).otherwise(levels)
    return F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), F.array(first), grow)


def _segments(levels: Column, at: Column) -> Column:
    """Per level of the block, what flanks the node above place ``at``."""
    def flanks(level, height):
        node = F.floor(at / F.pow(F.lit(RUN), height)).cast("int")
        run = node - node % RUN
        return F.struct(F.substring(level, run * DIGEST + 1, (node - run) * DIGEST).alias("left"),
                        F.substring(level, (node + 1) * DIGEST + 1, (run + RUN - 1 - node) * DIGEST).alias("right"))
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), flanks)


@dataclass
class Tree:
    """Tiers of blocks (key, block, total, entries, levels, top), leaves
    first; the last tier has one block per key, whose top is the key's root."""
    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        return self.tiers[-1].select("key", F.col("top").alias("digest"))

    def paths(self, above: DataFrame) -> DataFrame:
        """The entries of all keys of ``above`` (key, path, ...) with their
        path: the sibling segments up to the key's root, then the key's own."""
        above = above.withColumn("block", F.lit(0).cast("long"))
        for k, tier in reversed(list(enumerate(self.tiers))):
            inner = F.transform("entries", lambda e, i: F.struct(e.alias("entry"), _segments(F.col("levels"), i).alias("own")))
            met = tier.select("key", "block", "entries", "levels").join(above, ["key", "block"]).withColumn("_e", F.explode(inner))
            path = F.concat("_e.own", "path").alias("path")
            carried = [c for c in above.columns if c not in ("key", "block", "path")]
            if k == 0:
                return met.select("_e.entry.*", path, *carried)
            above = met.select("key", F.col("_e.entry.pos").alias("block"), path, *carried)
        raise ValueError("a tree has one tier at least")


def tree(nodes: DataFrame, carried: list[str], scratch: C.Scratch) -> Tree:
    """The tree of ``nodes`` (key, pos, total, digest); the first tier's
    entries keep the columns ``carried``."""
    tiers = []
    while True:
        one = F.struct("pos", "digest", *(carried if not tiers else []))
        blocks = (nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block"))
                  .agg(F.array_sort(F.collect_list(one)).alias("entries"), F.max("total").alias("total")))
        first = F.array_join(F.col("entries.digest"), "")
        made = scratch.put(blocks.withColumn("levels", _levels(first, F.col("total") > BLOCK)).withColumn("top", F.element_at("levels", -1)))
        tiers.append(made)
        if (made.agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return Tree(tiers)
        nodes = made.select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("digest"))


def manifest(rows: DataFrame, carried: list[str] = ()) -> DataFrame:
    """For ``rows`` (source, doc_id, leaf, and the columns ``carried``):
    (doc_id, leaf, *carried, path, subroot, root), where path is an array of
    (left, right): the hex digests beside the node of each level, leaf first."""
    scratch = C.Scratch(rows.sparkSession)
    kept = ["doc_id", *carried]
    leaves = rows.select(ordered_key(F.col("source")).alias("key"), F.col("leaf").alias("digest"), *kept)
    by_source = tree(numbered(leaves, ["doc_id", "digest"], scratch), kept, scratch)
    subroots = by_source.roots().select(F.lit("").alias("key"), F.col("key").alias("source_key"), "digest")
    over_all = tree(numbered(subroots, ["source_key"], scratch), ["source_key"], scratch)
    top = over_all.roots().select("key", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    sources = over_all.paths(top).select(F.col("source_key").alias("key"), "path", F.col("digest").alias("subroot"), "root")
    return by_source.paths(sources).select("doc_id", F.col("digest").alias("leaf"), *carried, "path", "subroot", "root")


def folded(digest: Column, path: Column) -> Column:
    """The root that ``digest`` gives along ``path``."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of a path as one hex text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def tampered(docs: DataFrame) -> Column:
    """The text without its line feeds where crc32 of the doc_id's decimal
    text is even, else as it is."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text").cast("string"))


def verify(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Build the manifest of ``docs`` and hold each row's proof against the
    row with the text ``changed`` (``tampered`` by default): (doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified)."""
    changed = tampered(docs) if changed is None else changed
    other = leaf(text=changed)
    rows = (docs.select(*FIELDS).withColumn("leaf", leaf()).withColumn("_other", other)
            .select("source", F.col("doc_id").cast("long").alias("doc_id"), "leaf", F.when(F.col("_other") != F.col("leaf"), F.col("_other")).alias("now")))
    out = manifest(rows, ["now"]).withColumn("folded_root", folded(F.coalesce("now", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
