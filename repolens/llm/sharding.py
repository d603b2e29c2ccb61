"""Operator 8: sharding by fixed virtual slots.

A record hashes, by its doc_id alone, into one of ``SLOTS`` virtual slots; that
never changes.  A versioned map says which shard holds each slot.  Rebalancing
adds up bytes per slot and edits the map: single slots move, or two change
places, until the shards' sizes are near equal (law ``bytes``).  Only the
slot totals (``SLOTS`` rows by construction) and the map reach the driver.

A record's place in its shard is gapless from 0: the records of the shard's
earlier slots, then its rank by (doc_id, crc) in its slot.

Defined results: a null text has no bytes (size 8) and the crc of nothing; a
null doc_id hashes like any value; repeated rows are each placed; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS = 24
SLOTS = 4096
#: Bytes of a record besides its text.
RECORD_BYTES = 8
#: Rebalancing stops when the largest and smallest shard differ by so much of the mean.
TOLERANCE = 0.0005


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)).cast("int").alias("virtual_slot"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """Version 0: slots dealt round."""
    return np.arange(slots, dtype=np.int32) % shards


def rebalanced(shard_of: np.ndarray, sizes: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """The map edited so that the shards' total sizes are near equal: the
    largest shard gives a slot to the smallest, or changes one for a smaller
    one, whichever brings the two closest; ends when that gains nothing."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=sizes, minlength=shards)
    for _ in range(64 * len(sizes)):
        rich, poor = int(load.argmax()), int(load.argmin())
        gap = load[rich] - load[poor]
        if gap <= tolerance * load.mean():
            break
        give = np.flatnonzero(shard_of == rich)
        take = np.flatnonzero(shard_of == poor)
        # index -1 of ``take`` stands for taking nothing back
        back = np.append(sizes[take], 0)
        order = np.argsort(back, kind="stable")
        want = sizes[give] - gap / 2
        near = np.clip(np.searchsorted(back[order], want), 1, max(1, len(back) - 1))
        best = None
        for at in (np.minimum(near, len(back) - 1), near - 1):
            moved = sizes[give] - back[order][at]
            off = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
            i = int(off.argmin())
            if best is None or off[i] < best[0]:
                best = off[i], give[i], order[at[i]], moved[i]
        if not np.isfinite(best[0]):
            break
        _, slot, other, moved = best
        shard_of[slot] = poor
        if other < len(take):
            shard_of[take[other]] = rich
        load[rich] -= moved
        load[poor] += moved
    return shard_of


def grown(shard_of: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """The map with one more shard: slots move only into it, from the largest
    shard each time, until it holds the mean."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=sizes, minlength=shards + 1)
    while load[shards] < load.sum() / (shards + 1):
        rich = int(load[:shards].argmax())
        own = np.flatnonzero(shard_of == rich)
        room = load.sum() / (shards + 1) - load[shards]
        fits = own[sizes[own] <= max(room, sizes[own].min())]
        slot = fits[sizes[fits].argmax()]
        if sizes[slot] <= 0:
            break
        shard_of[slot] = shards
        load[rich] -= sizes[slot]
        load[shards] += sizes[slot]
    return shard_of


def store_map(spark: SparkSession, shard_of: np.ndarray, version: int, path: str) -> None:
    """Add one version to the map's table at ``path``."""
    rows = [(version, int(s), int(x)) for s, x in enumerate(shard_of)]
    spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of a version, the newest by default."""
    table = spark.read.schema("version int, slot int, shard int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), "shard")


def shard(docs: DataFrame, path: str, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Place all rows of ``docs``; versions 0 (dealt round) and 1 (balanced)
    of the map are stored at ``path``.  Returns (doc_id, size, text_crc32,
    law, shard, slot, grown_shard, virtual_slot, map_version)."""
    spark = docs.sparkSession
    rows = C.Scratch(spark).put(records(docs, slots))
    totals = rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()  # <= SLOTS rows
    size, count = np.zeros(slots), np.zeros(slots, np.int64)
    for r in totals:
        size[r.virtual_slot], count[r.virtual_slot] = r.bytes, r.rows
    before = first_map(slots, shards)
    after = rebalanced(before, size, shards)
    store_map(spark, before, 0, path)
    store_map(spark, after, 1, path)
    ahead = np.zeros(slots, np.int64)
    for s in range(shards):
        own = np.flatnonzero(after == s)
        ahead[own] = np.cumsum(count[own]) - count[own]
    offsets = spark.createDataFrame([(i, int(a)) for i, a in enumerate(ahead)], "virtual_slot int, ahead long")
    placed = load_map(spark, path, 1).join(offsets, "virtual_slot")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("_rank", rank).join(F.broadcast(placed), "virtual_slot")  # SLOTS rows by construction
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("_rank") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version")))
