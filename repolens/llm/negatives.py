"""Operator 12: hard-negative mining by angular triangle filtering.

Every vector is rounded to integers and stored with its norm and its angles to
``REFERENCES`` directions.  For an anchor a and a row x the triangle inequality
on the sphere holds the angle between them within [max |ta - tx|, min(ta + tx,
2 pi - ta - tx)] over the directions; its cosines times both norms, widened
beyond any rounding, bound the integer score.  A row is scored, exactly and in
integers, only if its bounds overlap a window that can still matter: the least
score that is sure to be among the anchor's best, or the scores from 30 to 90
hundredths of a positive's.

Anchors meet all rows in cells: anchors in blocks of ``ANCHORS``, rows in
blocks of ``ROWS``, both by the hash of a unique row number, so that a label,
an id or a vector that a third of the rows share makes no cell large.  Cells
are an equi-join on (anchor block, row block); only lists of a cell's best go
on, and windows with a limit rank them.  The directions are chosen farthest
first from at most ``SAMPLE`` rows (those of least hash); that choice changes
how much is scored, never the result.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part; repeated rows are rows of their own, each an anchor
where its id says so; a tie of score and id goes to any of the rows that agree
in both; shorter vectors count as filled up with zeros; an anchor without
another row of its label has no rows, nor has a positive with no row in its
window (always if its score is negative); an empty table gives an empty
result; other columns are ignored.  A score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

REFERENCES = 16
#: Rows from which the reference directions are chosen, at most.
SAMPLE = 2048
ANCHORS, ROWS = 8192, 2048
POSITIVES, NEGATIVES = 5, 10
SCALE = 256
#: A positive's window: from LOW to HIGH hundredths of its score.
LOW, HIGH = 30, 90
#: Radians and shares of the norms by which bounds are widened against rounding.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9

STORED = "uid long, id long, label long, anchor boolean, vector binary, norm double, angles binary"


def usable(rows: DataFrame, anchor_every: int = 100) -> DataFrame:
    """(uid, id, label, anchor, q) of the rows that take part: labels turned
    where 7 divides the id, components floor(256 x)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    turned = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return kept.select(F.monotonically_increasing_id().alias("uid"), "id", turned.alias("label"), (F.col("id") % anchor_every == 0).alias("anchor"),
                       F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("q"))


def matrix(vectors: list[bytes]) -> np.ndarray:
    """Rows of little-endian 64-bit integers, filled up with zeros."""
    size = {len(v) for v in vectors}
    if len(size) == 1:
        return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), -1)
    out = np.zeros((len(vectors), max(size, default=0) // 8), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return min(a.shape[-1], b.shape[-1])


def directions(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors, each the sampled one farthest from those before it."""
    taken = rows.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("q").toPandas()
    x = matrix([np.asarray(q, "<i8").tobytes() for q in taken["q"]]).astype(float)
    size = np.linalg.norm(x, axis=1)
    x = x[size > 0] / size[size > 0][:, None]
    chosen, nearest = [], np.full(len(x), -2.0)
    while len(x) and len(chosen) < count and (not chosen or nearest.min() < 1 - 1e-9):
        chosen.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ chosen[-1])
    return np.array(chosen) if chosen else np.zeros((0, 0))


def _stored(references: np.ndarray):
    """mapInArrow function: integers to bytes, with norm and angles."""
    def rows(batches):
        for batch in batches:
            vectors = [np.asarray(q, "<i8").tobytes() for q in batch.column("q").to_pylist()]
            if not vectors:
                continue
            x = matrix(vectors).astype(float)
            norm = np.linalg.norm(x, axis=1)
            k = _common(x, references)
            cosine = x[:, :k] @ references[:, :k].T / np.maximum(norm, 1e-300)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
            yield pa.record_batch([*(batch.column(c) for c in ("uid", "id", "label", "anchor")), pa.array(vectors, pa.binary()), pa.array(norm),
                                   pa.array([a.astype("<f8").tobytes() for a in angles], pa.binary())], names=["uid", "id", "label", "anchor", "vector", "norm", "angles"])

    return rows


class Side:
    """The rows of one side of a cell as arrays."""

    def __init__(self, table: pa.Table):
        self.uid, self.id, self.label, self.norm = (table.column(c).to_numpy() for c in ("uid", "id", "label", "norm"))
        self.vector = matrix(table.column("vector").to_pylist())
        self.angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), "<f8").reshape(len(self.uid), -1)
        self.most = int(np.abs(self.vector).max(initial=0))


def bounds(anchors: Side, a: int, rows: Side, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the score of anchor ``a`` with each row ``at`` can be."""
    x, y = rows.angles[at], anchors.angles[a]
    if x.shape[1]:
        near = np.abs(x - y).max(axis=1) - ANGLE_SLACK
        total = x + y
        far = np.minimum(total, 2 * np.pi - total).min(axis=1) + ANGLE_SLACK
    else:
        near, far = np.zeros(len(at)), np.full(len(at), np.pi)
    size = rows.norm[at] * anchors.norm[a]
    slack = size * SCORE_SLACK + 1
    return size * np.cos(np.clip(far, 0, np.pi)) - slack, size * np.cos(np.clip(near, 0, np.pi)) + slack


def scores(anchors: Side, a: int, rows: Side, at: np.ndarray) -> np.ndarray:
    """The exact integer inner products."""
    k = _common(anchors.vector, rows.vector)
    x, y = rows.vector[at, :k], anchors.vector[a, :k]
    reach = k * rows.most * anchors.most
    if reach < 1 << 53:
        return (x.astype(float) @ y.astype(float)).astype(np.int64)
    return x @ y if reach < 1 << 63 else (x.astype(object) @ y.astype(object))


def _best(score: np.ndarray, ident: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id."""
    if len(score) > 4 * k and score.dtype != object:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= cut)
        return keep[np.lexsort((uid[keep], ident[keep], -score[keep]))[:k]]
    order = sorted(range(len(score)), key=lambda i: (-score[i], ident[i], uid[i]))
    return np.array(order[:k], int)


def _least_of_best(low: np.ndarray, k: int) -> float:
    """The ``k``-th largest lower bound: what is below it is not among the best."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Cell function: each anchor's best rows of its own label."""
    out = {"anchor": [], "id": [], "score": [], "uid": []}
    if left.num_rows and right.num_rows:
        anchors, rows = Side(left), Side(right)
        for a in range(len(anchors.uid)):
            at = np.flatnonzero((rows.label == anchors.label[a]) & (rows.uid != anchors.uid[a]))
            low, high = bounds(anchors, a, rows, at)
            at = at[high >= _least_of_best(low, POSITIVES)]
            score = scores(anchors, a, rows, at)
            for i in _best(score, rows.id[at], rows.uid[at], POSITIVES):
                for name, v in (("anchor", anchors.uid[a]), ("id", rows.id[at[i]]), ("score", score[i]), ("uid", rows.uid[at[i]])):
                    out[name].append(int(v))
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def windows(positive: list[int]) -> list[tuple[int, int]]:
    """The least and most score of a negative, for each positive's score."""
    return [(-(-LOW * s // 100), HIGH * s // 100) for s in positive]


def _hardest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Cell function: for each anchor and positive the best rows of other
    labels within the window."""
    out = {"anchor": [], "place": [], "id": [], "score": [], "uid": []}
    if left.num_rows and right.num_rows:
        anchors, rows = Side(left), Side(right)
        for a, positive in enumerate(left.column("scores").to_pylist()):
            spans = windows(positive)
            at = np.flatnonzero(rows.label != anchors.label[a])
            low, high = bounds(anchors, a, rows, at)
            needed = np.zeros(len(at), bool)
            for lo, hi in set(spans):
                sure = low[(low >= lo) & (high <= hi)]
                needed |= (high >= max(lo, _least_of_best(sure, NEGATIVES))) & (low <= hi)
            at = at[needed]
            score = scores(anchors, a, rows, at)
            for place, (lo, hi) in enumerate(spans):
                inside = np.flatnonzero((score >= lo) & (score <= hi))
                for i in inside[_best(score[inside], rows.id[at[inside]], rows.uid[at[inside]], NEGATIVES)]:
                    for name, v in (("anchor", anchors.uid[a]), ("place", place), ("id", rows.id[at[i]]), ("score", score[i]), ("uid", rows.uid[at[i]])):
                        out[name].append(int(v))
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def mine(rows: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the rows (vec_id, embedding, label)."""
    scratch = C.Scratch(rows.sparkSession)
    whole = scratch.put(usable(rows))
    stored = scratch.put(whole.mapInArrow(_stored(directions(whole)), STORED))
    scratch.drop(whole)
    queries = stored.filter("anchor").select(*(F.col(c).alias(c) for c in stored.columns))
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_anchors, n_rows = blocks(queries, ANCHORS), blocks(stored, ROWS)
    of = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = stored.withColumn("row_block", of(n_rows)).withColumn("anchor_block", every(n_anchors)).groupBy("anchor_block", "row_block")
    asked = lambda df: df.withColumn("anchor_block", of(n_anchors)).withColumn("row_block", every(n_rows)).groupBy("anchor_block", "row_block")

    near = asked(queries).cogroup(dealt).applyInArrow(_nearest, "anchor long, id long, score long, uid long")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "uid"))
    positives = scratch.put(near.withColumn("place", first).filter(F.col("place") <= POSITIVES).select("anchor", F.col("place") - 1, F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
                            .toDF("anchor", "place", "positive_id", "positive_score"))
    asking = (positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
              .withColumnRenamed("anchor", "uid").join(queries, "uid"))
    hard = asked(asking).cogroup(dealt).applyInArrow(_hardest, "anchor long, place long, id long, score long, uid long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "uid"))
    best = hard.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(queries.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return best.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
