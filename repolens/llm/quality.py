"""Operator 5: quality classifier, naive Bayes support vectors.

Features are the hashed byte 1-, 2- and 3-grams and the words that a text has
(indicators).  Each is scaled by its log-count ratio between good and bad
documents, counted over every labelled training document; a linear hinge-loss
model is then fitted by dual coordinate descent on a bounded sample of them
(``SAMPLE`` of each class, those with the least hash of the id).  Rows are
scaled to length one, so long texts do not outweigh short ones.

Training rows are those whose crc32 of the doc_id's text modulo 3 is not 1.

Defined results: a null or empty text has no features and gets the score of
the bias; a doc_id with several labels counts with their rounded mean, null
labels and labels without a document do not count; without labels of both
classes all scores are the share of label 1, or 0.5 without any; repeated rows
are each scored; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import svm

#: Sampled training documents of each class, at most.
SAMPLE = 4000
FEATURES = 1 << 17
SMOOTH = 1.0
COST = 1.0


def held_out():
    """Column: is this doc_id held out of training?"""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def indicators(data: np.ndarray, bounds: np.ndarray):
    """Distinct features of documents laid end to end: (features sorted by
    document, bounds of the documents in them)."""
    n, docs = len(data), len(bounds) - 1
    doc = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(bounds))
    stop = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # bytes from here to the document's end
    high, bits = np.uint64(FEATURES - 1), np.uint64(17)
    parts = []
    gram = np.zeros(n, np.uint64)
    for k in range(3):
        gram[:n - k] = (gram[:n - k] << np.uint64(8)) + data[k:]
        use = stop > k
        name = (gram[use] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD)
        parts.append((doc[use] << bits) | ((name >> np.uint64(40)) & high))
    word, _, _, of = C.words_flat(data, bounds)
    parts.append((of.astype(np.uint64) << bits) | ((word >> np.uint64(40)) & high))
    both = np.unique(np.concatenate(parts))
    return (both & high).astype(np.int64), np.searchsorted(both >> bits, np.arange(docs + 1))


def _featured(batches):
    """mapInArrow function: (doc_id, label, text) -> (doc_id, label, features)."""
    for batch in batches:
        for a, b, data, bounds in C.slabs(batch.column("text")):
            f, fb = indicators(data, bounds)
            out = [f[fb[i]:fb[i + 1]].astype("<u4").tobytes() for i in range(b - a)]
            yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("label")[a:b], pa.array(out, pa.binary())], names=["doc_id", "label", "features"])


def _counted(batches):
    """mapInArrow function: (label, features) -> (feature, good, bad), one
    row per feature seen in the task."""
    seen = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy()
        for k in (0, 1):
            rows = batch.column("features").filter(pa.array(label == k)).to_pylist()
            seen[k] += np.bincount(np.frombuffer(b"".join(rows), "<u4"), minlength=FEATURES)
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.record_batch([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], names=["feature", "good", "bad"])


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """(doc_id, label, features) of at most ``sample`` ids of each class, one
    row for each id, so that no more reach the driver.  The ids taken are
    broadcast, two times ``sample`` at most: left to the planner, the features
    of all rows were shuffled for that join before it saw how few ids meet them."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    taken = rows.select("doc_id", "label").distinct().withColumn("r", rank).filter(F.col("r") <= sample).select("doc_id")
    return rows.join(F.broadcast(taken), "doc_id", "left_semi").groupBy("doc_id", "label").agg(F.min("features").alias("features"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, from the labelled documents that are not held out."""
    scratch = C.Scratch(docs.sparkSession)
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).filter("q is not null and doc_id is not null")
             .groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label")).filter(~held_out()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(~held_out())
    # a sort-merge join at every size: labels may grow as the documents do, and the plan shall not change with them
    rows = scratch.put(texts.join(marks.hint("merge"), "doc_id").select("doc_id", "label", "text").mapInArrow(_featured, "doc_id long, label int, features binary"))
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return {"constant": float(size.get(1, 0)) / sum(size.values()) if size else 0.5}
    counts = (rows.select("label", "features").mapInArrow(_counted, "feature long, good long, bad long")
              .groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas())  # <= FEATURES rows
    good, bad = np.full(FEATURES, SMOOTH), np.full(FEATURES, SMOOTH)
    good[counts.feature] += counts.good
    bad[counts.feature] += counts.bad
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    chosen = sampled(rows, sample).toPandas().sort_values("doc_id", ignore_index=True)
    scratch.drop(rows)
    at = [np.frombuffer(x, "<u4").astype(np.int64) for x in chosen.features]
    y = np.where(chosen.label.to_numpy() == 1, 1.0, -1.0)
    x = [ratio[a] / max(1e-9, np.linalg.norm(ratio[a])) for a in at]
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, bias = svm.dual_coordinate_descent(at, x, y, FEATURES, COST * share)
    margin = np.array([w[a] @ v + bias for a, v in zip(at, x)])
    return {"weights": w.astype(np.float32), "ratio": ratio.astype(np.float32), "bias": bias, "scale": svm.sigmoid_scale(margin, y)}


def _scored(model: dict):
    def rows(batches):
        for batch in batches:
            for a, b, data, bounds in C.slabs(batch.column("text")):
                if "constant" in model:
                    score = np.full(b - a, model["constant"])
                else:
                    f, fb = indicators(data, bounds)
                    r = model["ratio"][f].astype(np.float64)
                    add = lambda v: np.diff(np.append(0, np.cumsum(v))[fb])  # noqa: E731, B023
                    margin = add(r * model["weights"][f]) / np.maximum(1e-9, np.sqrt(add(r * r))) + model["bias"]
                    scale, shift = model["scale"]
                    score = 1 / (1 + np.exp(-np.clip(scale * margin + shift, -30, 30)))
                yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                      names=["doc_id", "held_out", "score", "predicted"])

    return rows


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")
