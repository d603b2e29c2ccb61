"""Operator 13: toxicity by weak supervision.

Voters.  A term is a short word or the first bytes of a longer one, lower-cased
and hashed to ``BUCKETS``; having it several times is a term besides, and in a
long text it counts by its rate, as any word turns up there.  The terms that toxic training documents have far
more often than clean ones, counted over all of them, are dealt round into
``LEXICONS`` lexicon voters; two more voters ask for several terms at once, and
pattern voters look at shouting, exclamations, masked and stretched words.

Label model.  Documents are counted by their vote pattern (at most 2 ** VOTERS
of them, whatever the input), and expectation maximisation over the counts
estimates each voter's rate in either class and the voters' correlations
within a class; a voter that agrees with others beyond what the class explains
counts for less.  Labelled training rows are held at their label meanwhile.

Classifier.  Terms are counted over all training documents by the posterior of
their votes; a logistic model over the ``SELECTED`` terms that tell the classes
apart best is fitted to the posteriors of a bounded sample (``SAMPLE`` of each
side of one half, by the hash of the id).  Texts are scored whole.

Training rows are those whose crc32 of the doc_id's text modulo 4 is not 2;
other rows give neither labels, votes nor counts.

Defined results: a null or empty text has no terms and gets the score of the
bias; a doc_id with several labels counts with their rounded mean, null labels
and labels without a document do not count; without labels of both classes all
scores are the share of label 1, or 0.5 without any; repeated rows are each
scored; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 18
BUCKETS = 1 << BITS
#: Bytes of the longest whole word, and of the beginnings of longer ones.
WORD, BEGINNINGS = 12, (4, 5, 6, 7)
#: A term that a document has so often is a term of its own besides.
OFTEN = (2, 3)
#: In a document of more words than this, "once" is once in so many words.
SPAN = 1000
#: Terms in all lexicons, and lexicons.
LEXICON, LEXICONS = 480, 12
#: A lexicon term is so many times likelier in toxic documents, and its
#: log-likelihood ratio statistic against chance is so large.
LIKELIER, CERTAIN = 15.0, 16.0
SEVERAL = (3, 6)
PATTERNS = ("shouting", "exclaiming", "masked", "stretched")
VOTERS = LEXICONS + len(SEVERAL) + len(PATTERNS)
SELECTED = 4096
SAMPLE = 6000
#: Posteriors are counted in whole thousandths, so that sums do not hang on their order.
PARTS = 1000
THRESHOLD = 0.3

_KEPT = np.full(256, 0x20, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _KEPT[_a:_b] = np.arange(_a, _b)
_KEPT[65:91] = np.arange(97, 123)
#: For a bucket, the bucket of having its term so many times.
_AGAIN = {t: C.mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D + 2 * t)).astype(np.int64) & (BUCKETS - 1) for t in OFTEN}


def held_out():
    """Column: is this doc_id held out of training?"""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of each term of documents laid end to end, and the
    words of each document."""
    plain = _KEPT[data]
    name, start, end, doc = C.words_flat(plain, bounds)
    size = end - start
    whole = size <= WORD
    docs, buckets = [doc[whole]], [name[whole]]
    for k in BEGINNINGS:
        longer = size > k
        at = start[longer]
        gram = np.full(len(at), k, np.uint64)
        for i in range(k):
            gram = (gram << np.uint64(8)) | plain[at + i]
        docs.append(doc[longer])
        buckets.append(C.mix(gram * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(docs), (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(doc, minlength=len(bounds) - 1)


def distinct(doc: np.ndarray, bucket: np.ndarray, words: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, bucket) pairs of the terms that a document has
    at least once, and once in ``SPAN`` words of it, and those for terms that
    it has so many times as often; with ``wanted`` (by bucket), only those."""
    if wanted is not None:
        some = wanted.copy()
        for times in OFTEN:
            some |= wanted[_AGAIN[times]]
        use = some[bucket]
        doc, bucket = doc[use], bucket[use]
    both, n = np.unique((doc.astype(np.int64) << BITS) | bucket, return_counts=True)
    rate = n / np.maximum(1, words / SPAN)[both >> BITS]
    more = [both[rate >= 1]]
    for times in OFTEN:
        x = both[rate >= times]
        more.append(x >> BITS << BITS | _AGAIN[times][x & (BUCKETS - 1)])
    both = np.unique(np.concatenate(more))
    doc, bucket = both >> BITS, both & (BUCKETS - 1)
    return (doc, bucket) if wanted is None else (doc[wanted[bucket]], bucket[wanted[bucket]])


def patterns(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """One array of votes for each of ``PATTERNS``."""
    def count(flags):
        sums = np.append(0, np.cumsum(flags))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    upper = (data >= 65) & (data < 91)
    letter = upper | ((data >= 97) & (data < 123)) | (data >= 128)
    alone = np.zeros(len(data), bool)  # a sign between two letters
    alone[1:-1] = np.isin(data[1:-1], np.frombuffer(b"*#@$", np.uint8)) & letter[:-2] & (letter[2:] | ~letter[1:-1])[:len(data) - 2] if len(data) > 2 else False
    four = np.zeros(len(data), bool)
    if len(data) > 3:
        four[3:] = letter[3:] & (data[3:] == data[2:-1]) & (data[3:] == data[1:-2]) & (data[3:] == data[:-3]) & (data[3:] < 128)
    letters = count(letter)
    return [10 * count(upper) > 4 * np.maximum(letters, 20), count(data == 33) >= 3, count(alone) > 0, count(four) > 0]


def votes(data: np.ndarray, bounds: np.ndarray, voter: np.ndarray) -> np.ndarray:
    """The vote pattern of each document; ``voter`` has a lexicon's number,
    or -1, by bucket."""
    doc, bucket = distinct(*terms(data, bounds), voter >= 0)
    out = np.zeros(len(bounds) - 1, np.int64)
    np.bitwise_or.at(out, doc, np.int64(1) << voter[bucket].astype(np.int64))
    found = np.bincount(doc, minlength=len(out))
    for k, said in enumerate([*(found >= n for n in SEVERAL), *patterns(data, bounds)]):
        out |= said.astype(np.int64) << (LEXICONS + k)
    return out


def _each(batches, column: str = "text"):
    for batch in batches:
        for a, b, data, bounds in C.slabs(batch.column(column)):
            yield batch, a, b, data, bounds


def _by_label(batches):
    """mapInArrow function: (label, text) -> (bucket, toxic, clean), one row
    per bucket seen in the task."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch, a, b, data, bounds in _each(batches):
        doc, bucket = distinct(*terms(data, bounds))
        toxic = batch.column("label").to_numpy()[a:b][doc] == 1
        for k in (0, 1):
            seen[k] += np.bincount(bucket[toxic == k], minlength=BUCKETS)
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.record_batch([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], names=["bucket", "toxic", "clean"])


def _voted(voter: np.ndarray):
    def rows(batches):
        for batch, a, b, data, bounds in _each(batches):
            yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(votes(data, bounds, voter))], names=["doc_id", "bits"])

    return rows


def _by_posterior(voter: np.ndarray, posterior: np.ndarray):
    """mapInArrow function: text -> (bucket, toxic, n): thousandths of toxic
    documents, and documents, with the bucket."""
    def rows(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for _, _, _, data, bounds in _each(batches):
            part = np.rint(posterior[votes(data, bounds, voter)] * PARTS)
            doc, bucket = distinct(*terms(data, bounds))
            seen[0] += np.bincount(bucket, weights=part[doc], minlength=BUCKETS).astype(np.int64)
            seen[1] += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(seen[1])
        yield pa.record_batch([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "toxic", "n"])

    return rows


def _sampled(voter: np.ndarray, posterior: np.ndarray, chosen: np.ndarray, share: list[float]):
    """mapInArrow function: (doc_id, place, text) -> (doc_id, place, bits,
    features) of the rows whose place lies below their side's share."""
    def rows(batches):
        for batch, a, b, data, bounds in _each(batches):
            bits = votes(data, bounds, voter)
            place = batch.column("place").to_numpy()[a:b]
            taken = place < np.where(posterior[bits] >= 0.5, share[1], share[0])
            doc, bucket = distinct(*terms(data, bounds), chosen >= 0)
            edge = np.searchsorted(doc, np.arange(b - a + 1))
            feature = chosen[bucket].astype("<u2")
            out = [feature[edge[i]:edge[i + 1]].tobytes() for i in np.flatnonzero(taken)]
            keep = pa.array(taken)
            yield pa.record_batch([batch.column("doc_id")[a:b].filter(keep), pa.array(place).filter(keep), pa.array(bits).filter(keep), pa.array(out, pa.binary())], names=["doc_id", "place", "bits", "features"])

    return rows


def lexicon(toxic: np.ndarray, clean: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    """Each bucket's lexicon or -1, from its toxic and clean training
    documents and the ``total`` of both: the terms with the most weight, dealt
    round by weight so that the lexicons are of like strength."""
    ratio = (toxic + 0.5) / (total[0] + 1) / ((clean + 0.5) / (total[1] + 1))
    part = lambda seen, expected: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))
    a, b = total[0] / sum(total), total[1] / sum(total)
    without = [np.maximum(t - n, 0) for t, n in zip(total, (toxic, clean))]
    certain = 2 * (part(toxic, a * (toxic + clean)) + part(clean, b * (toxic + clean)) + part(without[0], a * sum(without)) + part(without[1], b * sum(without)))
    fit = (ratio >= LIKELIER) & (certain >= CERTAIN)
    weight = np.where(fit, toxic * np.log(ratio), 0)
    best = np.argsort(-weight, kind="stable")[:LEXICON]
    best = best[fit[best]]
    voter = np.full(BUCKETS, -1, np.int8)
    voter[best] = np.arange(len(best)) % LEXICONS
    return voter


class LabelModel:
    """Rates of the voters in toxic (``rate[1]``) and clean (``rate[0]``)
    documents, their ``correlation`` within a class, the ``weight`` that it
    leaves each, and the share of toxic documents (``prior``)."""

    def __init__(self, bits: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 12):
        said = ((bits[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        self.weight = np.ones(VOTERS)
        self._fit(said, count * (label == 1), count * (label == 0))
        for _ in range(rounds):
            r = np.where(label == 1, 1.0, np.where(label == 0, 0.0, self._posterior(said)))
            self._fit(said, count * r, count * (1 - r))

    def _fit(self, said, toxic, clean):
        self.prior = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
        self.rate, close = [], []
        for n in (clean, toxic):
            size = n.sum()
            p = (n @ said + 0.5) / (size + 1)
            both = (said.T * n) @ said / max(size, 1e-9)
            spread = np.sqrt(p * (1 - p))
            close.append((both - np.outer(p, p)) / np.outer(spread, spread))
            self.rate.append(p)
        self.correlation = np.clip((close[0] + close[1]) / 2, -1, 1)
        np.fill_diagonal(self.correlation, 1)
        self.weight = 1 / np.maximum(self.correlation, 0).sum(axis=1)

    def _posterior(self, said):
        no, yes = self.rate
        margin = np.log(self.prior / (1 - self.prior)) + said @ (self.weight * np.log(yes / no)) + (1 - said) @ (self.weight * np.log((1 - yes) / (1 - no)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def posterior(self) -> np.ndarray:
        """By vote pattern."""
        out = np.empty(1 << VOTERS, np.float32)
        for at in range(0, len(out), 1 << 14):
            bits = np.arange(at, min(len(out), at + (1 << 14)))
            out[bits] = self._posterior(((bits[:, None] >> np.arange(VOTERS)) & 1).astype(float))
        return out


def logistic(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, features: int, ridge: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that fit soft targets, by averaged-moment descent on
    the whole sample; row i has ones at ``rows[i]``."""
    at = np.concatenate([*rows, np.zeros(0, np.int64)])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x, weight = np.zeros(features + 1), weight / weight.sum()
    share = float(np.clip((weight * target).sum(), 1e-6, 1 - 1e-6))
    x[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        margin = np.bincount(of, weights=x[at], minlength=len(rows)) + x[-1]
        gap = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        slope = np.append(np.bincount(at, weights=gap[of], minlength=features) + ridge * x[:-1], gap.sum())
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        x -= 0.1 * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.99 ** k)) + 1e-10)
    return x[:-1], float(x[-1])


def _dense(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """The sums by bucket (at most ``BUCKETS`` rows) as arrays."""
    got = df.toPandas()
    out = []
    for c in columns:
        a = np.zeros(BUCKETS)
        a[got["bucket"].to_numpy()] = got[c]
        out.append(a)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model, from the documents that are not held out."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("t")).filter("t is not null and doc_id is not null")
             .groupBy("doc_id").agg((F.avg("t") >= 0.5).cast("int").alias("label")).filter(~held_out()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(~held_out())
    # sort-merge joins at every size: labels may grow as the documents do, and the plan shall not change with them
    known = texts.join(marks.hint("merge"), "doc_id")
    size = {r["label"]: r["n"] for r in texts.select("doc_id").join(marks.hint("merge"), "doc_id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return {"constant": float(size.get(1, 0)) / sum(size.values()) if size else 0.5}
    toxic, clean = _dense(known.select("label", "text").mapInArrow(_by_label, "bucket long, toxic long, clean long")
                          .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic", "clean")
    voter = lexicon(toxic, clean, (size[1], size[0]))

    said = texts.mapInArrow(_voted(voter), "doc_id long, bits long").join(marks.hint("merge"), "doc_id", "left")
    counted = said.groupBy("bits", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n")).toPandas()  # <= 3 * 2 ** VOTERS rows
    counted = counted.sort_values(["bits", "label"], ignore_index=True)
    model = LabelModel(counted.bits.to_numpy(), counted.n.to_numpy(float), counted.label.to_numpy())
    posterior = model.posterior()

    mass, n = _dense(texts.select("text").mapInArrow(_by_posterior(voter, posterior), "bucket long, toxic long, n long")
                     .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")), "toxic", "n")
    mass /= PARTS
    all_toxic = float((posterior[counted.bits] * counted.n).sum())
    ratio = np.log((mass + 0.5) / (all_toxic + 1)) - np.log((n - mass + 0.5) / (counted.n.sum() - all_toxic + 1))
    best = np.argsort(-np.where(ratio > 0, mass * ratio, (n - mass) * -ratio * 0.01), kind="stable")[:SELECTED]
    chosen = np.full(BUCKETS, -1, np.int32)
    chosen[best] = np.arange(len(best))

    above = posterior[counted.bits] >= 0.5
    side = [float(counted.n[~above].sum()), float(counted.n[above].sum())]
    share = [min(1.0, sample / max(s, 1.0)) for s in side]
    placed = texts.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).filter(F.col("place") < max(share))
    # one row for each id, and a bound that holds whatever the hashes are
    taken = (placed.mapInArrow(_sampled(voter, posterior, chosen, share), "doc_id long, place double, bits long, features binary")
             .groupBy("doc_id", "place").agg(F.min(F.struct("features", "bits")).alias("r")).orderBy("place", "doc_id").limit(4 * sample).select("r.*").toPandas())
    if not len(taken):
        return {"constant": float(model.prior)}
    target = posterior[taken.bits.to_numpy()].astype(float)
    rows = [np.frombuffer(x, "<u2").astype(np.int64) for x in taken.features]
    weight = np.where(target >= 0.5, 1 / share[1], 1 / share[0])
    w, bias = logistic(rows, target, weight, SELECTED)
    weights = np.zeros(BUCKETS, np.float32)
    weights[best] = w[:len(best)]
    return {"weights": weights, "bias": bias, "labels": model, "voter": voter}


def _scored(model: dict):
    """mapInArrow function over (doc_id, held_out, text)."""
    fixed, weights, bias = model.get("constant"), model.get("weights"), model.get("bias")

    def rows(batches):
        for batch, a, b, data, bounds in _each(batches):
            if fixed is not None:
                score = np.full(b - a, fixed)
            else:
                doc, bucket = distinct(*terms(data, bounds), weights != 0)
                margin = np.bincount(doc, weights=weights[bucket], minlength=b - a) + bias
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    return rows


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")
