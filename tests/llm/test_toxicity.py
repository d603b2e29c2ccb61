"""Operator 13: held-out accuracy, the label model, contracts, edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repolens.llm import common as C
from repolens.llm import toxicity

SF = "/root/testdata/sf0.1"


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    C.prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_accuracy_on_held_out_rows(tables):
    docs, labels = tables
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels, "doc_id").toPandas()
    assert (got.held_out == [held_out(d) for d in got.doc_id]).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    part = got[got.held_out]
    toxic, clean = part[part.toxic == 1], part[part.toxic == 0]
    assert toxic.predicted.mean() >= 0.88 and clean.predicted.mean() <= 0.01
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean() >= 0.96


def test_held_out_rows_are_never_learned_from(spark, tables):
    docs, labels = (t.filter("doc_id % 5 = 0") for t in tables)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("text", F.when(toxicity.held_out(), F.lit("idiot loser moron")).otherwise(F.col("text")))
    a, b = toxicity.train(docs, labels), toxicity.train(other, turned)
    assert (a["weights"] == b["weights"]).all() and a["bias"] == b["bias"]


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(4)
    n, y = 40_000, rng.random(40_000) < 0.15
    yes, no = rng.uniform(0.4, 0.9, toxicity.VOTERS), rng.uniform(0.01, 0.2, toxicity.VOTERS)
    said = rng.random((n, toxicity.VOTERS)) < np.where(y[:, None], yes, no)
    said[:, 1] = np.where(rng.random(n) < 0.9, said[:, 0], said[:, 1])  # two voters that go together
    bits, count = np.unique(said @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    known = rng.random(n) < 0.02
    label = np.full(len(bits), -1)
    rows = [(b, int(v)) for b, v in zip(said[known] @ (1 << np.arange(toxicity.VOTERS)), y[known])]
    extra = np.array(rows)
    model = toxicity.LabelModel(np.append(bits, extra[:, 0]), np.append(count, np.ones(len(extra))).astype(float), np.append(label, extra[:, 1]))
    alone = np.arange(2, toxicity.VOTERS)
    assert abs(model.prior - 0.15) < 0.02
    assert np.abs(model.rate[1] - yes)[alone].max() < 0.05 and np.abs(model.rate[0] - no)[alone].max() < 0.03
    off = model.correlation - np.eye(toxicity.VOTERS)
    assert off[0, 1] > 0.5 and np.abs(off[2:, 2:]).max() < 0.15
    assert model.weight[:2].max() < 0.75 < model.weight[2:].min()
    guess = model.posterior()[said @ (1 << np.arange(toxicity.VOTERS))] >= 0.5
    assert (guess == y).mean() > 0.97


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def test_a_document_is_seen_alone():
    texts = ["", "Aa bb aa; AA", "x", "ünïcödé " * 30, "", "aa", "long words beginning alike beginnings"]
    everything = toxicity.distinct(*toxicity.terms(*flat(texts)))
    for i, t in enumerate(texts):
        _, one = toxicity.distinct(*toxicity.terms(*flat([t])))
        assert everything[1][everything[0] == i].tolist() == one.tolist()
    _, some = toxicity.distinct(*toxicity.terms(*flat([texts[1]])))
    assert len(some) == 2 + len(toxicity.OFTEN)  # aa, bb, aa twice and thrice
    wanted = np.zeros(toxicity.BUCKETS, bool)
    wanted[some[::2]] = True
    assert toxicity.distinct(*toxicity.terms(*flat([texts[1]])), wanted)[1].tolist() == [b for b in some if wanted[b]]


def test_once_in_a_long_text_is_not_enough():
    filler = " ".join(f"w{i}" for i in range(4 * toxicity.SPAN))
    lone = toxicity.terms(*flat(["loser"]))[1]
    has = lambda t: np.isin(lone, toxicity.distinct(*toxicity.terms(*flat([t])))[1]).all()
    assert has("you loser") and not has("loser " + filler) and has("loser " * 5 + filler)


def test_patterns():
    said = toxicity.patterns(*flat(["SHOUTING AT YOU FOR NOTHING", "no! no! no!", "what a f**l", "sooooo", "calm words, 4 of them!", "", "a*b"]))
    assert [x.tolist() for x in said] == [[i == k for i in range(7)] for k in range(2)] + [[False, False, True, False, False, False, True], [i == 3 for i in range(7)]]


def test_edges(spark, frame, rows, ragged):
    marks = [(d, 0, i % 2) for i, (d, _) in enumerate(rows[:20])] + [(rows[0][0], 0, 1), (rows[1][0], 0, None), (None, 1, 1), (-5, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for pairs in (rows, ragged):
        out = toxicity.classify(frame(pairs), labels).collect()
        assert len(out) == len(pairs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in out)
    assert toxicity.classify(frame([]).limit(0), labels).count() == 0
    assert {r.score for r in toxicity.classify(frame(rows), labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in toxicity.classify(frame(rows), labels.filter("toxic = 1")).collect()} == {1.0}


def test_repeated_rows_stay_within_the_sample(spark, monkeypatch):
    fitted, fit = [], toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda at, *a: fitted.append(len(at)) or fit(at, *a))
    docs = [(d, f"text {d} " + ("loser idiot " if d % 3 == 0 else "calm words ") * 3) for d in range(300) for _ in range(5)] + [(3, "loser idiot")] * 2000
    labels = spark.createDataFrame([(d, float(d % 3 == 0)) for d in range(300)], "doc_id long, toxic double")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, sample=20)
    assert 1 <= fitted[0] <= 80 and "weights" in model


def test_very_large_tables_give_small_results():
    """What reaches the driver is bounded by buckets, patterns and the sample."""
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a b c " * 100_000, "d"])], names=["doc_id", "text"])
    out = list(toxicity._voted(np.full(toxicity.BUCKETS, -1, np.int8))([batch]))
    assert sum(len(b) for b in out) == 2 and max(b.column("bits").to_pylist()[0] for b in out) < 1 << toxicity.VOTERS
