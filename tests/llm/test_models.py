"""Operators 5 and 6: held-out accuracy, contracts, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import common as C
from repolens.llm import langid, quality, svm

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    C.prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_accuracy_on_held_out_rows(documents):
    out = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == documents.count()
    assert (out.held_out == [brute.held_out(d) for d in out.doc_id]).all()
    part = out[out.held_out]
    assert (part.lang == part.lang_pred).mean() >= 0.97
    assert out.score.between(0, 1).all() and set(out.lang_pred) <= {"en", "de", "fr", "es", "und"}


def test_quality_accuracy_on_held_out_rows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(documents, labels)
    assert out.count() == documents.count()
    got = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == (got.score >= 0.5)).all()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.predicted.mean() >= 0.95 and bad.predicted.mean() <= 0.4
    order = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert order >= 0.95


def test_held_out_labels_are_never_read(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(documents, labels), quality.train(documents, turned)
    assert (a["weights"] == b["weights"]).all() and (a["ratio"] == b["ratio"]).all()


def test_families():
    assert [langid.family(x) for x in ("en", "DE", "fr-CA", "pt_BR", "xx")] == ["germanic", "germanic", "romance", "romance", "other"]


def test_language_edges(frame, ragged, rows):
    out = langid.identify(frame(ragged)).collect()
    assert len(out) == len(ragged)
    texts = {}
    for d, t in ragged:
        texts.setdefault(d, []).append(t)
    for r in out:
        if not any(any(map(str.isalpha, t or "")) for t in texts[r.doc_id]):
            assert r.lang_pred == "und" and r.score == 0
        assert r.held_out == brute.held_out(r.doc_id)
    df = frame(rows)
    carried = langid.identify(df, carry=True).select("row.*")
    assert carried.columns == df.columns and carried.count() == len(rows)
    untaught = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert untaught.filter("lang_pred = 'und' and score = 0").count() == len(rows)
    one = langid.identify(df.withColumn("lang", F.lit("en"))).filter("lang_pred = 'en'")
    assert one.filter("score = 0.5").count() == sum(any(map(str.isalpha, t or "")) for _, t in rows)
    assert langid.identify(df.limit(0)).count() == 0


def test_quality_edges(spark, frame, rows, ragged):
    marks = [(d, i % 2, 0) for i, (d, _) in enumerate(rows[:20])] + [(rows[0][0], 1, 0), (rows[1][0], None, 0), (None, 1, 0), (-5, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for pairs in (rows, ragged):
        out = quality.classify(frame(pairs), labels).collect()
        assert len(out) == len(pairs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert quality.classify(frame([]).limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(frame(rows), labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.classify(frame(rows), labels.filter("quality = 1")).collect()} == {1.0}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [2, -1, 0.5, 0, 0] + 0.3 + rng.normal(size=200) * 0.3 > 0, 1.0, -1.0)
    at, val = [np.arange(5)] * 200, list(x)
    w, b = svm.dual_coordinate_descent(at, val, y, 5, cost=1.0, epochs=400)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(size=5) * 0.05, b + rng.normal() * 0.05) >= best - 0.05
    assert (np.sign(x @ w + b) == y).mean() > 0.9


def test_indicators_are_sets_per_document():
    texts = [b"aab aab", b"", b"x"]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    f, fb = quality.indicators(data, bounds)
    for i, t in enumerate(texts):
        one, ob = quality.indicators(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (f[fb[i]:fb[i + 1]] == one).all() and ob[-1] == len(set(one.tolist()))


def test_repeated_rows_stay_within_the_sample(spark, monkeypatch):
    fitted, fit = [], svm.dual_coordinate_descent
    monkeypatch.setattr(svm, "dual_coordinate_descent", lambda at, x, y, *a: fitted.append(y) or fit(at, x, y, *a))
    docs = [(d, f"text {d} of row {k} " + "abc xyz "[d % 2 * 4:][:4] * 9, ["en", "de"][d % 2]) for d in range(20) for k in range(15)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, float(d % 2)) for d in range(20)], "doc_id long, quality double")
    quality.train(table, labels, sample=2)
    langid.train(table, sample=2)
    assert [(sum(y > 0), sum(y < 0)) for y in fitted] == [(2, 2), (2, 2)]


def test_no_language_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    table = spark.createDataFrame([(d, f"text {d}", ["en", "de", "fr"][d % 3]) for d in range(30)], "doc_id long, text string, lang string")
    assert set(langid.train(table.filter("lang <> 'fr'"))["families"]) == {"germanic"}
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(table)
