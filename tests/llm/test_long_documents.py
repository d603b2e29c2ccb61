"""Long documents in decontamination: what a row holds does not grow with the document."""

import random

import pytest
from pyspark.sql import functions as F

from repolens.llm import common as C
from repolens.llm import decontam

from . import brute

WORDS = [f"w{i}" for i in range(4000)]


def run(spark, frame, docs, bench):
    table = spark.createDataFrame(bench, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in decontam.contaminated(frame(docs), table).collect()}


def test_no_row_holds_all_places_of_a_document(spark, frame, monkeypatch):
    item = " ".join(WORDS[:20])
    docs, longest, put = [(1, " ".join([item] * 300)), (2, item)], [0], C.Scratch.put

    def measured(self, df):
        out = put(self, df)
        arrays = [c for c, kind in out.dtypes if kind.startswith("array")]
        if arrays:
            found = out.select(F.greatest(F.lit(0), *[F.max(F.size(c)) for c in arrays])).first()[0]
            longest[0] = max(longest[0], found or 0)
        return out

    monkeypatch.setattr(decontam, "PIECE", 64, raising=False)
    monkeypatch.setattr(C.Scratch, "put", measured)
    assert set(run(spark, frame, docs, [(7, item)])) == {(1, 7), (2, 7)}
    assert longest[0] <= 64 + 20


@pytest.mark.parametrize("piece", [7, 64])
def test_pieces_lose_no_window(spark, frame, monkeypatch, piece):
    """Items of one word to longer than a piece, over the borders of pieces and blocks, against all windows."""
    monkeypatch.setattr(decontam, "PIECE", piece, raising=False)
    rng = random.Random(piece)
    bench = [(q, " ".join(rng.sample(WORDS, n))) for q, n in enumerate((1, 3, 5, 9, 16, 40, 90))]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            held = rng.choice(bench)[1].split()
            turn = rng.randrange(len(held)) if rng.random() < 0.4 else 0
            parts += [rng.choice(["z", "--", "y\n\t"]) + str(rng.randrange(99)) for _ in range(rng.randrange(30))] + held[turn:] + held[:turn]
        docs.append((d, " " * (d % 3) + " . ".join(parts)))
    got = run(spark, frame, docs, bench)
    want = {(d, q): brute.best_window(t, i) for d, t in docs for q, i in bench}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items() if v[0] >= decontam.THRESHOLD}
    assert len(got) > 40


def test_pieces_hold_all_words(spark):
    texts = [" a  b\tc\nd e f g ", "a", "", " \n ", "a b c", "ñ é 日本 x" + " y" * 30, " a b c d e f g h"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for size, more in ((1, 0), (2, 3), (3, 4), (100, 4)):
        rows = df.select(decontam._split(F.col("text")).alias("words"),
                         F.transform(decontam._pieces(F.col("text"), size, more), lambda p: decontam._split(p)).alias("pieces")).collect()
        for r in rows:
            cut = [r.words[i:i + size + more] for i in range(0, len(r.words), size)]
            assert [p for p in r.pieces if p] == cut
