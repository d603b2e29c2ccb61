"""Each stage of the pipeline against a brute-force version on its own input."""

import corpus_pipeline
import pytest

from repolens.llm import common as C
from repolens.llm import packing

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    scratch, columns = C.Scratch(spark), docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = scratch.put(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect()
        if k < 4:
            assert docs.columns == columns and after
        if k == 0:
            assert set(after) == {d for d, t in before if any(map(str.isalpha, t or ""))}
        elif k == 1:
            assert set(after) == {d for d, _, _, kept in brute.near_components(before, 5) if kept}
        elif k == 2:
            kept = dict(brute.repeated_bytes(before)[1])
            assert set(after) == set(kept)
            for d, r in after.items():
                assert len(kept[d]) <= len(r.text.encode()) <= len(kept[d]) + 20
                assert r.text.isascii() is False or r.text.encode() == kept[d]
        elif k == 3:
            assert set(after) == {d for d, _ in before} - {before[i][0] for i, _ in quick_leaks(before, bench)}
        else:
            assert {r.doc_id for r in after} == {d for d, _ in before}
            assert sum(r.length for r in after) > 0
            assert max(r.offset + r.length for r in after) == packing.CAPACITY


def quick_leaks(docs, items):
    """brute.leaks over the pairs that share a shingle."""
    split = lambda t: brute.WORD.findall((t or "").lower().translate(brute.PUNCTUATION))
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    of = [grams(split(t)) for _, t in items]
    out = {}
    for d, doc in enumerate(docs):
        mine = grams(split(doc[1]))
        for q, item in enumerate(items):
            if mine & of[q]:
                out |= {(d, q): v for v in brute.leaks([doc], [item]).values()}
    return out


@pytest.mark.parametrize("case", ["ragged", "none"])
def test_run_takes_ragged_and_empty_tables(spark, frame, scratch, request, case):
    pairs = request.getfixturevalue("ragged")
    df = frame(pairs) if case == "ragged" else frame([]).limit(0)
    df.write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    out = corpus_pipeline.run(spark, scratch)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert (out.count() > 0) == (case == "ragged")


def test_registered(spark):
    import __spark_entry__ as entry
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
