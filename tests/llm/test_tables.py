"""Operators 8 and 10."""

import collections
import zlib

import numpy as np
import pytest

from repolens.llm import rules, sharding

from . import brute


@pytest.mark.parametrize("which", ["rows", "ragged"])
def test_shards(frame, scratch, request, which):
    pairs = request.getfixturevalue(which)
    out = sharding.shard(frame(pairs), f"{scratch}/map").collect()
    key = lambda d, t: (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == sorted((key(*p) for p in pairs), key=str)
    slots = collections.defaultdict(list)
    for r in out:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sizes_are_near_equal_and_versions_are_kept(spark, frame, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard(docs, f"{scratch}/map")
    load = [r["s"] for r in out.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(load) == 24 and max(load) - min(load) <= 0.02 * np.mean(load)
    first = {r.virtual_slot: r.shard for r in sharding.load_map(spark, f"{scratch}/map", 0).collect()}
    newest = {r.virtual_slot: r.shard for r in sharding.load_map(spark, f"{scratch}/map").collect()}
    assert set(first) == set(newest) == set(range(sharding.SLOTS)) and first != newest
    assert all(newest[r.virtual_slot] == r.shard for r in out.collect())


def test_growing_moves_slots_only_into_the_new_shard():
    sizes = np.random.default_rng(1).pareto(2, 2000) * 100
    before = sharding.rebalanced(sharding.first_map(2000, 7), sizes, 7)
    load = np.bincount(before, weights=sizes)
    assert load.max() - load.min() <= sharding.TOLERANCE * load.mean()
    after = sharding.grown(before, sizes, 7)
    assert set(after[after != before]) == {7}
    assert 0.8 * sizes.sum() / 8 <= sizes[after == 7].sum() <= 1.2 * sizes.sum() / 8


@pytest.mark.parametrize("which", ["rows", "ragged"])
def test_rule_counts(frame, request, which):
    pairs = request.getfixturevalue(which)
    out = sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rules.judge(frame(pairs)).collect()), key=str)
    assert out == sorted(((d, *brute.rule_counts(t)) for d, t in pairs), key=str)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    data = [(i, "bad words" if i % 10 else good, "bad.example") for i in range(200)]
    data += [(1000 + i, good if i % 10 else "bad words", f"h{i % 8}") for i in range(400)] + [(5000, good, None), (5001, None, None), (5002, good, "new.example")]
    out = {r.doc_id: r for r in rules.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not any(out[i].kept for i in range(200))
    assert all(out[1000 + i].kept == bool(i % 10) for i in range(400))
    assert out[5000].kept and not out[5001].kept and out[5002].kept
    # the rate of a host with one document is drawn towards the mean
    assert 0 < out[5002].host_rate < out[0].host_rate <= 0.9


def test_verdict_by_the_exact_rate(spark):
    """500 and 499 failures of 999: both rates round to 0.5, one is above."""
    good = " ".join(f"w{i}" for i in range(80))
    data = [(1000 * h + i, "bad" if i < f else good, f"h{h}") for h, f in enumerate([500, 499]) for i in range(999)]
    out = rules.judge(spark.createDataFrame(data, "doc_id long, text string, source string"))
    kept = {r.host: r.kept for r in out.filter("not base_failed").select("host", "kept").distinct().collect()}
    assert kept == {"h0": False, "h1": True}


def test_rules_are_native_and_take_empty_tables(frame, rows):
    df = rules.judge(frame(rows))
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "MapInArrow"))
    base = rules.base(frame(rows))._jdf.queryExecution().toString()
    assert not any(x in base for x in ("Python", "Pandas", "MapInArrow"))
    assert rules.judge(frame([]).limit(0)).count() == 0


def test_shards_of_nothing(frame, scratch):
    assert sharding.shard(frame([]).limit(0), f"{scratch}/none").count() == 0
