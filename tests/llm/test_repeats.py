"""Operators 2 and 4 against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolens.llm import common as C
from repolens.llm import rlz, runs, suffix

from . import brute


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("which", ["rows", "ragged"])
def test_suffix_digests(frame, request, which):
    pairs = request.getfixturevalue(which)
    out = got(suffix.digests(frame(pairs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out == sorted(brute.repeated_bytes(pairs)[0], key=str)
    assert sum(r[2] for r in out) > 1000


@pytest.mark.parametrize("which", ["rows", "ragged"])
def test_word_digests(frame, request, which):
    pairs = request.getfixturevalue(which)
    out = got(rlz.digests(frame(pairs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert out == sorted(brute.repeated_words(pairs), key=str)
    assert sum(r[2] for r in out) > 300


def test_other_lengths(frame, rows):
    small = [(d, t if t is None else t[:600]) for d, t in rows]
    assert got(suffix.digests(frame(small), 40), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_bytes(small, 40)[0], key=str)
    assert got(rlz.digests(frame(small), 9), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_words(small, 9), key=str)


def test_text_output(frame, rows):
    df = frame(rows)
    out = suffix.deduplicated(df)
    assert out.columns == df.columns and out.schema == df.schema
    kept = dict(brute.repeated_bytes(rows)[1])
    for r in out.collect():
        if r.text is None:
            continue
        raw = kept[r.doc_id]
        assert r.n_chars == len(r.text)
        if r.text.isascii():
            assert r.text.encode() == raw
        else:  # cut characters stay whole
            assert len(raw) <= len(r.text.encode()) <= len(raw) + 12


def test_factors_cover_the_removed_words(frame, rows):
    removed = {r.doc_id: r.n_removed for r in rlz.digests(frame(rows)).collect()}
    cover = {}
    for r in rlz.factors(frame(rows)).collect():
        assert r.length >= rlz.WINDOW and r.ref_uid < r.doc_id
        cover.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert {d: len(x) for d, x in cover.items()} == {d: n for d, n in removed.items() if n}


def test_empty_tables(frame):
    assert suffix.digests(frame([]).limit(0)).count() == 0
    assert rlz.digests(frame([]).limit(0)).count() == 0
    assert suffix.deduplicated(frame([]).limit(0)).count() == 0
    assert rlz.factors(frame([]).limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", max_size=300), min_size=1, max_size=6))
def test_runs_cover_each_window_once_and_agree(texts):
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    bounds = np.append(0, np.cumsum([len(x) for x in data]))
    sym = C.BYTE_NAME[np.concatenate(data)] if bounds[-1] else np.zeros(0, np.uint64)
    key_of, seen = {}, set()
    for key, body, doc, start, n in runs.runs_of(sym, bounds, 20, 4):
        for k, d, s, m in zip(key, doc, start, n):
            for p in range(s, s + m):
                assert (d, p) not in seen
                seen.add((d, p))
                assert key_of.setdefault(texts[d][p:p + 20], k) == k
    assert seen == {(d, p) for d, t in enumerate(texts) for p in range(len(t) - 19)}


def test_merge_spans():
    s, e = runs.merge_spans(np.array([5, 0, 3, 9]), np.array([6, 3, 4, 12]))
    assert list(zip(s, e)) == [(0, 4), (5, 6), (9, 12)]
