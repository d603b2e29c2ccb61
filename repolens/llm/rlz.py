"""Operator 4: substring deduplication by exact seed grouping.

Repeated 50-word windows come from ``runs.repeated``, the engine of operator
2 with words as symbols, in place of relative Lempel-Ziv parsing: a match
refers to the first occurrence, and neighbouring matches that go on there are
joined to factors.  No longest factor is searched among all places of a block.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Earlier means a document with
a smaller id; windows are judged on the input.

Defined results: a null or empty text has no words; texts with fewer than
``window`` words lose nothing; repeated rows and null ids are numbered in
order (``common.keyed``); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import runs as R

WINDOW = 50
SEEDS = (16, 32)


def matches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, start, n, ref): the windows that start at words start ..
    start+n-1 occur from word position ``ref`` on, in an earlier document."""
    seeds = SEEDS if window == WINDOW else (1 << max(0, window.bit_length() - 3), 1 << max(0, window.bit_length() - 2))
    return R.repeated(docs, R.word_symbols, window, seeds, within=False)


def _greedy(start: np.ndarray, n: np.ndarray, ref: np.ndarray):
    """Factors (first window, windows, ref) of one document's matches: a
    match joins the factor before it if it goes on where that one ends, in
    the document and in the reference."""
    if not len(start):
        return start, n, ref
    order = np.argsort(start, kind="stable")
    start, n, ref = start[order], n[order], ref[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + n[:-1]) | (ref[1:] != ref[:-1] + n[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], (start + n)[last] - start[first], ref[first]


def _per_document(batch: pa.RecordBatch):
    found = batch.column("found")
    each = found.flatten()
    start, n, ref = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    cuts = np.append(0, np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    for i in range(batch.num_rows):
        at = slice(cuts[i], cuts[i + 1])
        yield _greedy(start[at], n[at], ref[at])


def _with_matches(docs: DataFrame, window: int) -> DataFrame:
    lists = matches(docs, window).groupBy("uid").agg(F.collect_list(F.struct("start", "n", "ref")).alias("found"))
    return docs.join(lists, "uid", "left")


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The sufficiently long factors: (doc_id, start, length, ref_uid,
    ref_start), in words; ref_uid is the earlier document's uid."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ref_uid", pa.int64()), ("ref_start", pa.int64())])

    def rows(batches):
        for batch in batches:
            for doc, (s, n, ref) in zip(batch.column("doc_id").to_pylist(), _per_document(batch)):
                if len(s):
                    yield pa.record_batch([pa.array([doc] * len(s), pa.int64()), pa.array(s), pa.array(n + window - 1),
                                           pa.array(ref >> C.POS_BITS), pa.array(ref & ((1 << C.POS_BITS) - 1))], schema=schema)

    with_found = _with_matches(C.keyed(docs), window)
    return with_found.drop("text").mapInArrow(rows, "doc_id long, start long, length long, ref_uid long, ref_start long")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, those that duplicate spans cover, and
    the digest of the others joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def rows(batches):
        for batch in batches:
            doc, parsed, out = batch.column("doc_id").to_pylist(), list(_per_document(batch)), []
            for a, b, data, bounds in C.slabs(batch.column("text")):
                _, start, end, _ = C.words_flat(data, bounds)
                wb = np.searchsorted(start, bounds)
                for i in range(a, b):
                    s, n, _ = parsed[i]
                    s, e = R.merge_spans(s, s + n + window - 1)
                    lo, hi = wb[i - a], wb[i - a + 1]
                    keep = np.ones(hi - lo, bool)
                    keep[R.expand(s, e - s)] = False
                    k = np.flatnonzero(keep) + lo
                    out.append((doc[i], hi - lo, hi - lo - len(k), hashlib.sha256(_joined(data, start[k], end[k])).hexdigest()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    with_found = _with_matches(C.keyed(docs), window)
    return with_found.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words data[start:end] joined by one space."""
    if not len(start):
        return b""
    raw, size = end - start, end - start + 1
    out = np.full(int(size.sum()), 0x20, np.uint8)
    to = np.cumsum(size) - size
    out[R.expand(to, raw)] = data[R.expand(start, raw)]
    return out[:-1].tobytes()
