"""Operator 2: suffix-array deduplication of long repeated byte strings.

Every byte covered by a ``length``-byte string that also starts earlier (in a
document with a smaller id, or earlier in the same one) is removed; strings
are judged on the input.  Repeats are found by exact seed grouping, in place
of prefix doubling (``runs.repeated``): numpy hashes, Spark groups the seeds
at 32 and 64 bytes and the windows of ``length``, and a position leaves when
its group is unique.  There are no ranks joined from round to round.
Content-chosen positions stand for their neighbours until few are left, so
most of the text never becomes one row per byte.

Defined results: a null text is empty; an empty text, or one shorter than
``length``, loses nothing; repeated rows and null ids are numbered in order
(``common.keyed``), so the second of two equal rows loses what the first has;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import runs as R

LENGTH = 100
SEEDS = (32, 64)
OUT = "uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def duplicate_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, start, n, ref) over ``common.keyed`` documents: the strings that
    start at bytes start .. start+n-1 also start at position ref on."""
    seeds = SEEDS if length == LENGTH else (1 << max(0, length.bit_length() - 3), 1 << max(0, length.bit_length() - 2))
    return R.repeated(docs, R.byte_symbols, length, seeds, within=True)


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    lists = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(lists, "uid", "left")


def _doc_spans(batch: pa.RecordBatch, length: int):
    """For each row its removed byte spans, as sorted disjoint (start, end)."""
    spans = batch.column("spans")
    each = spans.flatten()
    start = each.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = start + each.field(1).to_numpy(zero_copy_only=False) + length - 1
    cuts = np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    for i in range(batch.num_rows):
        yield R.merge_spans(start[cuts[i]:cuts[i + 1]], end[cuts[i]:cuts[i + 1]])


def _kept(text: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)]))


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: sizes, maximal removed runs, and the digest of
    the bytes that stay."""
    def rows(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = []
            for uid, doc, text, (s, e) in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), texts, _doc_spans(batch, length)):
                text = text or b""
                out.append((uid, doc, len(text), int((e - s).sum()), len(s), hashlib.sha256(_kept(text, s, e)).hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    names = ["uid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([(c, pa.string() if c == "kept_sha256" else pa.int64()) for c in names])
    rows_of = C.keyed(docs)
    return _with_spans(rows_of, duplicate_spans(rows_of, length)).mapInArrow(rows, OUT).drop("uid")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text`` (and ``n_chars``
    counted anew, if there).  A character that a span covers in part stays.
    Null texts stay null.  The other columns are carried along unchanged."""
    ids = C.keyed(docs, whole=True)

    def rows(batches):
        for batch in batches:
            out = []
            for text, (s, e) in zip(batch.column("text").cast(pa.binary()).to_pylist(), _doc_spans(batch, length)):
                if text is not None and len(s):
                    text = _kept(text, *_whole_characters(text, s, e))
                out.append(text)
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string()), batch.column("row")], names=["text", "row"])

    schema = ids.select("text", "row").schema
    cut = _with_spans(ids, duplicate_spans(ids, length)).select("text", "row", "spans").mapInArrow(rows, schema)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return cut.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _whole_characters(text: bytes, s: np.ndarray, e: np.ndarray):
    """Spans drawn in to the UTF-8 characters that they cover in whole."""
    inside = lambda i, top: i < top and text[i] & 0xC0 == 0x80
    starts, ends = s.tolist(), e.tolist()
    for k in range(len(starts)):
        while inside(starts[k], ends[k]):
            starts[k] += 1
        while ends[k] > starts[k] and inside(ends[k], len(text)):
            ends[k] -= 1
    return np.array(starts), np.array(ends)
