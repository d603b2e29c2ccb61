"""Operator 3: packing along a space-filling curve.

A document's vector is its token ids hashed to random signs in ``DIMS``
dimensions (a signed random projection of its id counts), scaled by the root
of its length.  The vector's cell on a grid has a Hilbert key; documents are
range-sorted by (key, id), and their ids, one after another along the curve,
fill sequences of ``capacity`` ids, so neighbours in a sequence are alike.  A
document is cut where a sequence is full; only the last sequence is short.

Defined results: a null or empty text has the end id alone; repeated rows and
null ids are numbered in order (``common.keyed``) and all packed; documents
with one key follow each other by id; an empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 1024
DIMS = 3
GRID_BITS = 12


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of grid cells (rows of coordinates
    below 2 ** bits).  Level by level from the top bit, the curve's turn in
    each orthant is undone; the Gray code of what is left is the key."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            upper = (x[i] & bit) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(upper, x[i], x[i] ^ swap)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - one), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def signs(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A random sign per id and dimension."""
    bits = C.mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((bits >> np.uint64(40 + d)) & np.uint64(1)).astype(np.int8) * 2 - 1 for d in range(dims)], axis=1)


def curve_keys(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents laid end to end in ``ids``."""
    length = np.diff(np.append(starts, len(ids)))
    vector = np.add.reduceat(table[ids], starts, axis=0, dtype=np.int64) / np.sqrt(length)[:, None]
    cells = ((np.arctan(vector / 4) / np.pi + 0.5) * (1 << GRID_BITS)).astype(np.int64)
    return hilbert_key(np.clip(cells, 0, (1 << GRID_BITS) - 1), GRID_BITS)


def _encoded(tokenizer: str, end_id: int):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])

    def rows(batches):
        from .tokens import encoder
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        table = signs(np.arange(enc.tok.get_vocab_size()))
        small = "<u2" if len(table) <= 1 << 16 else "<u4"
        for batch in batches:
            texts, n = batch.column("text").to_pylist(), batch.num_rows
            a = 0
            while a < n:  # at most a slab of text (or one document) at once
                b, held = a, 0
                while b < n and (b == a or held + len(texts[b] or "") <= C.SLAB_BYTES):
                    held += len(texts[b] or "")
                    b += 1
                ids = [np.frombuffer(raw + end, "<u4") for raw in enc.encode(t or "" for t in texts[a:b])]
                size = np.array([len(x) for x in ids])
                key = curve_keys(np.concatenate(ids), np.cumsum(size) - size, table)
                yield pa.record_batch([batch.column("uid")[a:b], batch.column("doc_id")[a:b], pa.array(size), pa.array(key),
                                       pa.array([x.astype(small).tobytes() for x in ids], pa.binary())], schema=schema)
                a = b

    return rows


def _cut(capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def rows(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            before = batch.column("before").to_numpy()
            first = before // capacity
            pieces = (before + n - 1) // capacity - first + 1
            of = np.repeat(np.arange(len(n)), pieces)
            at = (first[of] + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            begin, stop = np.maximum(at, before[of]), np.minimum(at + capacity, (before + n)[of])
            start, length = begin - before[of], stop - begin
            texts = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4").tobytes()
                     for x, k in zip(batch.column("ids").to_pylist(), n.tolist())]
            ids = [texts[d][4 * s:4 * (s + k)] for d, s, k in zip(of.tolist(), start.tolist(), length.tolist())]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(length), pa.array(n[of]),
                                   pa.array(begin // capacity), pa.array(begin % capacity), pa.array(ids, pa.binary())], schema=schema)

    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids):
    ``ids`` are little-endian unsigned 32-bit integers."""
    scratch = C.Scratch(docs.sparkSession)
    encoded = scratch.put(C.keyed(docs).select("uid", "doc_id", "text")
                          .mapInArrow(_encoded(tokenizer, end_id), "uid long, doc_id long, n long, key long, ids binary"))
    # only (key, uid, n) is sorted; the ids meet their places by uid
    places = C.running_start(encoded.select("key", "uid", "n"), [F.col("key"), F.col("uid")], F.col("n")).select("uid", "before")
    return (encoded.join(places, "uid").select("doc_id", "n", "before", "ids")
            .mapInArrow(_cut(capacity), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"))
