"""Sampled positions of symbol sequences, for exact search of repeated
windows.

A window is ``window`` consecutive symbols (bytes or words) of one document.
Every window picks one of its ``seed``-symbol substrings: the rightmost one
with the least name.  The choice depends on the window's content alone, so
equal windows pick the same seed at the same place, and neighbouring windows
mostly pick the same position: a *run*.  A run is a row

    key     name of the seed,
    body    name of all symbols that the run's windows cover, with the
            seed's place among them: equal for equal runs,
    pos, n  the windows pos .. pos+n-1; pos = uid * 2 ** POS_BITS + start.

Two windows can be equal only if their runs have the same key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RUN_SCHEMA = "key long, body long, pos long, n int"
#: Windows named at once; longer documents go through in pieces.
PIECE = 1 << 15


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """For each i the rightmost position of the least of names[i:i+width], by
    doubling.  Names are compared by their upper half; the lower half of each
    word holds the position, counted down."""
    low = np.uint64(0xFFFFFFFF)
    packed = (names & ~low) | (low - np.arange(len(names), dtype=np.uint64))
    span = 1
    while span < width:
        step = min(span, width - span)
        packed = np.minimum(packed[step:], packed[:-step])
        span += step
    return (low - (packed & low)).astype(np.int64)


def _runs_piece(sym: np.ndarray, doc_of: np.ndarray, hi_of: np.ndarray, window: int, seed: int):
    """Runs of one piece of symbols; document d of the piece ends at symbol
    hi_of[d].  Returns (key, body, d, first window, windows) or None."""
    count = len(sym) - window + 1
    if count <= 0:
        return None
    big = 1 << (window.bit_length() - 1)  # the longest doubled name: 64 of 100, 32 of 50
    names = C.doubled_names(sym, big)
    at = _least(names[seed], window - seed + 1)[:count]
    d = doc_of[:count]
    valid = np.arange(count) + window <= hi_of[d]
    new = np.ones(count, bool)
    new[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1]) | ~valid[:-1]
    new &= valid
    first = np.flatnonzero(new)
    if not len(first):
        return None
    # a run ends before the next one or with its document's last window
    stop = np.minimum(np.append(first[1:], count), hi_of[d[first]] - window + 1)
    length = stop - first + window - 1
    body = C.pair_name(names[big][first], names[big][first + (length - big) // 2])
    body = C.pair_name(body, names[big][first + length - big])
    body = C.pair_name(body, ((at[first] - first) * (4 * window) + length).astype(np.uint64))
    return names[seed][at[first]], body, d[first], first, stop - first


def runs_of(sym: np.ndarray, bounds: np.ndarray, window: int, seed: int):
    """Yield runs (key, body, document index, start in the document, n) of
    documents laid end to end in ``sym``; document i is bounds[i]:bounds[i+1]."""
    total = len(sym)
    for lo in range(0, max(0, total - window + 1), PIECE):
        hi = min(total, lo + PIECE + window - 1)
        first = int(np.searchsorted(bounds, lo, side="right")) - 1
        last = int(np.searchsorted(bounds, hi, side="left"))
        inner = np.clip(bounds[first:last + 1], lo, hi) - lo
        doc_of = np.repeat(np.arange(len(inner) - 1), np.diff(inner))
        got = _runs_piece(sym[lo:hi], doc_of, inner[1:], window, seed)
        if got:
            key, body, d, start, n = got
            yield key, body, d + first, start + lo - bounds[d + first], n


def run_batches(symbols, window: int, seed: int):
    """mapInArrow function: (uid, text) -> runs of all windows.  ``symbols``
    turns a slab (bytes, bounds) into (symbols, bounds in symbols)."""

    def rows(batches):
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for a, b, data, bounds in C.slabs(batch.column("text")):
                sym, sb = symbols(data, bounds)
                base = uid[a:b] << C.POS_BITS
                out = [(key, body, base[d] + start, n) for key, body, d, start, n in runs_of(sym, sb, window, seed)]
                if out:
                    key, body, pos, n = (np.concatenate(x) for x in zip(*out))
                    yield pa.record_batch([C.as_long(key), C.as_long(body), pa.array(pos), pa.array(n.astype(np.int32))],
                                          names=["key", "body", "pos", "n"])

    return rows


def again_batches(symbols, window: int, seed: int):
    """mapInArrow function: (uid, text, spans) -> runs, of a longer seed, of
    the windows in spans (start, n) only, with the windows' own names
    (``names``: n little-endian 64-bit words)."""
    big = 1 << (window.bit_length() - 1)

    def rows(batches):
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            spans = batch.column("spans")
            each = spans.flatten()
            s_all = each.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
            n_all = each.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.append(0, np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False)))
            for a, b, data, bounds in C.slabs(batch.column("text")):
                sym, sb = symbols(data, bounds)
                starts, ends, docs = [], [], []
                for i in range(a, b):
                    at = slice(cuts[i], cuts[i + 1])
                    s, e = merge_spans(s_all[at], s_all[at] + n_all[at])
                    starts.append(s), ends.append(e), docs.append(np.full(len(s), i))
                s, e, d = np.concatenate(starts), np.concatenate(ends), np.concatenate(docs)
                length = e - s + window - 1
                part = sym[expand(s + sb[d - a], length)]
                pb = np.append(0, np.cumsum(length))
                if not len(part):
                    continue
                top = C.doubled_names(part, big)[big]
                whole = C.pair_name(top[:len(part) - window + 1], top[window - big:])
                for key, body, k, start, n in runs_of(part, pb, window, seed):
                    at = whole[expand(start + pb[k], n)].astype("<u8")
                    offs = np.append(0, np.cumsum(n)) * 8
                    names = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(at)])
                    yield pa.record_batch([C.as_long(key), C.as_long(body), pa.array((uid[d[k]] << C.POS_BITS) + s[k] + start),
                                           pa.array(n.astype(np.int32)), names], names=["key", "body", "pos", "n", "names"])

    return rows


def window_batches(batches):
    """mapInArrow function: (pos, n, names) -> one row (name, pos) per window."""
    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64)
        pos = batch.column("pos").to_numpy()
        name = np.frombuffer(b"".join(batch.column("names").to_pylist()), "<i8")
        yield pa.record_batch([pa.array(name), pa.array(expand(pos, n))], names=["name", "pos"])


def _uid(c: str):
    return F.shiftright(F.col(c), C.POS_BITS)


def _offset(c: str):
    return F.col(c).bitwiseAND((1 << C.POS_BITS) - 1).cast("int")


def repeated(docs: DataFrame, symbols, window: int, seeds: tuple[int, int], within: bool) -> DataFrame:
    """Windows that occur earlier, as rows (uid, start, n, ref): windows
    start .. start+n-1 of document uid equal those that begin at position
    ``ref``, which is earlier.  Earlier means a smaller uid or, if ``within``,
    also a smaller start in the same document.

    Ranks are refined at growing lengths seeds[0] < seeds[1] < window; a
    position whose name at some length is unique leaves.  In a round, Spark
    groups the runs by key.  If all runs of a key are equal, all but the
    first are repeats.  Otherwise equal runs (key, body) are ranked by their
    first position: the later ones repeat it, and the first goes on to the
    next length.  The last round names every window that is left.

    Groups are only ever aggregated (counts and minima, combined before the
    shuffle) and joined back, never gathered, so a passage that a third of
    all documents share is one small row on the grouped side.

    Returns a table in shared storage."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    later = F.col("first") < F.col("pos") if within else _uid("first") < _uid("pos")
    text = docs.select("uid", "text")

    def settle(runs: DataFrame, *more: str):
        # the few shared keys are written first: the shuffle that found them is gone when the runs are shuffled to meet them
        keys = scratch.put(runs.groupBy("key")
                           .agg(F.count("*").alias("_c"), F.min("body").alias("_lo"), F.max("body").alias("_hi"), F.min("pos").alias("first"))
                           .filter("_c > 1").select("key", "first", (F.col("_lo") != F.col("_hi")).alias("mixed")))
        shared = scratch.put(runs.join(keys, "key"))
        scratch.drop(keys)
        mixed = shared.filter("mixed").drop("first", "mixed")
        classes = mixed.groupBy("key", "body").agg(F.min("pos").alias("first"))
        ranked = scratch.put(mixed.join(classes, ["key", "body"]).select("pos", "n", "first", later.alias("later"), *more))
        settled = [shared.filter(~F.col("mixed") & later).select("pos", "n", "first"), ranked.filter("later").select("pos", "n", "first")]
        return settled, ranked.filter(~F.col("later")), [shared, ranked]

    first = scratch.put(text.mapInArrow(run_batches(symbols, window, seeds[0]), RUN_SCHEMA))
    done, left, used = settle(first)
    scratch.drop(first)
    spans = left.groupBy(_uid("pos").alias("uid")).agg(F.collect_list(F.struct(_offset("pos").alias("s"), "n")).alias("spans"))
    second = scratch.put(text.join(spans, "uid").mapInArrow(again_batches(symbols, window, seeds[1]), RUN_SCHEMA + ", names binary"))
    more, left, used_more = settle(second, "names")
    scratch.drop(second)
    windows = scratch.put(left.select("pos", "n", "names").mapInArrow(window_batches, "name long, pos long"))
    names = windows.groupBy("name").agg(F.min("pos").alias("first"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    found = windows.join(names, "name").filter(later).select("pos", F.lit(1).alias("n"), "first")
    for df in [*done, *more]:
        found = found.unionByName(df)
    out = scratch.put(found.select(_uid("pos").alias("uid"), _offset("pos").alias("start"), F.col("n").cast("int").alias("n"), F.col("first").alias("ref")))
    scratch.drop(windows, *used, *used_more)
    return out


def byte_symbols(data: np.ndarray, bounds: np.ndarray):
    return C.BYTE_NAME[data], bounds


def word_symbols(data: np.ndarray, bounds: np.ndarray):
    name, start, _, _ = C.words_flat(data, bounds)
    return name, np.searchsorted(start, bounds)


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1 ... (n[0] of them), start[1] ..."""
    n = n.astype(np.int64)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)


def merge_spans(start: np.ndarray, end: np.ndarray):
    """Union of half-open spans as sorted disjoint, non-adjacent spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]
