"""Shared pieces of the training-data operators: scratch tables, unique row
keys, and vectorised hashing of bytes and words.

Hashes are 64-bit and computed in numpy over flat Arrow buffers, so that one
call covers many documents.  Every loop works on slabs of at most
``SLAB_BYTES`` of text (or one document), which bounds a task's memory.
"""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.session import ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLAB_BYTES = 1 << 20
#: Rows handed to a Python worker at once; texts may be long.
ARROW_ROWS = 512
WORD_SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: The same class as a Java pattern (ASCII white space only).
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_C, _BASE = _U(0xFF51AFD7ED558CCD), 0xD6E8FEB86659FD93
_INV_BASE = pow(_BASE, -1, 1 << 64)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the Python stages rely on, and the package for
    workers that do not see the repository on their own path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if ROOT not in os.environ.get("PYTHONPATH", "").split(":"):
        sc = spark.sparkContext
        if not getattr(sc, "_repolens_shipped", False):
            built = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "repolens_package"), "zip", ROOT, "repolens")
            sc.addPyFile(built)
            sc._repolens_shipped = True
    return spark


class Scratch:
    """Tables written under the cluster's shared checkpoint folder.

    ``put`` writes once and reads back (lineage ends at shared storage, so a
    lost executor costs a re-read); ``drop`` frees a table no longer needed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = ensure_checkpoint_dir(spark).rstrip("/")
        self.at: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/llm/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        gc.collect()
        self.spark._jvm.System.gc()  # lets Spark delete the shuffle files of the finished job
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = self.at.pop(id(df), None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Positions are packed into one long as uid * 2 ** POS_BITS + offset.
POS_BITS = 31


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(uid, doc_id, text): a distinct uid per row, ordered as the ids are;
    if ``whole``, also ``row``, a struct of all columns of the input.

    Distinct, non-null ids within 32 bits are taken as they are.  Otherwise
    (repeated rows, null ids, huge ids) rows are numbered in the order of
    (id with nulls first, text), so a repeated row counts as a later document
    than the first one."""
    more = ["row"] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *([F.struct(*docs.columns).alias("row")] if whole else []))
    ids = rows.groupBy("doc_id").count().agg(
        F.max("count").alias("n"), F.max(F.col("doc_id").isNull()).alias("null"),
        F.max(F.abs("doc_id")).alias("far")).first()
    if not ids["null"] and (ids["n"] or 1) == 1 and (ids["far"] or 0) < 1 << (63 - POS_BITS - 1):
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text", *more)
    placed = running_start(rows, [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()], F.lit(1))
    return placed.select(F.col("before").alias("uid"), "doc_id", "text", *more)


def running_start(df: DataFrame, order: list, weight, parts: int | None = None) -> DataFrame:
    """``df`` with ``before`` = the sum of ``weight`` over all rows that come
    earlier in ``order``: a range shuffle, a running sum inside each range,
    and the totals of the ranges before it (one row per range).  Rows equal
    in all of ``order`` may come in any order."""
    from pyspark.sql import Window
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = Scratch(spark).put(df.withColumn("_w", weight.cast("long")).repartitionByRange(n, *order)
                                .withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum("_w").alias("_total"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    return (ranged.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
            .join(totals, "_part").withColumn("before", F.col("_inside") + F.col("_ahead"))
            .drop("_part", "_w", "_inside", "_ahead"))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (changes and returns ``x``)."""
    x ^= x >> _U(33)
    x *= _C
    x ^= x >> _U(29)
    return x


#: A random-looking name per byte value.
BYTE_NAME = mix(np.arange(1, 257, dtype=np.uint64) * _A)


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = left * _A
    x += right * _B
    x ^= x >> _U(32)
    x *= _C
    return x


def doubled_names(symbols: np.ndarray, upto: int):
    """Names of all substrings of length 1, 2, 4 ... ``upto`` by position:
    the name of length 2L is that of the pair at p and p + L."""
    names, length = {1: symbols}, 1
    while length < upto:
        cur = names[length]
        names[2 * length] = pair_name(cur[:-length], cur[length:]) if len(cur) > length else cur[:0]
        length *= 2
    return names


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    size = 1 << max(12, (n - 1).bit_length())
    got = _POW.get(size)
    if got is None:
        with np.errstate(over="ignore"):
            up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
            up[1:], down[1:] = _U(_BASE), _U(_INV_BASE)
            got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 21:
            _POW[size] = got
    return got


_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(WORD_SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_flat(data: np.ndarray, bounds: np.ndarray, lower: bool = False):
    """Words of documents laid end to end in ``data`` (uint8), document i
    being bytes bounds[i]:bounds[i+1].  Returns (hash, start, end, doc).
    Longer input (one very long document) is hashed in pieces that end at a
    separator, which bounds the working arrays."""
    n, parts, at = len(data), [], 0
    while n - at > 2 * SLAB_BYTES:
        cut, look = at + SLAB_BYTES, 4096
        while cut < n and not _IS_SEP[data[cut:cut + look]].any():
            cut, look = cut + look, look * 2
        if cut >= n:
            break
        cut += int(np.argmax(_IS_SEP[data[cut:cut + look]]))
        parts.append((at, cut))
        at = cut
    if not parts:
        return _words_piece(data, bounds, lower)
    out = []
    for lo, hi in [*parts, (at, n)]:
        first = np.searchsorted(bounds, lo, side="right") - 1
        last = np.searchsorted(bounds, hi, side="left")
        inner = np.clip(bounds[first:last + 1], lo, hi) - lo
        name, start, end, doc = _words_piece(data[lo:hi], inner, lower)
        out.append((name, start + lo, end + lo, doc + first))
    return tuple(np.concatenate(x) for x in zip(*out))


def _words_piece(data: np.ndarray, bounds: np.ndarray, lower: bool):
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    if lower:
        data = _LOWER[data]
    word = ~_IS_SEP[data]
    first = np.zeros(n + 1, bool)
    first[bounds[(bounds >= 0) & (bounds <= n)]] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_NAME[data] * up[:n], out=sums[1:])
    name = (sums[end] - sums[start]) * down[start]
    name = mix(name + (end - start).astype(np.uint64) * _B)
    return name, start, end, np.searchsorted(bounds, start, side="right") - 1


def slabs(column: pa.Array):
    """Yield (first row, last row, bytes, bounds) over runs of rows of a
    string or binary column whose text is at most SLAB_BYTES, or one row."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + SLAB_BYTES, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))
