"""Operator 9: token ids in bit-plane files.

``write`` orders documents by id, encodes them, ends each with one id, and
stores their ids in chunks of whole documents.  A chunk's ids are taken in
blocks of ``BLOCK``; a block is transposed into bit planes (plane b holds bit
b of every id), each plane compressed with zstandard.  The chunk index says
for each chunk its range, its place in the range, the ids before it there, its
documents and their lengths.  ``read`` decodes the chunks, each by itself.

    <path>/chunks   part, chunk, before, n_ids, bits, doc_ids, lengths, planes
    <path>/index    part, chunk, before, n_ids, first_doc, n_docs

Defined results: a null or empty text has the end id alone; repeated and null
ids are kept, in the order of (id with nulls first, text); an empty table
gives empty files; other columns are ignored.  A chunk closes with the
document that takes it past ``CHUNK_IDS``, so a very long text makes one
larger chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1 << 14
CHUNK_IDS = 1 << 18
LEVEL = 1

_CHUNK = pa.schema([("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("planes", pa.list_(pa.binary()))])
_CHUNK_SQL = "chunk int, before long, n_ids long, bits int, doc_ids array<long>, lengths array<int>, planes array<binary>"


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The bit planes of a block of ids, least bit first."""
    ids = ids.astype("<u2" if bits <= 16 else "<u4", copy=False)
    return [np.packbits(((ids >> b) & 1).astype(np.uint8), bitorder="little").tobytes() for b in range(bits)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    """The ids of a block from its bit planes."""
    out = np.zeros(count, "<u2" if len(planes) <= 16 else "<u4")
    for b, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=count).astype(out.dtype) << b
    return out.astype("<u4", copy=False)


def _chunks(tokenizer: str, end_id: int):
    def rows(batches):
        import zstandard

        from .tokens import encoder
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        press = zstandard.ZstdCompressor(level=LEVEL)
        docs, parts, held, before, chunk = [], [], 0, 0, 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            bits = max(1, int(ids.max()).bit_length())
            planes = [press.compress(p) for k in range(0, len(ids), BLOCK) for p in to_planes(ids[k:k + BLOCK], bits)]
            return pa.RecordBatch.from_pylist([{"chunk": chunk, "before": before, "n_ids": len(ids), "bits": bits, "doc_ids": docs,
                                                "lengths": [len(p) // 4 for p in parts], "planes": planes}], schema=_CHUNK)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                parts.append(enc.encode([text or ""])[0] + end)
                docs.append(doc)
                held += len(parts[-1]) // 4
                if held >= CHUNK_IDS:
                    yield close()
                    docs, parts, held, before, chunk = [], [], 0, before + held, chunk + 1
        if docs:
            yield close()

    return rows


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into ``path``, in ascending doc_id."""
    spark = docs.sparkSession
    rows = C.keyed(docs)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "uid").sortWithinPartitions("uid").select("doc_id", "text")
    chunks = ordered.mapInArrow(_chunks(tokenizer, end_id), _CHUNK_SQL).withColumn("part", F.spark_partition_id())
    chunks.write.parquet(f"{path}/chunks")
    stored = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
    (stored.select("part", "chunk", "before", "n_ids", F.col("doc_ids")[0].alias("first_doc"), F.size("doc_ids").alias("n_docs"))
     .coalesce(n).write.parquet(f"{path}/index"))


def _documents(batches):
    """mapInArrow function: chunks -> (part, doc_id, inside, ids)."""
    import zstandard
    opener = zstandard.ZstdDecompressor()
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("part", "before", "n_ids", "bits", "doc_ids", "lengths", "planes")}
            bits, ids = row["bits"], []
            for b in range(0, len(row["planes"]), bits):
                count = min(BLOCK, row["n_ids"] - b // bits * BLOCK)
                ids.append(from_planes([opener.decompress(p, max_output_size=BLOCK // 8) for p in row["planes"][b:b + bits]], count))
            raw = memoryview(np.concatenate(ids).tobytes())
            length = np.array(row["lengths"], np.int64)
            start = np.cumsum(length) - length
            crc = [zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip(start.tolist(), row["lengths"])]
            yield pa.record_batch([pa.array([row["part"]] * len(crc), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                                   pa.array(row["before"] + start), pa.array(length), pa.array(crc, pa.int64())], schema=schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32).
    The ids before a range come from the chunk index: one row per range."""
    from pyspark.sql import Window
    totals = spark.read.parquet(f"{path}/index").groupBy("part").agg(F.sum("n_ids").alias("total"))
    ahead = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    docs = spark.read.parquet(f"{path}/chunks").mapInArrow(_documents, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
