"""Registered queries of the training-data operators: each applies its
operator to its whole table and derives the result columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.session import read_table

from . import common as C
from . import binfmt, decontam, langid, merkle, minhash, negatives, oracle, packing, quality, rlz, rules, sharding, suffix, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(C.prepare(spark), sf_dir, "documents")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items (operator 1)."""
    return decontam.contaminated(_docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier, removed (operator 2)."""
    return suffix.digests(_docs(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents packed along a Hilbert curve (operator 3)."""
    return packing_digests(_docs(spark, sf_dir))


def packing_digests(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows of an earlier document, removed (operator 4)."""
    return rlz.digests(_docs(spark, sf_dir))


def op5_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores by naive Bayes support vectors (operator 5)."""
    return quality.classify(_docs(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by family, then among its languages (operator 6)."""
    return langid.identify(_docs(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 4-word shingles (operator 7)."""
    return minhash.clusters(_docs(spark, sf_dir), size=4)


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by virtual slots and a balanced slot map (operator 8)."""
    docs = _docs(spark, sf_dir)
    return sharding.shard(docs, f"{C.Scratch(spark).base}/llm/{uuid.uuid4().hex}")


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as bit planes and read back (operator 9)."""
    docs = _docs(spark, sf_dir)
    path = f"{C.Scratch(spark).base}/llm/{uuid.uuid4().hex}"
    binfmt.write(docs, path)
    return binfmt.read_digests(spark, path)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with host verdicts; the host is the source (operator 10)."""
    return rules.judge(_docs(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, subroots, root and proofs, and their check against rows that
    were tampered with (operator 11)."""
    return merkle.verify(_docs(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score just below an anchor's positives
    (operator 12)."""
    return negatives.mine(read_table(C.prepare(spark), sf_dir, "embeddings"))


def op13_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores by weak supervision (operator 13)."""
    return toxicity.classify(_docs(spark, sf_dir), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_array": op2_suffix_array,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nbsvm_quality": op5_nbsvm_quality,
    "op6_language_id": op6_language_id,
    "op7_minhash": op7_minhash,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_bit_planes": op9_bit_planes,
    "op10_host_rules": op10_host_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_weak_toxicity": op13_weak_toxicity,
}

#: Operators 2, 3, 5, 6, 8, 9 and 13 have none: see README and tests/llm.
SQL = dict(oracle.SQL)
