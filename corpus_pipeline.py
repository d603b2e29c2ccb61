"""A training-data pipeline over ``documents``: language identification,
MinHash near-duplicates, suffix-array deduplication, benchmark decontamination
and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between two
stages the rows are written as Parquet and read again.  All stages but the
last return the columns of their input.

Defined results are those of the operators: texts that are null or have no
letter leave in the first stage; of near-duplicates (and repeated rows) the
first stays; an empty table passes through as such; extra columns are carried
to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import common, decontam, langid, minhash, packing, suffix
from repolens.session import read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without one (``und``) go."""
    common.prepare(spark)
    return langid.identify(docs, carry=True).filter("lang_pred != 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (5-word shingles,
    similarity 0.8 or more) stays."""
    common.prepare(spark)
    return minhash.representatives(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier are cut out of the texts."""
    common.prepare(spark)
    return suffix.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.prepare(spark)
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids along a Hilbert curve."""
    common.prepare(spark)
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: Hashing, learning and token ids cannot be expressed in SQL; tests/llm holds
#: the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.put(out)
    return docs
