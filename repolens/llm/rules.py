"""Operator 10: quality rules with host-level verdicts, in DataFrame functions.

Base rules are counted over each whole text.  Failures are then added up by
host, a host's failure rate is shrunk towards a beta prior fitted to all
hosts' rates by moments, and the verdict on the host joins back to its
documents: documents of hosts whose shrunken rate is above ``host_limit`` go,
as do those that fail the base rules themselves.

Words are ``[^\\x20\\x09-\\x0D]+``.

Defined results: a null or empty text has no words and fails (n_words < 50);
documents without a host get the prior's mean and pass the host rule; repeated
rows count each; with no hosts, or hosts that do not differ more than chance
explains, every rate is the mean; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
#: Strength of the prior (in documents) where hosts do not differ.
MOST_PRIOR = 1e6


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.  Windows are sorted by
    hash; equal neighbours give the repeated places, whose union is counted."""
    def covered(sorted_windows: Column) -> Column:
        places = F.transform(sorted_windows, lambda x, i: F.when(
            (x["h"] == F.get(sorted_windows, i - 1)["h"]) | (x["h"] == F.get(sorted_windows, i + 1)["h"]), x["i"]))
        places = F.sort_array(F.filter(places, lambda p: p.isNotNull()))
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
                           lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")))["n"]

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), covered))


def base(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed) per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = " \t\n\x0b\f\r"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", C.SEPARATOR_CLASS + "+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, blank, "") != "")
    rows = rows.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", blank, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_rates(checked: DataFrame) -> tuple[DataFrame, float]:
    """((host, host_rate), prior mean): failure rates shrunk by a beta prior.

    The prior has the mean m of all documents and the strength k that the
    spread of the hosts' rates beyond binomial noise gives by moments:
    k = m (1 - m) / excess - 1."""
    hosts = (checked.filter(F.col("host").isNotNull()).groupBy("host")
             .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")).first()
    mean = (total["failed"] / total["n"]) if total["n"] else 0.0
    spread = hosts.agg(F.avg((F.col("failed") / F.col("n") - mean) ** 2).alias("seen"),
                       F.avg(mean * (1 - mean) / F.col("n")).alias("chance")).first()
    excess = (spread["seen"] or 0.0) - (spread["chance"] or 0.0)
    strength = MOST_PRIOR if excess <= 0 or not 0 < mean < 1 else min(MOST_PRIOR, max(0.01, mean * (1 - mean) / excess - 1))
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", rate.alias("host_rate")), mean


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """``base`` with host_rate and kept.  The base counts are written once:
    both the hosts' totals and the result read them."""
    checked = C.Scratch(docs.sparkSession).put(base(docs, host))
    rates, mean = host_rates(checked)
    joined = checked.join(rates, "host", "left").withColumn("host_rate", F.coalesce("host_rate", F.lit(mean)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.col("host").isNull() | (F.col("host_rate") <= host_limit))).alias("kept"),
                         "host", F.round("host_rate", 6).alias("host_rate"))
