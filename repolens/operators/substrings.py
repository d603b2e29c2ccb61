"""Which names occur in which texts, without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters by which names and texts meet before ``contains``.
GRAM = 12
#: Separators of names that are told apart; with more of them all are taken as one.
MAX_SEPARATORS = 64


def shapes(names: DataFrame) -> dict[int, str]:
    """Pattern of the keys of each length (at most gram + 1 values): where a
    key of ``names`` (columns ``_key``, ``_size``) can stand in a text.

    If all keys of a length have a character that is no letter, digit or
    underscore, only places with such a character as far behind are cut."""
    head = F.regexp_extract("_key", "(?s)^([A-Za-z0-9_]*)[^A-Za-z0-9_]", 1)
    sep = F.nullif(F.regexp_extract("_key", "[^A-Za-z0-9_]", 0), F.lit(""))
    rows = names.select("_size", sep.alias("sep"), F.length(head).alias("off")).groupBy("_size", "sep").agg(
        F.min("off").alias("lo"), F.max("off").alias("hi")).groupBy("_size").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(F.col("sep").isNull()).alias("plain"),
        F.count("sep").alias("n"), F.slice(F.collect_set("sep"), 1, MAX_SEPARATORS).alias("seps"))
    out = {}
    for r in rows.collect():
        chars = "^A-Za-z0-9_" if r["n"] > MAX_SEPARATORS else "".join(f"\\x{{{ord(c):x}}}" for c in r["seps"])
        near = "" if r["plain"] else f"(?=[A-Za-z0-9_]{{{r['lo']},{r['hi']}}}[{chars}])"
        out[r["_size"]] = f"(?s){near}(?=(.{{{r['_size']}}}))"
    return out


def containing(texts: DataFrame, names: DataFrame, scope: list[str] = (), gram: int = GRAM) -> DataFrame:
    """(scope..., text, name): the pairs whose text holds the name.  ``texts``
    has the column ``text``, ``names`` ``name``, both the columns ``scope``.

    A name's key is its first ``gram`` characters (or all, if fewer).  Texts
    are cut into pieces of the lengths that keys have, at every place where
    one can stand (``shapes``); key and piece are equal where the name may
    stand, and what meets is tested whole."""
    names = names.select(*scope, "name").distinct().withColumn("_size", F.least(F.length("name"), F.lit(gram)))
    keyed = names.withColumn("_key", F.substring(F.col("name"), F.lit(1), F.col("_size")))
    texts = texts.select(*scope, "text").distinct()
    pieces = [F.regexp_extract_all("text", F.lit(p), 1) for p in shapes(keyed).values()]
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *pieces))
    cuts = texts.select(*scope, "text", F.explode(pieces).alias("_key"))
    return keyed.join(cuts, ["_key", *scope]).where(F.col("text").contains(F.col("name"))).select(*scope, "text", "name")
