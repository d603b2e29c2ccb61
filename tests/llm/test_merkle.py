"""Operator 11 against a plain tree, and what its proofs detect."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from repolens.llm import common as C
from repolens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, pos int, digest string, `a.b` int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        run = at - at % 3
        yield "".join(level[run:at]), "".join(level[at + 1:run + 3])
        at //= 3


def plain(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)]"""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = [levels([leaf(r, r[4]) for r in groups[s]]) for s in names]
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*siblings(trees[k], i), *siblings(top, k)]
            cut = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[4].replace("\n", "") if cut else r[4])
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=str)


def table(spark, rows, parts=3):
    C.prepare(spark)
    return spark.createDataFrame([(*r, "k", i, "d", i) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a\nb", "ü\n\n", "plain", "x" * 50_000, "línea\n" * 30])
    out = [(rng.randint(-n, 4 * n), rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, 0, 7, -3]), text()) for _ in range(n)]
    out += out[:5] + [out[0]] * 4 + [(None, out[0][1], "en", 1, "null id\n"), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n, sources", [(0, ["a"]), (90, ["a", None, "", "Z", "é", "b", "\U0001f600", "￮"]), (700, ["hot"] * 30 + ["b", None])])
def test_against_a_plain_tree(spark, n, sources):
    rows = rows_of(n, sources) if n else [(5, "one", "en", 1, "a\nb")]
    got = sorted((tuple(r) for r in merkle.verify(table(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_many_sources(spark):
    rows = [(i, f"s{i % 250}", "en", i, f"t{i}\n") for i in range(400)]
    got = sorted((tuple(r) for r in merkle.verify(table(spark, rows)).collect()), key=str)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_nothing_has_no_root(spark):
    assert merkle.verify(table(spark, rows_of(9, ["a"])).limit(0)).count() == 0


def test_a_changed_row_is_found(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(300)]
    docs = table(spark, rows)
    same = merkle.verify(docs, changed=F.col("text"))
    assert same.filter("verified").count() == 300
    one = merkle.verify(docs, changed=F.when(F.col("doc_id") == 77, F.lit("other")).otherwise(F.col("text")))
    assert [r.doc_id for r in one.filter("not verified").collect()] == [77]


def test_each_block_of_a_source_is_small(spark):
    rows = table(spark, rows_of(700, ["hot"])).select("source", "doc_id", merkle.leaf().alias("leaf"))
    scratch = C.Scratch(spark)
    leaves = rows.select(merkle.ordered_key(F.col("source")).alias("key"), F.col("leaf").alias("digest"), "doc_id")
    made = merkle.tree(merkle.numbered(leaves, ["doc_id", "digest"], scratch), ["doc_id"], scratch)
    assert len(made.tiers) == 2
    assert made.tiers[0].agg(F.max(F.size("entries"))).first()[0] == merkle.BLOCK
    assert made.roots().count() == 2
