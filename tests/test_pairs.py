"""Frequent pairs, co-imports (J11) and module grouping."""

import collections
import itertools
import random

import pytest

from repolens.operators import pairs as P


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_frequent_pairs_against_all_pairs(spark, block):
    rng = random.Random(2)
    rows = [("p" if b % 2 else "q", b, f"i{rng.randrange(30)}") for b in range(40) for _ in range(rng.choice([1, 2, 5, 40]))]
    want = collections.Counter()
    for (p, _), group in itertools.groupby(sorted(set(rows)), key=lambda r: r[:2]):
        want.update((p, a, b) for a, b in itertools.combinations([r[2] for r in group], 2))
    out = P.frequent_pairs(spark.createDataFrame(rows, "project_id string, basket int, item string").repartition(5), ["project_id", "basket"], "item", 3, ["project_id"], block)
    assert {(r.project_id, r.item_a, r.item_b): r.n for r in out.collect()} == {k: n for k, n in want.items() if n >= 3}


def test_a_large_basket_is_split(spark):
    """Each pair of blocks is a key of its own: no key joins more than two blocks."""
    rows = [(b, f"i{i}") for b in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "basket int, item string").selectExpr("'p' AS project_id", "*")
    out = P.frequent_pairs(df, ["project_id", "basket"], "item", 3, ["project_id"], block=10)
    assert out.count() == 60 * 59 // 2


def edges(*groups):
    return [("p", f"{k}/user{i}.ts", t) for k, (n, targets) in enumerate(groups) for i in range(n) for t in targets]


def groups(spark, rows, parts=3):
    made = P.co_imports(spark.createDataFrame(rows, "project_id string, src string, dst string").repartition(parts))
    g, m = P.module_groups(made)
    members = collections.defaultdict(set)
    for r in m.collect():
        members[r.center].add((r.path, r.new_path))
    return {r.center: r.asDict() for r in g.collect()}, members


def test_grouping(spark):
    found, members = groups(spark, edges((3, ["a/cart_item.ts", "b/cart.ts", "c/cart-view.ts"])))
    assert set(found) == {"a/cart_item.ts"}  # three equal stars: the least center
    g = found["a/cart_item.ts"]
    assert (g["files"], g["score"], g["module"], g["target_dir"], g["operations"], g["rank"]) == (3, 6, "cart", "a/cart", 4, 1)
    assert members["a/cart_item.ts"] == {(p, f"a/cart/{p.split('/')[1]}") for p in ("a/cart_item.ts", "b/cart.ts", "c/cart-view.ts")}


def test_no_group(spark):
    assert groups(spark, edges((2, ["a/x.ts", "b/y.ts", "c/z.ts"])))[0] == {}                # imported together twice only
    assert groups(spark, edges((5, ["a/x.ts", "a/y.ts", "a/z.ts"])))[0] == {}                # one folder
    assert groups(spark, edges((5, ["a/x.ts", "b/my-types.ts", "c/z.ts"])))[0] == {}         # a file of types
    assert groups(spark, edges((5, ["a/x.ts", "b/y.ts"])))[0] == {}                          # one partner


def test_overlapping_stars_do_not_hang_on_the_partitioning(spark):
    rng = random.Random(4)
    rows = [("p", f"u{i}", f"d{t % 5}/t{t}.ts") for i in range(40) for t in rng.sample(range(25), 6)]
    results = []
    for parts in (1, 4, 7):
        rng.shuffle(rows)
        found, members = groups(spark, rows, parts)
        results.append((found, members))
        assert 1 <= len(found) <= 3
    assert all(r == results[0] for r in results)
    centers = set(results[0][0])
    assert not any(c != d and c in {p for p, _ in results[0][1][d]} and results[0][0][d]["rank"] < results[0][0][c]["rank"] for c in centers for d in centers)
