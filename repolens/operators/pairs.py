"""Pairs of items that occur together (J11), and groups made of them.

``frequent_pairs`` counts unordered pairs of items over baskets (the targets
of an importer, the files of a commit) and keeps those that are frequent.
Items that occur in fewer baskets than a pair needs are dropped first, which
loses nothing.  A basket of more than ``BLOCK`` items is dealt by hash into
blocks, and every pair of blocks is a join key of its own, so the pairs of one
large basket are made by many tasks and none of them gathers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.core import basename, parent_dir

# Fixed values of the grouping rule.
CO_IMPORT_MIN = 3
GROUP_MIN_PARTNERS = 2
GROUP_TOP = 3

#: Items of a block.
BLOCK = 256


def frequent_pairs(baskets: DataFrame, basket: list[str], item: str, least: int, scope: list[str], block: int = BLOCK) -> DataFrame:
    """(scope..., item_a, item_b, n): pairs item_a < item_b that are together
    in ``least`` or more baskets.  ``baskets`` has the columns ``basket``
    (which include ``scope``) and ``item``; repeated rows count once."""
    rows = baskets.select(*basket, F.col(item).alias("_item")).distinct()
    often = rows.groupBy(*scope, "_item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*scope, "_item")
    rows = rows.join(often, [*scope, "_item"], "left_semi")
    size = rows.groupBy(*basket).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    dealt = (rows.join(size, basket).withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
             .withColumn("_own", F.pmod(F.xxhash64("_item"), F.col("_blocks")).cast("int")))
    left = dealt.select(*basket, F.col("_own").alias("_lo"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_hi"), F.col("_item").alias("_x"))
    right = dealt.select(*basket, F.explode(F.sequence(F.lit(0), "_own")).alias("_lo"), F.col("_own").alias("_hi"), F.col("_item").alias("_y"))
    # in a block with itself each pair once, between two blocks every pair
    met = left.join(right, [*basket, "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | (F.col("_x") < F.col("_y")))
    return (met.groupBy(*scope, F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))


# ------------------------------------------------------------ J11 ----
def co_imports(edges: DataFrame, least: int = CO_IMPORT_MIN) -> DataFrame:
    """(project_id, file_a, file_b, n): files that ``least`` or more files
    import together."""
    found = frequent_pairs(edges, ["project_id", "src"], "dst", least, ["project_id"])
    return found.select("project_id", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), F.col("n").cast("bigint").alias("n"))


# ------------------------------------------------------------ R04 ----
def _stars(pairs: DataFrame) -> DataFrame:
    """(project_id, center, member, n), the center itself with n = 0."""
    both = (pairs.select("project_id", F.col("file_a").alias("center"), F.col("file_b").alias("member"), "n")
            .unionByName(pairs.select("project_id", F.col("file_b").alias("center"), F.col("file_a").alias("member"), "n")))
    centers = both.select("project_id", "center", F.col("center").alias("member"), F.lit(0).cast("bigint").alias("n")).distinct()
    return both.unionByName(centers)


def module_groups(pairs: DataFrame, top: int = GROUP_TOP) -> tuple[DataFrame, DataFrame]:
    """(groups, members) suggested from co-import ``pairs``.

    A star is a file with its partners, ``GROUP_MIN_PARTNERS`` or more, not
    all in one folder, and none a file of types.  Stars are ranked by score
    (sum of counts), size and center.  A star counts if no better star holds
    its center: that choice needs no order of visiting, so it is the same
    under any partitioning.  The ``top`` of a project are kept.

    groups: (project_id, center, files, score, module, target_dir, priority,
    operations, rank); members: (project_id, center, path, new_path)."""
    stars = _stars(pairs)
    low = F.lower("member")
    typed = low.contains("types") | low.contains("interface")
    per = (stars.groupBy("project_id", "center")
           .agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("score"), F.min(parent_dir("member")).alias("d0"), F.max(parent_dir("member")).alias("d1"), F.max(typed).alias("typed"))
           .where((F.col("files") > GROUP_MIN_PARTNERS) & (F.col("d0") != F.col("d1")) & ~F.col("typed"))
           .select("project_id", "center", "files", "score"))
    # the best star that holds each file; struct order: score, size, then the least center
    held = stars.select("project_id", "center", "member").join(per, ["project_id", "center"])
    order = F.struct((-F.col("score")).alias("s"), (-F.col("files")).alias("f"), F.col("center").alias("c"))
    best = held.groupBy("project_id", "member").agg(F.min(order).alias("best"))
    own = per.join(best.select("project_id", F.col("member").alias("center"), F.col("best.c").alias("best_center")), ["project_id", "center"])
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), F.desc("files"), "center"))
    kept = own.where(F.col("best_center") == F.col("center")).withColumn("rank", rank).where(F.col("rank") <= top).drop("best_center")

    # the first part of the center's name that all its files' names hold
    inside = stars.join(kept.select("project_id", "center", "files"), ["project_id", "center"])
    name = lambda c: F.lower(F.regexp_replace(basename(c), r"\.[^.]+$", ""))
    parts = inside.select("project_id", "center", "files", "member", F.posexplode(F.split(name("center"), "[_-]")).alias("at", "part"))
    shared = (parts.where(name("member").contains(F.col("part"))).groupBy("project_id", "center", "at", "part", "files").agg(F.count(F.lit(1)).alias("in_files"))
              .where("in_files = files").groupBy("project_id", "center").agg(F.min(F.struct("at", "part")).alias("p")).select("project_id", "center", "p.part"))
    groups = kept.join(shared, ["project_id", "center"], "left").withColumn("module", F.coalesce("part", F.lit("shared")))
    folder = F.when(parent_dir("center") == "", ".").otherwise(parent_dir("center"))
    groups = groups.select("project_id", "center", F.col("files").cast("bigint").alias("files"), F.col("score").cast("bigint").alias("score"), "module",
                           F.concat(folder, F.lit("/"), F.col("module")).alias("target_dir"), F.lit("MEDIUM").alias("priority"),
                           (F.col("files") + 1).cast("bigint").alias("operations"), F.col("rank").cast("bigint").alias("rank"))
    members = (stars.select("project_id", "center", F.col("member").alias("path")).join(groups.select("project_id", "center", "target_dir"), ["project_id", "center"])
               .select("project_id", "center", "path", F.concat("target_dir", F.lit("/"), basename("path")).alias("new_path")))
    return groups, members
