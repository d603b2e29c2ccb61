"""Consistency checks of a refactoring plan.

``steps``: (project_id, step_id, rule); ``ops``: (project_id, step_id, seq,
type, path, new_path, description), type one of CREATE, MODIFY, MOVE, DELETE;
``files``: (project_id, path) of the project, optional.  Steps run by step_id.

Every check is an aggregate per path or step and equi-joins on them: a plan is
never gathered, whatever its length.  Sorts for them begin with a number, the
step or ``by_path``: few projects and common folders tell rows apart too late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.core import basename, parent_dir
from repolens.operators.substrings import containing
from repolens.session import materialize

COLS = ["project_id", "category", "kind", "severity", "step_id", "path", "other_step", "n"]


def _issues(df: DataFrame, category: str, kind: str, severity, other=None, n=None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    long = lambda c: (F.lit(None) if c is None else c).cast("bigint")
    path = F.col("path") if "path" in df.columns else F.lit(None).cast("string")
    return df.select("project_id", F.lit(category).alias("category"), F.lit(kind).alias("kind"), severity.alias("severity"),
                     F.col("step_id").cast("bigint").alias("step_id"), path.alias("path"), long(other).alias("other_step"), long(n).alias("n"))


def by_path(df: DataFrame) -> DataFrame:
    """``df`` with a number ``_h`` equal for equal project and path."""
    return df.withColumn("_h", F.xxhash64("project_id", "path"))


PATH_KEYS = ["_h", "project_id", "path"]


def normal_path(path: Column) -> Column:
    """A path without ``.`` segments, doubled slashes, backslashes and case:
    equal for names that many file systems take as one."""
    p = F.lower(F.regexp_replace(path, r"[\\/]+", "/"))
    return F.regexp_replace(F.regexp_replace(p, r"(?<=^|/)(?:\./)+", ""), "/$", "")


# ------------------------------------------------------------ order ----
def order_issues(ops: DataFrame) -> DataFrame:
    """Use of a path before the last step that creates it; creation and
    deletion of one path in one step."""
    made = by_path(ops.where(F.col("type") == "CREATE")).groupBy(*PATH_KEYS).agg(F.max("step_id").alias("made_in"))
    early = (by_path(ops.where(F.col("type").isin("MODIFY", "DELETE")).select("project_id", "step_id", "path")).join(made, PATH_KEYS)
             .where(F.col("made_in") > F.col("step_id")))
    both = (ops.where(F.col("type").isin("CREATE", "DELETE")).groupBy("step_id", "project_id", "path")
            .agg(F.max(F.col("type") == "CREATE").alias("made"), F.max(F.col("type") == "DELETE").alias("gone")).where("made and gone"))
    return (_issues(early, "CIRCULAR_OPERATION", "created_later", "ERROR", other=F.col("made_in"))
            .unionByName(_issues(both, "CIRCULAR_OPERATION", "create_and_delete", "ERROR")))


# ---------------------------------------------------------- orphans ----
def mentioned(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(project_id, name) of the names that occur in any text of their project."""
    return containing(texts, names, ["project_id"]).select("project_id", "name").distinct()


def orphan_issues(ops: DataFrame) -> DataFrame:
    """Moved or deleted files without a change that updates their importers:
    neither another file's change in that step that speaks of imports, nor any
    change that names the file.  A path counts by its last move or deletion."""
    last = (by_path(ops.where(F.col("type").isin("MOVE", "DELETE"))).groupBy(*PATH_KEYS)
            .agg(F.max(F.struct("step_id", "seq", "type")).alias("l")).select("project_id", "path", "l.step_id", "l.type"))
    changes = ops.where(F.col("type") == "MODIFY")
    updates = changes.where(F.lower("description").contains("import"))
    of_step = updates.groupBy("step_id", "project_id").agg(F.count(F.lit(1)).alias("all_updates"))
    own = updates.groupBy("step_id", "project_id", "path").agg(F.count(F.lit(1)).alias("own_updates"))
    others = F.coalesce("all_updates", F.lit(0)) - F.coalesce("own_updates", F.lit(0))
    alone = materialize(last.join(of_step, ["step_id", "project_id"], "left").join(own, ["step_id", "project_id", "path"], "left")
                        .where(others == 0).withColumn("name", basename("path")))  # read three times
    named = mentioned(alone, changes.select("project_id", F.col("description").alias("text")))
    lost = alone.join(named, ["name", "project_id"], "left_anti")
    return _issues(lost, "ORPHAN_IMPORT", "no_consumer_update", F.when(F.col("type") == "MOVE", "WARNING").otherwise("INFO"))


# ----------------------------------------------------------- splits ----
def split_issues(steps: DataFrame, ops: DataFrame) -> DataFrame:
    """Steps that split a hub and change no consumer, or not the hub."""
    hub = steps.where(F.col("rule") == "hub-splitter").select("project_id", "step_id")
    low = F.lower("description")
    is_new, is_change = F.col("type") == "CREATE", F.col("type") == "MODIFY"
    mine = (ops.select("project_id", "step_id", parent_dir("path").alias("folder"), is_new.alias("is_new"), is_change.alias("is_change"),
                       (is_change & (low.contains("refactor") | low.contains("extract"))).alias("says"))
            .join(hub, ["step_id", "project_id"], "left_semi"))
    # dealt by step once, by folder and then whole; ``beside``: a change beside a new file, in one folder
    folders = mine.groupBy("step_id", "project_id", "folder").agg(
        F.sum(F.col("is_new").cast("int")).alias("made"), F.sum(F.col("is_change").cast("int")).alias("changed"), F.max("says").alias("says"),
        (F.max("is_new") & F.max("is_change")).alias("beside"))
    per = (folders.groupBy("step_id", "project_id").agg(F.sum("made").alias("made"), F.sum("changed").alias("changed"), F.max("says").alias("says"),
                                                        F.max("beside").alias("beside")).where("made > 0"))
    return (_issues(per.where("changed = 0"), "INCOMPLETE_SPLIT", "no_consumer_change", "ERROR", n=F.col("made"))
            .unionByName(_issues(per.where(~F.coalesce("says", F.lit(False)) & ~F.col("beside")), "INCOMPLETE_SPLIT", "hub_not_changed", "WARNING", n=F.col("made"))))


# ------------------------------------------------------- collisions ----
def collision_issues(ops: DataFrame, fold: bool = False) -> DataFrame:
    """Paths created more than once, targets of several moves, and paths both
    created and moved to; with ``fold`` paths meet by ``normal_path``."""
    key = normal_path if fold else (lambda p: p)
    made = (ops.where(F.col("type") == "CREATE").groupBy("project_id", key(F.col("path")).alias("path"))
            .agg(F.min("step_id").alias("step_id"), F.count(F.lit(1)).alias("times")))
    moved = (ops.where((F.col("type") == "MOVE") & (F.col("new_path") != "")).groupBy("project_id", key(F.col("new_path")).alias("path"))
             .agg(F.min("step_id").alias("move_step"), F.count(F.lit(1)).alias("moves")))
    both = made.join(moved, ["project_id", "path"])
    twice = moved.where("moves > 1").select("project_id", "path", F.col("move_step").alias("step_id"), "moves")
    return (_issues(made.where("times > 1"), "PATH_COLLISION", "created_twice", "ERROR", n=F.col("times"))
            .unionByName(_issues(twice, "PATH_COLLISION", "moved_to_twice", "ERROR", n=F.col("moves")))
            .unionByName(_issues(both, "PATH_COLLISION", "created_and_moved_to", "ERROR", other=F.col("move_step"), n=F.col("moves"))))


# -------------------------------------------------- scope and empty ----
def scope_issues(ops: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of files that the project does not have and the plan does not create."""
    known = files.select("project_id", "path").unionByName(ops.where(F.col("type") == "CREATE").select("project_id", "path"))
    used = ops.where(F.col("type").isin("MODIFY", "DELETE", "MOVE")).select("project_id", "step_id", "path")
    return _issues(by_path(used).join(by_path(known), PATH_KEYS, "left_anti"), "SCOPE_VIOLATION", "unknown_path", "WARNING")


def empty_issues(steps: DataFrame, ops: DataFrame) -> DataFrame:
    return _issues(steps.join(ops.select("project_id", "step_id").distinct(), ["step_id", "project_id"], "left_anti"), "EMPTY_STEP", "no_operation", "WARNING")


def plan_issues(steps: DataFrame, ops: DataFrame, files: DataFrame | None = None, fold: bool = False) -> DataFrame:
    """All issues of all plans, one row each (``COLS``)."""
    parts = [order_issues(ops), orphan_issues(ops), split_issues(steps, ops), collision_issues(ops, fold), empty_issues(steps, ops)]
    if files is not None:
        parts.append(scope_issues(ops, files))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plan_verdicts(steps: DataFrame, issues: DataFrame) -> DataFrame:
    """Per project: issues by severity, and whether the plan is valid (no error)."""
    count = lambda s: F.sum((F.col("severity") == s).cast("int"))
    per = issues.groupBy("project_id").agg(count("ERROR").alias("errors"), count("WARNING").alias("warnings"), count("INFO").alias("infos"))
    out = steps.select("project_id").distinct().join(per, "project_id", "left")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("errors", "warnings", "infos")],
                      (F.coalesce("errors", F.lit(0)) == 0).alias("valid"))
