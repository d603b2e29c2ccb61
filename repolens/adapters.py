"""Test-data adapters: library inputs built from the driver's tables.

The given tables hold no source trees or commit logs, so these views map
them onto the library's schemas (see SURVEY section 7.2).  They only shape
rows; all analysis happens in the operators.  The same views are written as
SQL in ``repolens.oracle`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.session import materialize, read_table


def _t(spark: SparkSession, base: str, name: str) -> DataFrame:
    return read_table(spark, base, name)


def _geo(spark: SparkSession, base: str) -> DataFrame:
    """nation x region (25 rows by definition of the schema: safe to broadcast)."""
    n = _t(spark, base, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _t(spark, base, "region").select("r_regionkey", "r_name")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


def supplier_paths(spark: SparkSession, base: str) -> DataFrame:
    """(s_suppkey, path) with path = region/nation/s<key>.ts."""
    s = _t(spark, base, "supplier").select("s_suppkey", "s_nationkey")
    g = _geo(spark, base)
    return s.join(F.broadcast(g), s.s_nationkey == g.n_nationkey).select(
        "s_suppkey",
        F.concat_ws("/", "r_name", "n_name",
                    F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".ts"))).alias("path"))


def order_projects(spark: SparkSession, base: str) -> DataFrame:
    """(o_orderkey, project_id) with project = customer region + '-' + order year."""
    o = _t(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = _t(spark, base, "customer").select("c_custkey", "c_nationkey")
    g = _geo(spark, base)
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(F.broadcast(g), F.col("c_nationkey") == g.n_nationkey)
            .select("o_orderkey",
                    F.concat(F.col("r_name"), F.lit("-"),
                             F.year(F.col("o_orderdate").cast("timestamp")).cast("string"))
                    .alias("project_id")))


def _project_lines(spark: SparkSession, base: str) -> DataFrame:
    li = _t(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return li.join(order_projects(spark, base), li.l_orderkey == F.col("o_orderkey")).select(
        "project_id", "l_orderkey", "l_linenumber", "l_suppkey")


def supplier_graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """D3p: (edges, files) of the supplier graph, one project per region-year.

    An edge joins the suppliers of consecutive line numbers of one order.
    Files are all suppliers seen in the project's orders.  The lines with
    their projects are written once for both; a next line needs no project of
    its own, it has that of its order.
    """
    lines = materialize(_project_lines(spark, base))
    a = lines.select("project_id", "l_orderkey", (F.col("l_linenumber") + 1).alias("ln"),
                     F.col("l_suppkey").alias("sa"))
    b = _t(spark, base, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
                                           F.col("l_suppkey").alias("sb"))
    pairs = (a.join(b, (a.l_orderkey == b.ok) & (a.ln == b.ln))
             .select("project_id", "sa", "sb").distinct())
    sp = supplier_paths(spark, base)
    spa = sp.select(F.col("s_suppkey").alias("sa"), F.col("path").alias("src"))
    spb = sp.select(F.col("s_suppkey").alias("sb"), F.col("path").alias("dst"))
    edges = (pairs.join(spa, "sa").join(spb, "sb")
             .select("project_id", "src", "dst", F.lit("import").alias("type"),
                     F.lit(1.0).alias("weight")))
    files = (lines.select("project_id", F.col("l_suppkey").alias("sa")).distinct()
             .join(spa, "sa").select("project_id", F.col("src").alias("path")))
    return edges, files


def newest_change(spark: SparkSession, base: str):
    """Time of the newest change, from the orders alone."""
    o = _t(spark, base, "orders")
    return o.agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("m")).first()["m"]


def file_changes(spark: SparkSession, base: str, start=None, end=None) -> DataFrame:
    """One row per (order, supplier) as a file change; with ``start`` and
    ``end``, of the orders between them (a filter on the orders' scan).

    project = 'status-' + order status, commit = order, author = customer,
    ts = order date, path = region/nation/s<key>, additions = summed
    quantity, deletions = number of lines.
    """
    li = _t(spark, base, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = _t(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    if start is not None:
        kind = o.schema["o_orderdate"].dataType
        o = o.where(F.col("o_orderdate").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    s = _t(spark, base, "supplier").select("s_suppkey", "s_nationkey")
    g = _geo(spark, base)
    sp = s.join(F.broadcast(g), s.s_nationkey == g.n_nationkey).select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
        .alias("path"))
    if start is not None:  # the period's lines only, before they are grouped
        li = li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    per = li.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum("l_quantity").cast("bigint").alias("additions"),
        F.count(F.lit(1)).cast("bigint").alias("deletions"))
    return (per.join(o, per.l_orderkey == o.o_orderkey).join(sp, "l_suppkey")
            .select(F.concat(F.lit("status-"), F.col("o_orderstatus")).alias("project_id"),
                    F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("commit_id"),
                    F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"),
                    F.col("o_orderdate").cast("timestamp").alias("ts"),
                    "path", "additions", "deletions"))


# Fixed values of the snapshot adapters.
AP_NAMES = ["Circular Dependency", "God Class", "Shotgun Surgery", "Leaky Abstraction", "Feature Envy"]
AP_SEVERITY = {"Circular Dependency": "HIGH", "God Class": "CRITICAL", "Shotgun Surgery": "HIGH",
               "Leaky Abstraction": "MEDIUM", "Feature Envy": "MEDIUM"}
DECISION_STATUS = ["proposed", "accepted", "deprecated", "superseded"]


def _events(spark: SparkSession, base: str) -> DataFrame:
    e = _t(spark, base, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                    F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint").alias("k"))


def analyses(spark: SparkSession, base: str) -> DataFrame:
    """One stored analysis per event; project = user."""
    e = _events(spark, base)
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("analysis_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project_id"),
        "ts",
        F.least(F.lit(100.0), v).alias("overall"),
        F.least(F.lit(100.0), v + 10).alias("modularity"),
        (v % 100).alias("coupling"),
        F.least(F.lit(100.0), v * 0.5).alias("cohesion"),
        F.col("k").cast("double").alias("layering"),
        (F.col("k") + 10).cast("bigint").alias("nodes"),
        (F.col("k") * 3).cast("bigint").alias("edges"))


def anti_patterns(spark: SparkSession, base: str) -> DataFrame:
    """1 to 3 anti-pattern rows per stored analysis."""
    e = _events(spark, base)
    names = F.array(*[F.lit(n) for n in AP_NAMES])
    sev = F.create_map(*[x for k, v in AP_SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    x = e.select("event_id", "k", F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("k") % 3)).alias("i"))
    name = F.element_at(names, ((F.col("k") + F.col("i")) % 5 + 1).cast("int"))
    loc = F.concat(F.lit("src/m"), ((F.col("k") + F.col("i")) % 7).cast("string"), F.lit("/f"),
                   (F.col("k") % 11).cast("string"), F.lit(".ts"))
    return (x.select(F.col("event_id").alias("analysis_id"), name.alias("name"), loc.alias("location"))
            .select("analysis_id", "name", sev[F.col("name")].alias("severity"), "location",
                    F.concat(F.col("name"), F.lit(" at "), F.col("location")).alias("description")))


def projects(spark: SparkSession, base: str, half: str | None = None) -> DataFrame:
    """Project records from events per user.  ``half`` = 'old' / 'new' keeps
    the events before / from the 16th of the month (two upsert batches)."""
    e = _events(spark, base)
    if half == "old":
        e = e.where(F.dayofmonth("ts") < 16)
    elif half == "new":
        e = e.where(F.dayofmonth("ts") >= 16)
    return e.groupBy("user_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.sort_array(F.collect_set("event_type")).alias("languages"),
        F.count(F.lit(1)).cast("bigint").alias("total_files"),
        F.sum(F.floor("value")).cast("bigint").alias("total_lines"),
        F.max("k").alias("kmax")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project_id"),
        F.concat(F.lit("/repos/u"), F.col("user_id").cast("string")).alias("path"),
        F.concat(F.lit("project-"), F.col("user_id").cast("string"), F.lit("-"),
                 F.col("kmax").cast("string")).alias("name"),
        "languages", F.array().cast("array<string>").alias("frameworks"),
        "total_files", "total_lines", "created_at", "updated_at")


def decisions(spark: SparkSession, base: str) -> DataFrame:
    """Decision records: every signup event updates decision adr-<k % 4>."""
    e = _events(spark, base).where(F.col("event_type") == "signup")
    st = F.array(*[F.lit(s) for s in DECISION_STATUS])
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project_id"),
        F.concat(F.lit("adr-"), (F.col("k") % 4).cast("string")).alias("decision_id"),
        F.concat(F.lit("ADR "), (F.col("k") % 4).cast("string")).alias("title"),
        F.element_at(st, (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
        F.col("ts").alias("updated_at"), F.col("event_id").alias("record_id"))


def code_files(spark: SparkSession, base: str) -> DataFrame:
    """Source files with code text, one project per supplier region.

    ``src/<nation>/supplier_<key>.ts`` holds a header, one import per part
    it ships in a line with quantity > 25 (``../parts/p<part>``), an import
    of ``fs``, an import of a missing ``./helpers`` when its account balance
    is negative, and one body line per line item: a public method (returned,
    line 1), an arrow member (accepted, line 2), an ``export Impl_`` line
    (discount >= 0.09) or a comment.  ``src/parts/p<part>.ts`` holds two
    export lines per part used in the region.
    """
    li = _t(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_quantity", "l_discount", "l_returnflag")
    s = _t(spark, base, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    g = _geo(spark, base)
    sup = s.join(F.broadcast(g), s.s_nationkey == g.n_nationkey).select(
        "s_suppkey", "s_name", "s_acctbal", F.col("r_name").alias("project_id"),
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("n_name", " ", "_")), F.lit("/supplier_"),
                 F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("path"))
    items = li.join(sup, li.l_suppkey == sup.s_suppkey)
    o, ln, pk = (F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                 F.col("l_partkey").cast("string"))
    q = F.col("l_quantity").cast("bigint").cast("string")
    body = (F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1),
                   F.concat(F.lit("  public ship"), o, F.lit("x"), ln, F.lit("(q) { return "), q, F.lit("; }")))
            .when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 2),
                  F.concat(F.lit("  handle"), o, F.lit("x"), ln, F.lit(" = (e) => e;")))
            .when(F.col("l_discount") >= 0.09, F.concat(F.lit("export Impl_"), o, F.lit("x"), ln, F.lit(";")))
            .otherwise(F.concat(F.lit("  // item "), o, F.lit("-"), ln, F.lit(" part "), pk, F.lit(" qty "), q)))
    imp = F.concat(F.lit("import { P"), pk, F.lit(" } from '../parts/p"), pk, F.lit("';"))

    def row(sec, k1, k2, line):
        return F.struct(F.lit(sec).alias("sec"), k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2"),
                        line.alias("line"))

    # One pass over the supplier's items (bounded: a supplier ships a fixed
    # number of line items per scale unit): body lines and the set of imports.
    per_file = items.groupBy("project_id", "path").agg(
        F.max("s_name").alias("s_name"), F.max("s_acctbal").alias("s_acctbal"),
        F.collect_list(row(2, F.col("l_orderkey"), F.col("l_linenumber"), body)).alias("body"),
        F.collect_set(F.when(F.col("l_quantity") > 25, row(1, F.col("l_partkey"), F.lit(0), imp))).alias("imps"))
    head = F.array(row(0, F.lit(0), F.lit(0), F.concat(F.lit("// supplier "), F.col("s_name"))),
                   row(1, F.lit(-2), F.lit(0), F.lit("import fs from 'fs';")),
                   row(1, F.lit(-1), F.lit(0), F.when(F.col("s_acctbal") < 0,
                                                      F.lit("import { helper } from './helpers';"))))
    all_lines = F.filter(F.concat(head, F.col("imps"), F.col("body")), lambda x: x["line"].isNotNull())
    sup_files = per_file.select("project_id", "path", F.array_join(
        F.transform(F.sort_array(all_lines), lambda x: x["line"]), "\n").alias("content"))
    p = _t(spark, base, "part").select("p_partkey", "p_name")
    used = items.select("project_id", F.col("l_partkey").alias("p_partkey")).distinct()
    part_files = used.join(p, "p_partkey").select(
        "project_id",
        F.concat(F.lit("src/parts/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"),
        F.concat(F.lit("export const P"), F.col("p_partkey").cast("string"), F.lit(" = '"), F.col("p_name"),
                 F.lit("';\nexport function price"), F.col("p_partkey").cast("string"),
                 F.lit("() { return 1; }")).alias("content"))
    return sup_files.unionByName(part_files)


# Fixed values of the part-graph adapter: directory and extension by key.
PART_DIRS = ["api", "routes", "services", "entities", "config", "components", "lib", "tests"]
PART_EXTS = [".ts", ".js", ".tsx", ".py", ".java"]


def part_paths(spark: SparkSession, base: str) -> DataFrame:
    p = _t(spark, base, "part").select("p_partkey", "p_brand")
    dirs = F.array(*[F.lit(d) for d in PART_DIRS])
    exts = F.array(*[F.lit(e) for e in PART_EXTS])
    return p.select("p_partkey", F.concat(
        F.regexp_replace("p_brand", "#", ""), F.lit("/"),
        F.element_at(dirs, (F.col("p_partkey") % len(PART_DIRS) + 1).cast("int")), F.lit("/"),
        F.when(F.col("p_partkey") % 40 == 0, F.lit("index"))
        .otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))),
        F.element_at(exts, (F.col("p_partkey") % len(PART_EXTS) + 1).cast("int"))).alias("path"))


def part_graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """D3: (edges, files) of the part graph; project = order year-month.

    Parts with a key divisible by 40 share their directory's ``index<ext>``
    file, so the graph has barrel files.

    An edge joins the parts of consecutive line numbers of one order; files
    are all parts ordered in that month.
    """
    li = _t(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = _t(spark, base, "orders").select("o_orderkey", F.date_format(
        F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("month"))
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("m"), F.col("month")).alias("project_id"), "l_orderkey", "l_linenumber", "l_partkey")
    a = lines.select("project_id", "l_orderkey", (F.col("l_linenumber") + 1).alias("ln"),
                     F.col("l_partkey").alias("pa"))
    b = lines.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
                     F.col("l_partkey").alias("pb"))
    pairs = a.join(b, (a.l_orderkey == b.ok) & (a.ln == b.ln)).select("project_id", "pa", "pb")  # made distinct by path
    pp = part_paths(spark, base)
    ppa = pp.select(F.col("p_partkey").alias("pa"), F.col("path").alias("src"))
    ppb = pp.select(F.col("p_partkey").alias("pb"), F.col("path").alias("dst"))
    edges = (pairs.join(ppa, "pa").join(ppb, "pb").select("project_id", "src", "dst").distinct()
             .select("project_id", "src", "dst", F.lit("import").alias("type"), F.lit(1.0).alias("weight")))
    files = (lines.select("project_id", F.col("l_partkey").alias("pa")).distinct()
             .join(ppa, "pa").select("project_id", F.col("src").alias("path")).distinct())
    return edges, files


# Fixed values of the event adapters.
KIND_BY_EVENT_TYPE = {"error": "violation.detected", "view": "analysis.completed", "click": "score.degraded",
                      "signup": "constraint.created", "purchase": "rule.suggested"}
VIOLATION_RULES = ["quality_gates.min_overall_score", "quality_gates.max_critical_anti_patterns",
                   "quality_gates.max_high_anti_patterns", "boundaries.banned_imports"]


def raw_events(spark: SparkSession, base: str) -> DataFrame:
    """Raw event rows (event_id, ts, project_id, kind, value, payload)."""
    e = _t(spark, base, "events")
    m = F.create_map(*[x for k, v in KIND_BY_EVENT_TYPE.items() for x in (F.lit(k), F.lit(v))])
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project_id"),
                    m[F.col("event_type")].alias("kind"), "value", F.col("props").alias("payload"))


def violations(spark: SparkSession, base: str) -> DataFrame:
    """Violation rows from error events: rule by k % 4, level by parity."""
    e = _events(spark, base).where(F.col("event_type") == "error")
    rules = F.array(*[F.lit(r) for r in VIOLATION_RULES])
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project_id"), "ts",
                    F.element_at(rules, (F.col("k") % 4 + 1).cast("int")).alias("rule"),
                    F.when(F.col("k") % 2 == 0, "error").otherwise("warning").alias("level"),
                    F.concat(F.lit("violation "), F.col("k").cast("string")).alias("message"))


def commits(spark: SparkSession, base: str) -> DataFrame:
    """One row per commit of the change log: (project_id, commit_id, ts, churn, files)."""
    return file_changes(spark, base).groupBy("project_id", "commit_id").agg(
        F.min("ts").alias("ts"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"),
        F.count(F.lit(1)).alias("files"))


def package_manifests(spark: SparkSession, base: str) -> DataFrame:
    """One ``package.json`` per region: dependencies = part brands its
    suppliers ship (version ^<distinct parts>.0.0), devDependencies = part
    types (version <distinct suppliers>.0.0)."""
    li = _t(spark, base, "lineitem").select("l_partkey", "l_suppkey")
    p = _t(spark, base, "part").select("p_partkey", "p_brand", "p_type")
    s = _t(spark, base, "supplier").select("s_suppkey", "s_nationkey")
    g = _geo(spark, base)
    x = (li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(g), F.col("s_nationkey") == g.n_nationkey)
         .join(p, F.col("l_partkey") == p.p_partkey)
         .select(F.col("r_name").alias("project_id"), "p_partkey", "l_suppkey",
                 F.lower(F.regexp_replace("p_brand", "#", "-")).alias("brand"),
                 F.lower(F.regexp_replace("p_type", " ", "-")).alias("ptype")))
    deps = x.groupBy("project_id", "brand").agg(F.count_distinct("p_partkey").alias("n")).select(
        "project_id", F.format_string('"%s": "^%d.0.0"', "brand", "n").alias("kv"), F.col("brand").alias("k"))
    devs = x.groupBy("project_id", "ptype").agg(F.count_distinct("l_suppkey").alias("n")).select(
        "project_id", F.format_string('"%s": "%d.0.0"', "ptype", "n").alias("kv"), F.col("ptype").alias("k"))
    def obj(df, name):
        return df.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("k", "kv"))), lambda z: z["kv"]), ", ").alias(name))
    j = obj(deps, "d").join(obj(devs, "v"), "project_id")
    return j.select("project_id", F.lit("package.json").alias("path"),
                    F.concat(F.lit('{"name": "'), F.lower("project_id"), F.lit('", "dependencies": {'), F.col("d"),
                             F.lit('}, "devDependencies": {'), F.col("v"), F.lit("}}")).alias("content"))


# Fixed values of the plan-log adapter.
PLAN_RULES = {"1-URGENT": "hub-splitter", "2-HIGH": "barrel-optimizer", "3-MEDIUM": "import-organizer"}
PLAN_TARGETS = 400


def plan_log(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, operations, files) of refactoring plans: project = customer
    nation, step = order (rule by its priority), operation = line item of four
    pieces or more (type by return flag, line number and discount, path by
    part, some spelled in upper case); the files are the parts ordered in the
    project whose key 5 does not divide."""
    o = _t(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = _t(spark, base, "customer").select("c_custkey", "c_nationkey")
    rule = F.create_map(*[x for k, v in PLAN_RULES.items() for x in (F.lit(k), F.lit(v))])[F.col("o_orderpriority")]
    steps = o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("plan-"), F.col("c_nationkey").cast("string")).alias("project_id"),
                                                         F.col("o_orderkey").alias("step_id"), F.coalesce(rule, F.lit("cleanup")).alias("rule"))
    steps = materialize(steps)  # operations and files are joined with them
    li = _t(spark, base, "lineitem").where(F.col("l_quantity") >= 4)
    p = _t(spark, base, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("dir"))
    text = lambda col: F.col(col).cast("string")
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")
    kind = (F.when((flag == "R") & (number % 3 == 1), "MOVE").when((flag == "R") & (number % 3 == 2), "DELETE")
            .when((flag == "N") & (F.col("l_discount") > 0.04), "CREATE").when((flag == "R"), "CREATE").otherwise("MODIFY"))
    target = F.concat(F.lit("src/shared/m"), (F.col("l_partkey") % PLAN_TARGETS).cast("string"), F.lit(".ts"))
    path = (F.when((kind == "CREATE") & (number == 6), target)
            .when(((kind == "CREATE") & (number == 7)) | ((kind == "DELETE") & (number == 5)), F.concat(F.lit("src/draft/o"), text("l_orderkey"), F.lit(".ts")))
            .otherwise(F.concat("dir", F.lit("/"), F.when(F.col("l_tax") >= 0.08, "P").otherwise("p"), text("l_partkey"), F.lit(".ts"))))
    said = (F.when((kind == "MODIFY") & (F.col("l_quantity") > 40), F.concat(F.lit("Update imports after p"), (F.col("l_partkey") + 1).cast("string"), F.lit(".ts moved")))
            .when((kind == "MODIFY") & (F.col("l_discount") < 0.01), F.lit("Extract the shared part")).otherwise(F.concat(F.lit("Line "), number.cast("string"))))
    ops = li.join(p, "l_partkey").join(steps.select("project_id", "step_id"), F.col("l_orderkey") == F.col("step_id")).select(
        "project_id", "step_id", number.cast("bigint").alias("seq"), kind.alias("type"), path.alias("path"),
        F.when(kind == "MOVE", target).alias("new_path"), said.alias("description"))
    seen = _t(spark, base, "lineitem").select("l_orderkey", "l_partkey").join(steps.select("project_id", "step_id"), F.col("l_orderkey") == F.col("step_id"))
    files = (seen.where(F.col("l_partkey") % 5 != 0).select("project_id", "l_partkey").distinct().join(p, "l_partkey")
             .select("project_id", F.concat("dir", F.lit("/p"), text("l_partkey"), F.lit(".ts")).alias("path")))
    return steps, ops, files


# Fixed values of the manifest adapter: the manifest of a project by its
# number, and its dependencies by number; every fourth is for development.
MANIFEST_KINDS = ["package.json", "requirements.txt", "package.json", "go.mod", "pom.xml", "pyproject.toml", "package.json", "Cargo.toml", "Gemfile", "build.gradle",
                  "composer.json", "pubspec.yaml"]
MANIFEST_DEPS = {
    "package.json": ["react", "express", "lodash", "jest", "@modelcontextprotocol/sdk", "typeorm", "left-pad", "eslint", "hono", "vue", "axios", "vitest"],
    "requirements.txt": ["numpy", "pandas", "requests", "pytest", "flask", "scipy", "rich", "mypy", "attrs", "click", "sqlalchemy", "ruff"],
    "pyproject.toml": ["fastapi", "numpy", "httpx", "pytest", "sqlalchemy", "pydantic", "django", "black", "arrow", "jinja2", "uvicorn", "flake8"],
    "go.mod": ["github.com/gin-gonic/gin", "golang.org/x/net", "github.com/spf13/cobra", "github.com/labstack/echo/v4"],
    "pom.xml": ["spring-boot-starter-web", "guava", "jackson-core", "junit"],
    "build.gradle": ["ktor-server", "okhttp", "micronaut-core", "kotest"],
    "Gemfile": ["rails", "pg", "sinatra", "rspec"],
    "Cargo.toml": ["axum", "serde", "tokio", "rocket"],
    "composer.json": ["laravel/framework", "monolog/monolog", "slim/slim", "phpunit/phpunit"],
    "pubspec.yaml": ["flutter", "http", "shelf", "lints"],
}
WORKSPACE_GLOBS = ["packages/*", "services/**", "tools/{alpha,beta}", "libs/core"]
WORKSPACE_DIRS = ["packages/n{n}", "packages/group/n{n}", "services/a/n{n}", "services/n{n}", "tools/alpha", "tools/gamma", "libs/core", "docs/n{n}", "packages/.n{n}"]


def manifest_dependencies(spark: SparkSession, base: str) -> DataFrame:
    """(s_suppkey, kind, i, v): the dependencies of each supplier's project:
    its parts shipped in one piece, by part number modulo twelve."""
    li = _t(spark, base, "lineitem").where((F.col("l_quantity") <= 1) & (F.col("l_linenumber") <= 4)).select("l_suppkey", "l_partkey")
    kinds = F.array(*[F.lit(k) for k in MANIFEST_KINDS])
    return (li.groupBy(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % 12).alias("i")).agg(F.max(F.col("l_partkey") % 9 + 1).alias("v"))
            .withColumn("kind", F.element_at(kinds, (F.col("s_suppkey") % len(MANIFEST_KINDS) + 1).cast("int"))))


def repo_files(spark: SparkSession, base: str) -> DataFrame:
    """(project_id, path, content): a project for each supplier, with its
    manifest and, for every third, a monorepo's root and workspaces."""
    deps = manifest_dependencies(spark, base)
    names = F.create_map(*[x for k, v in MANIFEST_DEPS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    lists = names[F.col("kind")]
    deps = deps.select("s_suppkey", "kind", F.col("i").cast("int").alias("i"), F.col("v").cast("string").alias("v"), lists.alias("names"))
    deps = deps.where(F.col("i") < F.size("names")).withColumn("name", F.get("names", F.col("i")))
    # a fixed number of dependencies: twelve at most
    per = deps.groupBy("s_suppkey", "kind").agg(F.sort_array(F.collect_list(F.struct("i", "name", "v", (F.col("i") % 4 == 3).alias("dev")))).alias("d"))
    s = _t(spark, base, "supplier").select("s_suppkey", "s_name")
    kinds = F.array(*[F.lit(k) for k in MANIFEST_KINDS])
    all_ = s.withColumn("kind", F.element_at(kinds, (F.col("s_suppkey") % len(MANIFEST_KINDS) + 1).cast("int"))).join(per, ["s_suppkey", "kind"], "left")
    all_ = all_.withColumn("d", F.coalesce("d", F.array().cast("array<struct<i:int,name:string,v:string,dev:boolean>>")))
    fmt = F.format_string

    def lines(row, dev=None, sep="\n"):
        kept = F.col("d") if dev is None else F.filter("d", lambda d: d["dev"] == dev)
        return F.array_join(F.transform(kept, row), sep)

    pair = lambda form: lambda d: fmt(form, d["name"], d["v"])
    spaces = F.concat(F.lit('"workspaces": '), F.when(F.col("s_suppkey") % 6 == 0, F.lit('{"packages": ["' + '", "'.join(WORKSPACE_GLOBS) + '"]}'))
                      .otherwise(F.lit('["' + '", "'.join(WORKSPACE_GLOBS) + '"]')), F.lit(", "))
    mono = F.col("s_suppkey") % 3 == 0
    obj = lambda dev, form: F.concat(F.lit("{"), lines(pair(form), dev, ", "), F.lit("}"))
    text = (F.when(F.col("kind") == "package.json", F.concat(F.lit('{"name": "root", '), F.when(mono, spaces).otherwise(""), F.lit('"dependencies": '), obj(False, '"%s": "^%s.1.0"'),
                                                             F.lit(', "devDependencies": '), obj(True, '"%s": "~%s.1"'), F.lit("}")))
            .when(F.col("kind") == "composer.json", F.concat(F.lit('{"require": '), obj(False, '"%s": "^%s.2"'), F.lit(', "require-dev": '), obj(True, '"%s": "^%s.2"'), F.lit("}")))
            .when(F.col("kind") == "requirements.txt", F.concat(F.lit("# pinned\n"), lines(pair("%s==%s.0"))))
            .when(F.col("kind") == "pyproject.toml", F.concat(F.lit('[project]\nname = "x"\ndependencies = [\n'), lines(pair('  "%s>=%s.1",'), False), F.lit("\n]\n\n[project.optional-dependencies]\ndev = [\n"),
                                                              lines(pair('  "%s~=%s.1",'), True), F.lit("\n]\n[tool.black]\nline-length = 99\n")))
            .when(F.col("kind") == "go.mod", F.concat(F.lit("module x\n\nrequire (\n"), lines(pair("\t%s v%s.6.0")), F.lit("\n)\n")))
            .when(F.col("kind") == "pom.xml", F.concat(F.lit("<project><artifactId>x</artifactId><dependencies>"), lines(lambda d: fmt("<dependency><artifactId>%s</artifactId><version>%s.3</version>%s</dependency>", d["name"], d["v"], F.when(d["dev"], "<scope>test</scope>").otherwise("")), sep=""), F.lit("</dependencies></project>")))
            .when(F.col("kind") == "build.gradle", F.concat(F.lit("dependencies {\n"), lines(lambda d: fmt("  %s 'org.x:%s:%s.4'", F.when(d["dev"], "testImplementation").otherwise("implementation"), d["name"], d["v"])), F.lit("\n}\n")))
            .when(F.col("kind") == "Gemfile", F.concat(lines(pair("gem '%s', '~> %s.5'"), False), F.lit("\ngroup :development, :test do\n"), lines(pair("  gem '%s', '~> %s.5'"), True), F.lit("\nend\n")))
            .when(F.col("kind") == "Cargo.toml", F.concat(F.lit('[package]\nname = "x"\n[dependencies]\n'), lines(pair('%s = "%s.7"'), False), F.lit("\n[dev-dependencies]\n"), lines(pair('%s = { version = "%s.7", features = [] }'), True)))
            .otherwise(F.concat(F.lit("name: x\ndependencies:\n"), lines(pair("  %s: ^%s.8.0"), False), F.lit("\ndev_dependencies:\n"), lines(pair("  %s: ^%s.8.0"), True))))
    project = F.concat(F.lit("repo-"), F.col("s_suppkey").cast("string"))
    own = all_.select(project.alias("project_id"), F.col("kind").alias("path"), text.alias("content"))
    roots = all_.where(mono & (F.col("kind") != "package.json")).select(project.alias("project_id"), F.lit("package.json").alias("path"), F.concat(F.lit("{"), spaces, F.lit('"name": "root"}')).alias("content"))
    dirs = F.array(*[F.regexp_replace(F.lit(x), r"\{n\}", (F.col("s_suppkey") % 7).cast("string")) for x in WORKSPACE_DIRS])
    nested = s.where(mono).select(project.alias("project_id"), "s_suppkey", "s_name", F.posexplode(dirs).alias("k", "dir")).select(
        "project_id", F.concat("dir", F.lit("/package.json")).alias("path"),
        F.concat(F.lit("{"), F.when(F.col("k") % 3 != 1, fmt('"name": "w%d", ', F.col("k"))).otherwise(""), F.when(F.col("k") % 2 == 0, F.lit('"version": "1.2.3", ')).otherwise(""),
                 fmt('"description": "%s"}', F.col("s_name"))).alias("content"))
    return own.unionByName(roots).unionByName(nested)


# Fixed values of the application adapter: path by part number; {b} is the
# brand, {n} the part, {m} the part modulo forty.
APP_PATHS = ["src/modules/{b}/x{n}.ts", "app/domain/services/{b}/f{n}.py", "backend/infrastructure/persistence/store{n}.ts", "core/{b}/f{n}.ts", "apps_{b}/views.py",
             "src/main/java/com/acme/{b}/X{n}Controller.java", "App/Http/Controllers/User{n}Controller.php", "cmd/{b}/m{n}.go", "src/lib/utils/f{n}.ts", "{b}/routes/order{m}Router.ts",
             "{b}/routes/auth.ts", "{b}/routes/health_status.ts", "{b}/routes/search{m}.ts", "src/guards/{b}.guard.ts", "{b}/models/customer-order{m}.model.ts",
             "src/{b}/dto/item{m}.dto.test.ts", "{b}/routes/metrics.ts", "{b}/handlers/pay_{m}_handler.go", "src/entities/Index.ts", "{b}/ser{n}vice/customer.entity.ts"]


def app_graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(edges, files) like ``part_graph``, on the paths of an application;
    a file's lines are the sizes of its parts."""
    p = _t(spark, base, "part").select("p_partkey", "p_brand", "p_size")
    path = F.element_at(F.array(*[F.lit(x) for x in APP_PATHS]), (F.col("p_partkey") % len(APP_PATHS) + 1).cast("int"))
    for mark, value in (("{b}", F.lower(F.regexp_replace("p_brand", "#", ""))), ("{n}", F.col("p_partkey").cast("string")), ("{m}", (F.col("p_partkey") % 40).cast("string"))):
        path = F.replace(path, F.lit(mark), value)
    p = p.select("p_partkey", path.alias("path"), "p_size")
    li = _t(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = _t(spark, base, "orders").select("o_orderkey", F.concat(F.lit("m"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM")).alias("project_id"))
    lines = li.join(o, li.l_orderkey == o.o_orderkey).select("project_id", "l_orderkey", "l_linenumber", "l_partkey")
    a = lines.select("project_id", F.col("l_orderkey").alias("ok"), (F.col("l_linenumber") + 1).alias("ln"), F.col("l_partkey").alias("pa"))
    b = lines.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pb"))
    pairs = a.join(b, ["ok", "ln"]).select("project_id", "pa", "pb").distinct()
    edges = (pairs.join(p.select(F.col("p_partkey").alias("pa"), F.col("path").alias("src")), "pa").join(p.select(F.col("p_partkey").alias("pb"), F.col("path").alias("dst")), "pb")
             .groupBy("project_id", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    files = (lines.select("project_id", F.col("l_partkey").alias("p_partkey")).distinct().join(p, "p_partkey")
             .groupBy("project_id", "path").agg(F.sum("p_size").cast("bigint").alias("lines")))
    return edges, files


# Fixed values of the entry-point adapter: path by part number; {m} is the
# part modulo seven.
ENTRY_PATHS = ["src/main.ts", "src/bin/run{m}.ts", "packages/p{m}/src/cli.ts", "tools/manage.py", "main.go", "server.js", "src/cli/x{m}.ts",
               "packages/p{m}/src/bin/x.ts", "app.dart", "src/index.go", "docs/api/page{m}.md", "ui/screen{m}.vue"]


def summary_repos(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(files, nodes) of the suppliers' projects for summaries: the manifests
    of ``repo_files`` with description, keywords and entry points, a readme
    from the document of the same number, and one source path per part
    supplied in one piece, every third that of an entry point."""
    k = F.regexp_extract("project_id", r"(\d+)$", 1).cast("bigint")
    root = F.concat(
        F.when(k % 5 == 0, F.concat(F.lit('"description": " Tools of '), "project_id", F.lit(' ", '))).when(k % 5 == 1, F.lit('"description": "  ", ')).otherwise(""),
        F.when(k % 2 == 0, F.concat(F.lit('"keywords": ["Api", "src", "x", "KW'), (k % 7).cast("string"), F.lit('"], '))).otherwise(""),
        F.when(k % 4 < 2, F.lit('"main": "dist/main.js", ')).otherwise(""),
        F.when(k % 4 == 2, F.lit('"bin": "server.js", ')).when(k % 4 == 3, F.lit('"bin": {"a": "bin/a.js", "b": "bin/b.js"}, ')).otherwise(""))
    size = F.length("path")
    inner = F.concat(F.when(size % 2 == 0, F.lit('"main": "lib/w.js", ')).otherwise(""),
                     F.when(size % 3 == 0, F.lit('"bin": {"w": "bin/w.js"}, ')).when(size % 3 == 1, F.lit('"bin": "cli.js", ')).otherwise(""))
    extra = F.when(F.col("path") == "package.json", root).when(F.col("path").endswith("/package.json"), inner)
    files = repo_files(spark, base)
    files = files.select("project_id", "path", F.when(extra.isNotNull(), F.concat(F.lit("{"), extra, F.substr("content", F.lit(2)))).otherwise(F.col("content")).alias("content"))
    s = _t(spark, base, "supplier").where(F.col("s_suppkey") % 4 != 3).select("s_suppkey", "s_name")
    text = _t(spark, base, "documents").select(F.col("doc_id").alias("s_suppkey"), "text")
    readme = s.join(text, "s_suppkey").select(
        F.concat(F.lit("repo-"), F.col("s_suppkey").cast("string")).alias("project_id"), F.lit("README.md").alias("path"),
        F.concat(F.lit("# "), "s_name", F.lit("\n\n[![build status](https://x/y.svg)](https://x)\n  short line\n"), F.coalesce("text", F.lit(""))).alias("content"))
    li = _t(spark, base, "lineitem").where(F.col("l_quantity") <= 1).select(F.concat(F.lit("repo-"), F.col("l_suppkey").cast("string")).alias("project_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    p = _t(spark, base, "part").select("p_partkey", F.lower(F.regexp_replace("p_brand", "#", "")).alias("brand"))
    n = F.col("p_partkey")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(n / 3) % len(names) + 1).cast("int"))
    path = F.when(n % 3 == 0, pick(ENTRY_PATHS)).otherwise(pick(APP_PATHS))
    for mark, value in (("{b}", F.col("brand")), ("{n}", n.cast("string")), ("{m}", (n % 7).cast("string"))):
        path = F.replace(path, F.lit(mark), value)
    nodes = li.join(p, "p_partkey").select("project_id", path.alias("path")).distinct()
    return files.unionByName(readme), nodes
