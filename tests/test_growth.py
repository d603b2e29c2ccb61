"""Steps whose cost has to grow with the input alone, on rows built here."""

from pyspark.sql import functions as F

from repolens.operators import forecast


# ------------------------------------------------------------ H18/H20 ----
def _walked(signals, cur, alpha=0.3):
    """Scores week by week, as the definition says."""
    mean = sum(signals) / len(signals)
    raw = [cur]
    for s in reversed(signals[1:]):
        raw.append(min(100.0, max(0.0, raw[-1] + min(3.0, max(-3.0, (s - mean) * 3.0)))))
    raw.reverse()
    out = [raw[0]]
    for v in raw[1:]:
        out.append(alpha * v + (1 - alpha) * out[-1])
    return out


def test_reconstruct_long_series(spark):
    """A series of 100,000 weeks is walked in blocks: the fold over whole
    arrays copied it once per week."""
    n = 100_000
    signal = F.when(F.floor(F.col("id") / 150) % 2 == 0, 0.9).otherwise(0.1) + (F.col("id") * 7919 % 1000) / 10_000.0
    f = spark.range(n).select(F.lit("p").alias("project_id"), F.col("id").alias("week_offset"), F.round(signal, 3).alias("complexity_signal"))
    got = {r["week_offset"]: r["score"] for r in forecast.reconstruct_scores(f, 61.5).collect()}
    want = _walked([r["complexity_signal"] for r in f.orderBy("week_offset").collect()], 61.5)
    assert min(want) < 1 and max(want) > 99 and len(got) == n
    assert all(abs(got[i] - w) <= 0.0500001 for i, w in enumerate(want))


def test_reconstruct_blocks_and_keys(spark):
    """Lengths around the block, gaps between weeks, a key that is null and a
    current score out of bounds."""
    rows, want = [], {}
    for k, n in ((None, 1), ("a", 2), ("b", 256), ("c", 257), ("d", 513), ("e", 700)):
        signals = [((i * 37 + n) % 101) / 100 for i in range(n)]
        rows += [("p", k, 3 * i + 5, s) for i, s in enumerate(signals)]
        want |= {(k, i): w for i, w in enumerate(_walked(signals, 120.0))}
    f = spark.createDataFrame(rows, "project_id string, module string, week_offset long, complexity_signal double")
    cur = spark.createDataFrame([("p", 120.0), ("q", 5.0)], "project_id string, current double")
    got = {(r["module"], r["week_offset"]): r["score"] for r in forecast.reconstruct_scores(f, cur, keys=("project_id", "module")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - w) <= 0.0500001 for k, w in want.items())


def test_module_signals_by_thousands(spark):
    m = spark.createDataFrame([("p", "a", 2500, 10.0, 0.0, 1.0), ("p", "b", 1000, 10.0, 0.0, 1.0), ("p", "c", 1, 1.0, 0.0, 5.0)],
                              "project_id string, module string, commits long, churn double, churn_trend double, avg_weekly_rate double")
    got = {r["module"]: (r["n"], r["lo"], r["hi"], r["d"]) for r in forecast.module_signals(m).groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.min("week_offset").alias("lo"), F.max("week_offset").alias("hi"), F.count_distinct("week_offset").alias("d")).collect()}
    assert got == {"a": (2500, 0, 2499, 2500), "b": (1000, 0, 999, 1000), "c": (1, 0, 0, 1)}


# ------------------------------------------------------------ J08 ----
def test_cycles_by_numbers(spark):
    """Two names in one number: another salt is taken; chains into and out of
    cycles, repeated edges, self-references, null projects."""
    from repolens.operators import cycles
    rows = [("p", f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] * 2 + [("q", "c0", "c1"), ("q", "c1", "c0"), ("q", "c1", "z"), ("q", "z", "z")]
    rows += [("p", "a", "c3"), ("p", "c2", "d"), ("p", "d", "e"), ("p", "e", "d"), ("p", "s", "s"), (None, "n", "n"), (None, "n", "m"), (None, "m", "n"), ("p", None, "c1")]
    edges = spark.createDataFrame(rows, "project_id string, src string, dst string")
    want = {("p", "c0", f"c{i}") for i in range(5)} | {("p", "d", "d"), ("p", "d", "e"), ("q", "c0", "c0"), ("q", "c0", "c1"), ("q", "z", "z"), ("p", "s", "s"), (None, "n", "n")}
    got = [(r["project_id"], r["scc_id"], r["path"]) for r in cycles.scc_members(edges).collect()]
    assert set(got) == want and len(got) == len(want)
    met = []

    def clashing(salt, project, path):
        met.append(1)
        return F.when((salt == 0), F.xxhash64(project)).otherwise(F.xxhash64(salt, project, path))

    e, names, _ = cycles._hashed(edges, clashing)
    assert len(met) == 4 and names.count() == names.select("v").distinct().count() == 11 and e.columns == ["s", "d"]


def test_cycle_rounds_push_what_changed(spark, monkeypatch):
    """A round joins only nodes that changed in the round before, on edges of numbers."""
    from repolens.operators import cycles
    edges = spark.createDataFrame([("p", f"n{i}", f"n{(i + 1) % 6}") for i in range(6)], "project_id string, src string, dst string")
    written = []
    plain = cycles.materialize

    def counted(df):
        out = plain(df)
        written.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(cycles, "materialize", counted)
    assert cycles.scc_members(edges).count() == 6
    fronts = [n for c, n in written if c == ("s", "colour")]
    assert fronts[-1] == 0 and all(n < 6 for n in fronts) and fronts == sorted(fronts, reverse=True)
    assert all(set(c) <= {"v", "s", "d", "i", "o", "colour", "changed"} for c, _ in written[2:-1])


# ------------------------------------------------------------ C09/C12 ----
def test_patterns_look_for_their_first_character(spark):
    """What a match begins with is found for every pattern of the tables, and
    changes no match: odd boundaries, case, accents, empty and null texts."""
    from repolens.functions.core import ascii_regex
    from repolens.operators import corpus as C
    patterns = [C.STACK_PATTERN, C.AUTH_PATTERN, C.DB_PATTERN, C.SCALE_PATTERN, C.PERF_PATTERN, C.ACTOR_PATTERN]
    patterns += [p for p, _ in C.SECURITY_FLAGS + C.COMPLIANCE_FLAGS + C.INTEGRATION_PATTERNS]
    assert all(C.starts(p) for p in patterns)
    assert C.starts(r"\b(x?y|z)") == C.starts(r"\b(\w+|z)") == C.starts(r"\b(?:a|b)") == C.starts("") == ""
    assert C.jci(r"\b(x?y)") == "(?i)" + ascii_regex(r"\b(x?y)")
    texts = ["JWT and jwts", "éjwt jwt", "a.NET x.net .net", "c# C#9", "12 ms, 12ms 7 rps", "auto scaling ReplicaSet", "PCI-DSS pci dss soc 2 SOC2 gdprs GDPR",
             "HTTPS xtls tls_ tls", "postgresql Postgres", "real time realtime WS", "Rest API, event bus", "go-lang golang", "", None, "users USER ſtaff Kafka Kafka"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    same = [F.regexp_extract_all("text", F.lit(C.jci(p)), 0).eqNullSafe(F.regexp_extract_all("text", F.lit("(?i)" + ascii_regex(p)), 0)).alias(f"p{i}") for i, p in enumerate(patterns)]
    assert all(all(r) for r in df.select(*same).collect())


def test_domain_ties_and_nulls(spark):
    from repolens.operators import corpus as C
    df = spark.createDataFrame([(1, "CART and kyc"), (2, "kyc ledger cart"), (3, None), (4, ""), (5, "Tenant")], "doc_id long, text string")
    got = {r["doc_id"]: (r["domain"], r["score"]) for r in C.detect_domain(df).collect()}
    assert got == {1: ("e-commerce", 1), 2: ("fintech", 2), 3: ("general", 0), 4: ("general", 0), 5: ("saas", 1)}


def test_facets_read_the_candidates_once(spark, monkeypatch):
    from repolens.operators import corpus as C
    seen = []
    plain = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: seen.append(df.columns) or plain(df))
    df = spark.createDataFrame([(1, "Order Order Order by jwt")], "doc_id long, text string")
    assert C.requirement_facets(df).first()["entities"] == 1
    assert seen == [["doc_id", "entity", "kind", "n", "place"]]
