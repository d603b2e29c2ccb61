"""Scoring profiles on the part graph (D3): project languages from file
extensions, no frameworks, not a monorepo (no manifests in the data)."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.functions import paths as P
from repolens.functions.core import round6
from repolens.operators import profiles as PR, score
from repolens.plans.scoring import findings
from repolens.session import materialize

# Override used by the registered weight-merge query (user config).
OVERRIDE = {"coupling": 0.5}


def _projects(spark, base):
    _, f = adapters.part_graph(spark, base)
    langs = (f.select("project_id", P.language(F.col("path")).alias("language"))
             .where(F.col("language") != "Unknown").groupBy("project_id")
             .agg(F.sort_array(F.collect_set("language")).alias("languages")))
    return langs.select("project_id", F.array().cast("array<string>").alias("frameworks"), "languages",
                        F.lit(False).alias("is_monorepo"), F.lit(None).cast("string").alias("explicit_profile"))


def _pub(df):
    return df.select("project_id", "profile", *[round6(c).alias(c) for c in PR._W + PR._T])


def q_resolve(spark, base):
    return _pub(PR.resolve_profile(_projects(spark, base)))


def _overrides(spark, projects):
    cols = ("modularity", "coupling", "cohesion", "layering")
    return projects.select("project_id", *[F.lit(OVERRIDE.get(c)).cast("double").alias(c) for c in cols])


def q_merge(spark, base):
    pr = _projects(spark, base)
    return _pub(PR.merge_weights(PR.resolve_profile(pr), _overrides(spark, pr)))


def q_profile_score(spark, base):
    e, f = adapters.part_graph(spark, base)
    e, f = materialize(e), materialize(f)
    prof = PR.resolve_profile(_projects(spark, base)).drop("profile")
    return score.score(e, f, findings(e), profiles=prof)


QUERIES = {
    "b06_resolve_profile": q_resolve,
    "b07_merge_weights": q_merge,
    "b06_profile_score": q_profile_score,
}


def _profile_values():
    rows = []
    for n, w, t, _, _ in PR.PROFILES:
        rows.append("(" + ", ".join([O.lit(n)] + [O.d(float(x)) for x in list(w) + list(t)]) + ")")
    return ("prof(profile, " + ", ".join(PR._W + PR._T) + ") AS (VALUES " + ", ".join(rows) + ")")


_LANG = None


def _sql():
    from repolens.plans.structure import lang_sql
    from repolens.plans.graphs import SCC_SQL
    from repolens.plans.scoring import FINDINGS, METRICS_SQL, shotgun_sql
    pj = f"""pl AS (SELECT DISTINCT project_id, {lang_sql('path')} AS language FROM files),
pj AS (SELECT project_id, bool_or(lower(language) = 'go') AS has_go, bool_or(lower(language) = 'python') AS has_py
       FROM pl WHERE language <> 'Unknown' GROUP BY 1),
rp AS (SELECT project_id, CASE WHEN has_py THEN 'data-pipeline' ELSE 'default' END AS profile FROM pj),
{_profile_values()},
rprof AS (SELECT rp.project_id, prof.* FROM rp JOIN prof ON prof.profile = rp.profile)"""
    pub = "project_id, profile, " + ", ".join(f"{O.r6(c)} AS {c}" for c in PR._W + PR._T)
    ov = {c: OVERRIDE.get(c) for c in ("modularity", "coupling", "cohesion", "layering")}
    merged = ", ".join(f"{O.d(ov[c]) if ov[c] is not None else 'w_' + c} AS w_{c}"
                       for c in ("modularity", "coupling", "cohesion", "layering"))
    s = "(w_modularity + w_coupling + w_cohesion + w_layering)"
    norm = ", ".join(f"CASE WHEN {s} > 0 AND abs({s} - 1.0) > {O.d(0.001)} THEN w_{c} / {s} ELSE w_{c} END AS w_{c}"
                     for c in ("modularity", "coupling", "cohesion", "layering"))
    th = lambda c: f"t.{c}"
    mod = (f"CASE WHEN files = 0 THEN 50 WHEN edges / files < {th('modularity_excellent')} THEN 100 "
           f"WHEN edges / files < ({th('modularity_excellent')} + {th('modularity_good')}) / 2 THEN 85 "
           f"WHEN edges / files < {th('modularity_good')} THEN 70 WHEN edges / files < {th('modularity_good')} * 1.5 THEN 50 ELSE 30 END")
    r = "(max_degree / greatest(files - 1, 1))"
    coup = (f"CASE WHEN files <= 1 THEN 50 WHEN {r} < {th('coupling_excellent')} THEN 100 "
            f"WHEN {r} < ({th('coupling_excellent')} + {th('coupling_good')}) / 2 THEN 85 WHEN {r} < {th('coupling_good')} THEN 75 "
            f"WHEN {r} < {th('coupling_good')} * 1.5 THEN 65 WHEN {r} < {th('coupling_good')} * 2 THEN 50 "
            f"WHEN {r} < {th('coupling_good')} * 2.5 THEN 35 ELSE 20 END")
    h = "(internal_edges / edges)"
    coh = (f"CASE WHEN edges = 0 THEN 50 WHEN {h} > {th('cohesion_excellent')} THEN 100 "
           f"WHEN {h} > ({th('cohesion_excellent')} + {th('cohesion_good')}) / 2 THEN 85 WHEN {h} > {th('cohesion_good')} THEN 75 "
           f"WHEN {h} > {th('cohesion_good')} * 0.7 THEN 65 WHEN {h} > {th('cohesion_good')} * 0.3 THEN 50 ELSE 30 END")
    from repolens.plans.scoring import LAY_SQL
    lay = LAY_SQL.replace("lv", "coalesce(lvs.lv, 0)")
    body = (SCC_SQL + ",\n" + shotgun_sql() + ",\n" + FINDINGS + ",\n" + METRICS_SQL
            + ",\n" + pj + f""",
p AS (SELECT m.project_id, files, edges, {mod} AS modularity, {coup} AS coupling, {coh} AS cohesion, {lay} AS layering,
             w_modularity, w_coupling, w_cohesion, w_layering
      FROM m LEFT JOIN lvs ON lvs.project_id = m.project_id LEFT JOIN rprof t ON t.project_id = m.project_id)
SELECT project_id, CAST(files AS BIGINT) AS files, CAST(edges AS BIGINT) AS edges, CAST(modularity AS BIGINT) AS modularity,
       CAST(coupling AS BIGINT) AS coupling, CAST(cohesion AS BIGINT) AS cohesion, CAST(layering AS BIGINT) AS layering,
       CAST(least(greatest(floor(modularity * w_modularity + coupling * w_coupling + cohesion * w_cohesion
            + layering * w_layering + 0.5), 0), 100) AS BIGINT) AS overall FROM p""")
    return {
        "b06_resolve_profile": O.with_views(O.PART_GRAPH, pj + f"\nSELECT {pub} FROM rprof"),
        "b07_merge_weights": O.with_views(O.PART_GRAPH, pj + f""",
mg AS (SELECT project_id, profile, {merged}, {', '.join(PR._T)} FROM rprof),
nm AS (SELECT project_id, profile, {norm}, {', '.join(PR._T)} FROM mg)
SELECT {pub} FROM nm"""),
        "b06_profile_score": "WITH RECURSIVE " + O.PART_GRAPH + ",\n" + body,
    }


SQL = _sql()
