"""Keywords (P12) and domains (C07): a project per document source, with paths
from the parts and descriptions from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import oracle as O
from repolens.operators import compliance as CP
from repolens.operators import domains as D
from repolens.session import materialize, read_table


def _files(spark, base):
    project = F.concat(F.lit("src"), (F.col("p_partkey") % 24).cast("string"))
    return read_table(spark, base, "part").select(project.alias("project_id"), F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/"), F.lower("p_type"), F.lit("Item-v"), F.col("p_size").cast("string"), F.lit(".test.ts")).alias("path"))


def _keywords(spark, base):
    p, files = read_table(spark, base, "part"), _files(spark, base)
    project = F.concat(F.lit("src"), (F.col("p_partkey") % 24).cast("string"))
    modules = p.select(project.alias("project_id"), F.concat(F.lower("p_type"), F.lit("Store")).alias("module")).distinct()
    docs = read_table(spark, base, "documents")
    meta = docs.select(F.col("source").alias("project_id"), F.concat(F.col("lang"), F.lit("-"), F.col("source")).alias("name"), F.col("text").alias("description"))
    return D.keywords(files, modules, meta)


def q_compliance(spark, base):
    terms = materialize(_keywords(spark, base))
    return CP.compliance(D.classify_domains(terms), terms)


QUERIES = {
    "c08_compliance": q_compliance,
    "c08_integrations": lambda spark, base: CP.integrations(_keywords(spark, base), _files(spark, base)),
    "p12_keywords": _keywords,
    "c07_domains": lambda spark, base: D.classify_domains(materialize(_keywords(spark, base))),
}


def _parts(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[-_./\\\\]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


KEYWORDS = f"""fp AS (SELECT 'src' || CAST(p_partkey % 24 AS VARCHAR) AS project_id, 'src/' || replace(p_name, ' ', '_') || '/' || lower(p_type) || 'Item-v' || CAST(p_size AS VARCHAR) || '.test.ts' AS path FROM part),
sg AS (SELECT project_id, regexp_replace(s, '\\.[^.]+$', '') AS s FROM (SELECT project_id, unnest(string_split(path, '/')) AS s FROM fp) x WHERE lower(s) NOT IN {O.in_list(D.GENERIC_SEGMENTS)}),
md AS (SELECT DISTINCT 'src' || CAST(p_partkey % 24 AS VARCHAR) AS project_id, lower(p_type) || 'Store' AS module FROM part),
kw0 AS (SELECT project_id, lower(w) AS keyword FROM (SELECT project_id, unnest({_parts('s')}) AS w FROM sg) x WHERE length(w) > 2
  UNION ALL SELECT project_id, lower(module) FROM md UNION ALL SELECT project_id, lower(unnest({_parts('module')})) FROM md
  UNION ALL SELECT source, lower(unnest({_parts("lang || '-' || source")})) FROM documents
  UNION ALL SELECT source, regexp_replace(w, '[^a-z0-9]', '', 'g') FROM (SELECT source, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents) x WHERE length(w) > 3),
kw AS (SELECT project_id, keyword, count(*) AS n FROM kw0 WHERE keyword <> '' GROUP BY 1, 2)"""


def _table() -> str:
    rows = [(i, d, "NULL", "NULL", w) for i, (d, ws) in enumerate(D.DOMAINS.items()) for w in ws.split()]
    rows += [(i, d, k, f"'{s}'", w) for i, d in enumerate(D.DOMAINS) for k, (s, ws) in enumerate(D.SUB_DOMAINS[d].items()) for w in ws.split()]
    return "tb(place, domain, sub_place, sub_domain, word) AS (VALUES " + ", ".join(f"({i}, '{d}', {k}, {s}, '{w}')" for i, d, k, s, w in rows) + ")"


_CONF = f"""least(1.0::DOUBLE, score / least(size, {D.FULL_SCORE}))"""
SQL = {
    "p12_keywords": f"WITH {KEYWORDS}\nSELECT * FROM kw",
    "c07_domains": f"""WITH {KEYWORDS},
{_table()},
mt AS (SELECT DISTINCT project_id, word FROM (SELECT DISTINCT keyword, word FROM (SELECT DISTINCT keyword FROM kw) k, (SELECT DISTINCT word FROM tb) w WHERE contains(keyword, word) OR contains(word, keyword)) m JOIN kw USING (keyword)),
sc AS (SELECT project_id, place, domain, count(*) AS score FROM mt JOIN tb USING (word) WHERE sub_domain IS NULL GROUP BY 1, 2, 3),
sb AS (SELECT project_id, place, sub_domain FROM (SELECT project_id, place, sub_place, sub_domain, count(*) AS n FROM mt JOIN tb USING (word) WHERE sub_domain IS NOT NULL GROUP BY 1, 2, 3, 4) x
       QUALIFY row_number() OVER (PARTITION BY project_id, place ORDER BY n DESC, sub_place) = 1),
sz AS (SELECT place, count(*) AS size FROM tb WHERE sub_domain IS NULL GROUP BY 1),
rk AS (SELECT sc.*, sub_domain, size, coalesce(max(score) OVER (PARTITION BY sc.project_id ORDER BY sc.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              row_number() OVER (PARTITION BY sc.project_id ORDER BY score DESC, sc.place) AS r FROM sc LEFT JOIN sb USING (project_id, place) JOIN sz USING (place)),
pj AS (SELECT project_id, any_value(domain) FILTER (r = 1) AS domain, any_value(score) FILTER (r = 1) AS score, any_value(size) FILTER (r = 1) AS size, coalesce(any_value(score) FILTER (r = 2), 0) AS second,
              coalesce(arg_max(sub_domain, place) FILTER (score > before AND sub_domain IS NOT NULL), 'general') AS sub_domain FROM rk GROUP BY 1),
c1 AS (SELECT *, CASE WHEN sub_domain <> 'general' AND sub_domain <> domain THEN least(1.0::DOUBLE, {_CONF} + {O.d(D.SUB_BOOST)}) ELSE {_CONF} END AS a FROM pj),
c2 AS (SELECT *, CASE WHEN score >= 2 * second THEN least(1.0::DOUBLE, a + {O.d(D.GAP_BOOST)}) ELSE a END AS b FROM c1)
SELECT project_id, coalesce(domain, 'general') AS domain, coalesce(sub_domain, 'general') AS sub_domain, CAST(coalesce(score, 0) AS BIGINT) AS score, coalesce({O.r6(f'least({O.d(D.MOST)}, b)')}, 0.0::DOUBLE) AS confidence
FROM (SELECT DISTINCT project_id FROM kw) p LEFT JOIN c2 USING (project_id)""",
}

_rules = "ru(area, rule, i) AS (VALUES " + ", ".join(f"({O.lit(a)}, {O.lit(r)}, {i})" for a, rs in CP.RULES.items() for i, r in enumerate(rs)) + ")"
_has = lambda words: "bool_or(" + " OR ".join(f"contains(lower(keyword), {O.lit(w)})" for w in words) + ")"
SQL["c08_compliance"] = SQL["c07_domains"].replace("\nSELECT project_id, coalesce(domain, 'general') AS domain,", ",\ndm AS (SELECT project_id, coalesce(domain, 'general') AS domain,") + f"""),
{_rules},
wd AS (SELECT project_id, {_has(CP.BRAZILIAN)} AS br, {_has(CP.PERSONAL)} AS pii FROM kw GROUP BY 1),
r1 AS (SELECT project_id, rule, 'domain' AS origin, i FROM dm JOIN ru ON area = domain UNION ALL SELECT project_id, rule, 'sub_domain', 10 + i FROM dm JOIN ru ON area = sub_domain),
r2 AS (SELECT * FROM r1 UNION ALL SELECT project_id, 'LGPD', 'brazilian words', 20 FROM wd WHERE br AND project_id NOT IN (SELECT project_id FROM r1 WHERE contains(rule, 'LGPD'))),
r3 AS (SELECT * FROM r2 UNION ALL SELECT project_id, 'PII-Protection', 'personal data', 30 FROM wd WHERE pii AND project_id NOT IN (SELECT project_id FROM r2 WHERE rule IN ('LGPD', 'GDPR')))
SELECT project_id, rule, origin, row_number() OVER (PARTITION BY project_id ORDER BY i) AS place FROM r3"""
_signals = "sn(name, kind, word, i) AS (VALUES " + ", ".join(f"({O.lit(n)}, {O.lit(k)}, {O.lit(w)}, {i})" for n, k, ws in CP.INTEGRATIONS for i, w in enumerate(ws)) + ")"
SQL["c08_integrations"] = f"""WITH {KEYWORDS},
{_signals},
tx AS (SELECT DISTINCT project_id, lower(keyword) AS t FROM kw UNION SELECT project_id, lower(path) FROM fp),
ht AS (SELECT DISTINCT project_id, name, kind, word, i FROM tx JOIN sn ON contains(t, word))
SELECT project_id, name, kind, arg_min(word, i) AS found_by FROM ht GROUP BY 1, 2, 3"""
