"""Requirements mining over the ``documents`` corpus (C09), whole texts."""

from __future__ import annotations

from repolens import oracle as O
from repolens.operators import corpus as C
from repolens.session import materialize, read_table


def _docs(spark, base):
    return read_table(spark, base, "documents").select("doc_id", "text")


def _facets(spark, base):
    """Written once: six scores read each facet."""
    return materialize(C.requirement_facets(_docs(spark, base)))


QUERIES = {
    "c09_domains": lambda spark, base: C.detect_domain(_docs(spark, base)),
    "c09_integrations": lambda spark, base: C.integrations(_docs(spark, base)),
    "c09_non_functional": lambda spark, base: C.non_functional(_docs(spark, base)),
    "c09_actors": lambda spark, base: C.actors(_docs(spark, base)),
    "c12_requirement_facets": lambda spark, base: C.requirement_facets(_docs(spark, base)),
    "c12_rank_styles": lambda spark, base: C.rank_styles(_facets(spark, base)),
    "c10_entity_candidates": lambda spark, base: C.entity_candidates(_docs(spark, base)).drop("place"),
    "c10_entity_contexts": lambda spark, base: C.entity_contexts(_docs(spark, base), C.entity_candidates(_docs(spark, base))),
}

q = O.lit


def _first(p):
    return f"nullif(regexp_extract(text, {q(C.ci(p))}, 0), '')"


def _domain_sql():
    parts = []
    for i, (d, kws) in enumerate(C.DOMAIN_KEYWORDS.items()):
        sc = " + ".join(f"(CASE WHEN contains(lower(text), {q(k)}) THEN 1 ELSE 0 END)" for k in kws)
        parts.append(f"SELECT doc_id, {i} AS i, {q(d)} AS domain, {sc} AS score FROM documents")
    return ("ds AS (" + " UNION ALL ".join(parts) + """)
SELECT doc_id, coalesce(arg_min(domain, i) FILTER (WHERE score = ms AND ms > 0), 'general') AS domain,
       CAST(max(ms) AS BIGINT) AS score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS ms FROM ds) t
GROUP BY doc_id""")


def _integrations_sql():
    parts = [f"SELECT doc_id, {i} AS i, lower(trim(unnest(regexp_extract_all(text, {q(C.ci(p))}, 0)))) AS name, {q(t)} AS type FROM documents"
             for i, (p, t) in enumerate(C.INTEGRATION_PATTERNS)]
    return "im AS (" + " UNION ALL ".join(parts) + ")\nSELECT doc_id, name, arg_min(type, i) AS type FROM im GROUP BY 1, 2"


def _flags(flags):
    items = ", ".join(f"CASE WHEN regexp_matches(text, {q(C.ci(p))}) THEN {q(n)} END" for p, n in flags)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


SQL = {
    "c09_domains": "WITH " + _domain_sql(),
    "c09_integrations": "WITH " + _integrations_sql(),
    "c09_non_functional": f"""SELECT doc_id, {_first(C.STACK_PATTERN)} AS preferred_stack, {_first(C.AUTH_PATTERN)} AS auth,
       {_first(C.DB_PATTERN)} AS database, {_first(C.SCALE_PATTERN)} AS scalability,
       {_first(C.PERF_PATTERN)} AS performance, {_flags(C.SECURITY_FLAGS)} AS security,
       {_flags(C.COMPLIANCE_FLAGS)} AS compliance FROM documents""",
    "c09_actors": f"""SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, {q(C.ci(C.ACTOR_PATTERN))}, 1))) AS actor
FROM documents""",
}

_NOUNS = f"""nn AS (SELECT doc_id, unnest(ws) AS entity, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, regexp_extract_all(text, {q(C.NOUN_PATTERN)}, 1) AS ws FROM documents) x),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x),
df AS (SELECT doc_id, place, CASE WHEN regexp_matches(line, {q('(?i)' + C.INLINE_ENTITY)}) THEN regexp_extract(line, {q('(?i)' + C.INLINE_ENTITY)}, 1) WHEN regexp_matches(line, {q(C.INLINE_COLON)}) THEN regexp_extract(line, {q(C.INLINE_COLON)}, 1) END AS raw,
         CASE WHEN regexp_matches(line, {q('(?i)' + C.INLINE_ENTITY)}) THEN regexp_extract(line, {q('(?i)' + C.INLINE_ENTITY)}, 2) ELSE regexp_extract(line, {q(C.INLINE_COLON)}, 2) END AS fields FROM ln),
inl AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(raw, '[-_\\s]+'), lambda w: upper(w[1]) || w[2:]), '') AS entity, min(place) AS place, arg_min(len(string_split_regex(fields, ',\\s*')), place) AS n
        FROM df WHERE raw IS NOT NULL AND len(string_split_regex(fields, ',\\s*')) >= 2 GROUP BY 1, 2),
cand AS (SELECT doc_id, entity, 'inline' AS kind, CAST(n AS BIGINT) AS n, 0 AS k, place FROM inl WHERE length(entity) >= 2
  UNION ALL SELECT doc_id, entity, 'noun', count(*), 1, min(place) FROM nn ANTI JOIN inl USING (doc_id, entity) WHERE length(entity) >= 3 AND entity NOT IN {O.in_list(C.NOUN_STOP)} GROUP BY 1, 2 HAVING count(*) >= {C.NOUN_MIN})"""
SQL["c10_entity_candidates"] = "WITH " + _NOUNS + "\nSELECT doc_id, entity, kind, n FROM cand"
SQL["c10_entity_contexts"] = "WITH " + _NOUNS + """,
pg AS (SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\\n\\n+') AS ps FROM documents) x),
inp AS (SELECT c.*, i, count(*) OVER (PARTITION BY c.doc_id, i) AS together, first_value(entity) OVER (PARTITION BY c.doc_id, i ORDER BY k, place) AS leader FROM cand c JOIN pg ON pg.doc_id = c.doc_id AND contains(para, entity)),
ctx AS (SELECT doc_id, entity, arg_min(leader, i) AS leader FROM inp WHERE together >= 2 GROUP BY 1, 2)
SELECT doc_id, entity, lower(regexp_replace(regexp_replace(coalesce(leader, entity), '([a-z])([A-Z])', '\\1-\\2', 'g'), '[\\s_]+', '-', 'g')) AS context FROM cand LEFT JOIN ctx USING (doc_id, entity)"""

_contexts = SQL["c10_entity_contexts"][len("WITH "):].replace("\nSELECT doc_id, entity, lower(", ",\ncx AS (SELECT doc_id, entity, lower(") + ")"
_split = lambda sql: sql[len("WITH "):].replace("\nSELECT", ",\n{} AS (SELECT", 1) + ")"
FACETS = ("WITH " + _contexts + ",\n" + _split(SQL["c09_domains"]).format("dom") + ",\n" + _split(SQL["c09_integrations"]).format("itg")
          + ",\nnf AS (" + SQL["c09_non_functional"] + """),
ce AS (SELECT doc_id, count(*) AS entities, count(DISTINCT context) AS contexts FROM cx GROUP BY 1),
ci AS (SELECT doc_id, count(*) AS integrations, count(*) FILTER (type = 'database') AS databases, count(*) FILTER (type = 'queue') AS queues,
              count(*) FILTER (type = 'websocket') AS websockets FROM itg GROUP BY 1),
fc AS (SELECT d.doc_id, domain, coalesce(contexts, 0) AS contexts, coalesce(entities, 0) AS entities, coalesce(integrations, 0) AS integrations, coalesce(databases, 0) AS databases,
              coalesce(queues, 0) AS queues, coalesce(websockets, 0) AS websockets, CAST(0 AS BIGINT) AS workflows, security <> '' AS security, compliance <> '' AS compliance,
              scalability IS NOT NULL AS scalability, performance IS NOT NULL AS performance
       FROM dom d JOIN nf USING (doc_id) LEFT JOIN ce USING (doc_id) LEFT JOIN ci USING (doc_id))""")
_if = lambda test, p: f"CASE WHEN {test} THEN {p} ELSE 0 END"
_scores = {
    "layered-monolith": [50, _if("contexts <= 2", 20), _if("entities <= 5", 15), _if("integrations <= 2", 10), _if("contexts > 5", -30)],
    "clean-architecture": [40, _if("contexts BETWEEN 2 AND 5", 20), _if("entities >= 3", 15), _if("security", 10), _if("integrations >= 2", 10)],
    "hexagonal": [30, _if("integrations >= 3", 25), _if("databases > 0 AND queues > 0", 15), _if("compliance", 10), _if("integrations < 2", -20)],
    "modular-monolith": [45, _if("contexts BETWEEN 3 AND 8", 25), _if("entities >= 5", 15), _if("domain <> 'general'", 10), _if("contexts < 2", -20)],
    "microservices": [20, _if("contexts >= 5", 30), _if("scalability", 15), _if("queues > 0", 10), _if("contexts < 3", -30), _if("entities < 5", -15)],
    "event-driven": [25, _if("queues > 0", 30), _if("websockets > 0", 20), _if("workflows >= 3", 15), _if("performance", 10), _if("queues = 0 AND websockets = 0", -20)]}
_rows = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS style, CAST({' + '.join(map(str, x))} AS BIGINT) AS score, {k} AS k FROM fc" for k, (s, x) in enumerate(_scores.items()))
SQL["c12_requirement_facets"] = FACETS + "\nSELECT * FROM fc"
SQL["c12_rank_styles"] = FACETS + f"\nSELECT doc_id, style, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS rank FROM ({_rows}) t"
