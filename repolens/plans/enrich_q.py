"""Inferred modules, endpoints, entities and module details (P06 c, P11, P13,
C02, C03) on the application graph built from the parts."""

from __future__ import annotations

from repolens import adapters
from repolens import oracle as O
from repolens.functions import inference as I
from repolens.functions import roles
from repolens.functions.inference import module_inferred
from repolens.operators import enrich as E


def _app(spark, base):
    return adapters.app_graph(spark, base)


def q_endpoints(spark, base):
    edges, files = _app(spark, base)
    return E.endpoints(files, edges)


QUERIES = {
    "p06_module_inferred": lambda spark, base: _app(spark, base)[1].select("project_id", "path", module_inferred("path").alias("module")),
    "p11_entities": lambda spark, base: E.entities(_app(spark, base)[1]),
    "p13_endpoints": q_endpoints,
    "c02_module_details": lambda spark, base: E.module_details(_app(spark, base)[1]),
    "c03_untested_modules": lambda spark, base: E.untested_modules(E.module_details(_app(spark, base)[1])),
    "c03_critical_files": lambda spark, base: E.critical_files(_app(spark, base)[0]),
    "c03_size_classes": lambda spark, base: E.size_classes(_app(spark, base)[1]),
}

_PATH = f"[{', '.join(O.lit(x) for x in adapters.APP_PATHS)}][CAST(p_partkey % {len(adapters.APP_PATHS)} + 1 AS INTEGER)]"
APP = f"""ap AS (SELECT p_partkey, p_size, replace(replace(replace({_PATH}, '{{b}}', lower(replace(p_brand, '#', ''))), '{{n}}', CAST(p_partkey AS VARCHAR)), '{{m}}', CAST(p_partkey % 40 AS VARCHAR)) AS path FROM part),
al AS (SELECT 'm' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS project_id, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
app AS (SELECT DISTINCT a.project_id, a.l_partkey AS pa, b.l_partkey AS pb FROM al a JOIN al b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
edges AS (SELECT project_id, x.path AS src, y.path AS dst, CAST(count(*) AS DOUBLE) AS weight FROM app JOIN ap x ON x.p_partkey = pa JOIN ap y ON y.p_partkey = pb GROUP BY 1, 2, 3),
files AS (SELECT project_id, path, CAST(sum(p_size) AS BIGINT) AS lines FROM (SELECT DISTINCT project_id, l_partkey FROM al) z JOIN ap ON p_partkey = l_partkey GROUP BY 1, 2)"""


def _first(value: str) -> str:
    """The first value over the places of ``ps`` that is not null."""
    return f"list_filter(list_transform(range(1, len(ps) + 1), lambda i: {value}), lambda x: x IS NOT NULL)[1]"


def _isin(x: str, values) -> str:
    return f"{x} IN {O.in_list(values)}"


_CLEAN = (f"CASE WHEN {_isin('lower(ps[i])', I.CLEAN_LAYERS)} AND i < len(ps) AND ps[i + 1] <> '' THEN CASE WHEN {_isin('lower(ps[i + 1])', I.SUB_LAYERS)} "
          "THEN CASE WHEN i + 2 <= len(ps) AND ps[i + 2] <> '' AND NOT contains(ps[i + 2], '.') THEN ps[i + 2] ELSE ps[i] || '/' || ps[i + 1] END "
          f"WHEN NOT {_isin('lower(ps[i + 1])', I.GENERIC)} AND length(ps[i + 1]) > 2 AND NOT starts_with(ps[i + 1], '__') THEN ps[i + 1] END END")
_BASE = "regexp_extract(path, '[^/]*$', 0)"
MODULES = APP + f""",
sp AS (SELECT *, string_split(path, '/') AS ps, lower(path) AS low FROM files),
sq AS (SELECT *, CASE WHEN len(ps) > 1 THEN nullif(ps[len(ps) - 1], '') END AS par FROM sp),
im AS (SELECT project_id, path, lines, coalesce(
  {_first(f"CASE WHEN {_isin('lower(ps[i])', I.MODULE_MARKERS)} AND i < len(ps) THEN nullif(ps[i + 1], '') END")},
  {_first(_CLEAN)},
  CASE WHEN regexp_matches(low, '({"|".join(I.DJANGO_FILES).replace(".", "[.]")})$') AND NOT {_isin('lower(par)', I.GENERIC)} THEN par END,
  {_first(f"CASE WHEN {_isin('lower(ps[i])', I.PACKAGE_ROOTS)} AND i + 2 <= len(ps) THEN nullif(ps[i + 2], '') END")},
  CASE WHEN contains(low, '/http/controllers/') OR contains(low, '/http/requests/') THEN CASE WHEN lower(par) NOT IN ('controllers', 'requests') THEN par
       WHEN length(regexp_replace(regexp_replace({_BASE}, '\\.[^.]+$', ''), '(?i)({I.PHP_SUFFIX})$', '')) > 2 THEN regexp_replace(regexp_replace({_BASE}, '\\.[^.]+$', ''), '(?i)({I.PHP_SUFFIX})$', '') END END,
  CASE WHEN ends_with(low, '.go') AND NOT {_isin('lower(par)', I.GENERIC)} AND NOT {_isin('par', I.GO_FOLDERS)} THEN par END,
  list_filter(list_reverse(ps[1:len(ps) - 1]), lambda d: NOT {_isin('lower(d)', I.GENERIC + I.NEVER)} AND length(d) > 2 AND NOT starts_with(d, '.') AND NOT starts_with(d, '__'))[1]) AS module FROM sq)"""


def _role(rule) -> str:
    return roles.to_sql(rule, "lower(path)")


_RES = f"lower(regexp_replace(regexp_replace(regexp_replace({_BASE}, '\\.[^.]+$', ''), '(?i)({I.RESOURCE_SUFFIX})$', ''), '[-_]', '', 'g'))"
_ROUTES = f"""fg AS (SELECT project_id, src AS path, bool_or(regexp_matches(lower(dst), '{"|".join(E.AUTH_WORDS)}')) AS auth, bool_or(regexp_matches(lower(dst), '{"|".join(E.VALIDATION_WORDS)}')) AS valid FROM edges GROUP BY 1, 2),
rt AS (SELECT project_id, path, lower(path) AS low, string_split(path, '/') AS ps, {_RES} AS nm FROM files WHERE {_role(roles.CONTROLLER)}),
rn AS (SELECT *, CASE WHEN nm NOT IN ('', 'index', 'base') AND length(nm) > 1 THEN nm WHEN len(ps) > 1 AND lower(ps[len(ps) - 1]) NOT IN ('', 'routes', 'controllers') THEN regexp_replace(lower(ps[len(ps) - 1]), '[-_]', '', 'g') ELSE '' END AS name FROM rt),
rf AS (SELECT rn.*, coalesce(auth, false) AS auth, coalesce(valid, false) AS valid,
         CASE WHEN contains(low, 'health') OR contains(low, 'status') THEN 'h' WHEN contains(low, 'metric') OR contains(low, 'monitor') THEN 'm' WHEN contains(low, 'auth') THEN 'a'
              WHEN contains(low, 'search') OR contains(low, 'query') THEN 's' ELSE 'c' END AS kind FROM rn LEFT JOIN fg USING (project_id, path) WHERE name NOT IN ('', 'init', 'index')),
tm(kind, method, ep, handler, au, va) AS (VALUES ('h', 'GET', '/health', 'health_check', 'f', 'f'), ('m', 'GET', '/metrics', 'get_metrics', 'x', 'f'), ('a', 'POST', '/auth/login', 'login', 'f', 't'),
  ('a', 'POST', '/auth/register', 'register', 'f', 't'), ('a', 'POST', '/auth/refresh', 'refresh_token', 't', 'f'), ('s', 'GET', '/@/search', 'search_@', 'x', 't'), ('s', 'POST', '/@/search', 'advanced_search_@', 'x', 't'),
  ('c', 'GET', '/@', 'list_@', 'x', 'x'), ('c', 'GET', '/@/{{id}}', 'get_@', 'x', 'x'), ('c', 'POST', '/@', 'create_@', 'x', 'x'), ('c', 'PUT', '/@/{{id}}', 'update_@', 'x', 'x'), ('c', 'DELETE', '/@/{{id}}', 'delete_@', 'x', 'x')),
ee AS (SELECT project_id, method, replace(ep, '@', name) AS endpoint, path AS file, replace(handler, '@', name) AS handler, CASE au WHEN 'x' THEN auth ELSE au = 't' END AS has_auth, CASE va WHEN 'x' THEN valid ELSE va = 't' END AS has_validation
       FROM rf JOIN tm USING (kind))
SELECT * FROM ee QUALIFY row_number() OVER (PARTITION BY project_id, method, endpoint ORDER BY file, handler) = 1"""

_ENT = "coalesce(" + ", ".join(f"nullif(regexp_extract(path, '{p}', 1), '')" for p in I.ENTITY_PATTERNS) + ")"
# letters after a word boundary, in upper case
_TITLE = ("trim(list_reduce(list_concat([''], string_split(x, '')), lambda a, c: CASE WHEN regexp_matches(c, '[A-Za-z0-9_]') AND (a = '' OR NOT regexp_matches(right(a, 1), '[A-Za-z0-9_]')) THEN a || upper(c) ELSE a || c END))")
_ENTITIES = f"""en AS (SELECT project_id, path, regexp_replace({_ENT}, '[-_]', ' ', 'g') AS x, lower(path) AS low FROM files),
eo AS (SELECT project_id, path, {_TITLE} AS name, CASE WHEN contains(low, '/model') THEN 'model' WHEN contains(low, '/entity') OR contains(low, '/entities') THEN 'entity'
       WHEN contains(low, '/schema') THEN 'schema' WHEN contains(low, '/dto') THEN 'dto' ELSE 'unknown' END AS layer FROM en WHERE x IS NOT NULL)
SELECT project_id, name, path AS source, layer FROM eo WHERE name <> '' AND name NOT IN {O.in_list(I.ENTITY_SKIP)} QUALIFY row_number() OVER (PARTITION BY project_id, lower(name) ORDER BY path) = 1"""


def _layer_sql() -> str:
    pkg = "regexp_extract(lower(path), 'packages/([^/]+)', 1)"
    cases = " ".join(f"WHEN {pkg} IN {O.in_list(names)} THEN '{layer}'" for names, layer in roles.PACKAGE_LAYERS) + f" WHEN {pkg} <> '' THEN 'Package' "
    return "CASE " + cases + " ".join(f"WHEN {roles.to_sql(rule, 'lower(path)')} THEN '{layer}'" for layer, rule in roles.LAYER_RULES) + " ELSE 'Other' END"


DETAILS = MODULES + f""",
dt AS (SELECT project_id, module, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(count(*) FILTER ({_role(roles.TEST)}) AS BIGINT) AS tests, count(*) FILTER ({_role(roles.ENTITY)}) AS entities,
         count(*) FILTER ({_role(roles.CONTROLLER)}) AS controllers, count(*) FILTER ({_role(roles.SERVICE)}) AS services, arg_min({_layer_sql()}, path) AS layer FROM im WHERE module IS NOT NULL GROUP BY 1, 2)"""
_SIZE = "CASE " + " ".join(f"WHEN files > {f} OR lines > {n} THEN '{name}'" for name, f, n in E.SIZES) + " ELSE 'small' END"

SQL = {
    "p06_module_inferred": O.with_views(MODULES, "r AS (SELECT project_id, path, module FROM im) SELECT * FROM r"),
    "p11_entities": O.with_views(APP, _ENTITIES),
    "p13_endpoints": O.with_views(APP, _ROUTES),
    "c02_module_details": O.with_views(DETAILS, "r AS (SELECT * FROM dt) SELECT * FROM r"),
    "c03_untested_modules": O.with_views(DETAILS, f"r AS (SELECT project_id, module, files FROM dt WHERE tests = 0 AND files >= {E.UNTESTED_MIN}) SELECT * FROM r"),
    "c03_critical_files": O.with_views(APP, f"""ends AS (SELECT project_id, src AS path, weight FROM edges UNION ALL SELECT project_id, dst, weight FROM edges),
pw AS (SELECT project_id, path, sum(weight) AS weight FROM ends GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, path) AS rank FROM pw QUALIFY rank <= {E.CRITICAL_TOP}"""),
    "c03_size_classes": O.with_views(APP, f"pf AS (SELECT project_id, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM files GROUP BY 1) SELECT *, {_SIZE} AS size_class FROM pf"),
}
