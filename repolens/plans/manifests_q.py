"""Manifests (S03), workspaces (S04), frameworks and stack (C05, C06) on
projects built per region and per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import adapters
from repolens import oracle as O
from repolens.operators import frameworks as FW
from repolens.operators import profiles
from repolens.session import materialize
from repolens.sources import manifests as M


def _files(spark, base):
    return materialize(adapters.repo_files(spark, base))


def q_frameworks(spark, base):
    return FW.frameworks(M.read_manifests(adapters.repo_files(spark, base)))


def q_stack(spark, base):
    files = _files(spark, base)
    return FW.stack_profile(adapters.part_graph(spark, base)[1].unionByName(files.select("project_id", "path")), FW.scanner_frameworks(files))


def q_profiles(spark, base):
    """Scoring profiles (B06) from what was detected: frameworks by manifests,
    languages by manifest kind, monorepos by workspaces."""
    files = _files(spark, base)
    names = FW.scanner_frameworks(files).groupBy("project_id").agg(F.collect_set("framework").alias("frameworks"))
    python = F.max(F.col("path").isin("requirements.txt", "pyproject.toml"))
    go = F.max(F.col("path") == "go.mod")
    langs = files.groupBy("project_id").agg(F.filter(F.array(F.when(python, F.lit("python")), F.when(go, F.lit("go"))), lambda x: x.isNotNull()).alias("languages"))
    mono = M.workspaces(files).select("project_id", F.lit(True).alias("is_monorepo")).distinct()
    projects = langs.join(names, "project_id", "left").join(mono, "project_id", "left").select(
        "project_id", F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"), "languages",
        F.coalesce("is_monorepo", F.lit(False)).alias("is_monorepo"), F.lit(None).cast("string").alias("explicit_profile"))
    return profiles.resolve_profile(projects).select("project_id", "profile")


QUERIES = {
    "s03_manifest_dependencies": lambda spark, base: M.read_manifests(adapters.package_manifests(spark, base)),
    "s03_all_manifests": lambda spark, base: M.read_manifests(adapters.repo_files(spark, base)),
    "s04_workspaces": lambda spark, base: M.workspaces(_files(spark, base)),
    "c05_frameworks": q_frameworks,
    "c05_scanner_frameworks": lambda spark, base: FW.scanner_frameworks(adapters.repo_files(spark, base)),
    "c06_stack_profile": q_stack,
    "c06_project_structure": lambda spark, base: FW.project_structure(adapters.part_graph(spark, base)[1].unionByName(adapters.repo_files(spark, base).select("project_id", "path"))),
    "b06_detected_profiles": q_profiles,
}

_KINDS = "[" + ", ".join(f"'{k}'" for k in adapters.MANIFEST_KINDS) + "]"
_NAMES = "CASE kind " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(O.lit(n) for n in v) + "]" for k, v in adapters.MANIFEST_DEPS.items()) + " END"
# version formats of the kinds: (others, for development)
_FORMS = {"package.json": ("'^' || v || '.1.0'", "'~' || v || '.1'"), "composer.json": ("'^' || v || '.2'",) * 2, "requirements.txt": ("'==' || v || '.0'",) * 2,
          "pyproject.toml": ("'>=' || v || '.1'", "'~=' || v || '.1'"), "go.mod": ("'v' || v || '.6.0'",) * 2, "pom.xml": ("v || '.3'",) * 2,
          "build.gradle": ("v || '.4'",) * 2, "Gemfile": ("'~> ' || v || '.5'",) * 2, "Cargo.toml": ("v || '.7'",) * 2, "pubspec.yaml": ("'^' || v || '.8.0'",) * 2}
_VERSION = "CASE " + " ".join(f"WHEN kind = '{k}' THEN CASE WHEN i % 4 = 3 THEN {b} ELSE {a} END" for k, (a, b) in _FORMS.items()) + " END"
DEPS = f"""prj AS (SELECT s_suppkey, s_name, 'repo-' || CAST(s_suppkey AS VARCHAR) AS project_id, {_KINDS}[CAST(s_suppkey % {len(adapters.MANIFEST_KINDS)} + 1 AS INTEGER)] AS kind FROM supplier),
md0 AS (SELECT project_id, kind, l_partkey % 12 AS i, CAST(max(l_partkey % 9 + 1) AS VARCHAR) AS v FROM lineitem JOIN prj ON l_suppkey = s_suppkey
       WHERE l_quantity <= 1 AND l_linenumber <= 4 GROUP BY 1, 2, 3),
deps AS (SELECT project_id, kind AS manifest, kind, ({_NAMES})[CAST(i + 1 AS INTEGER)] AS dep_name, {_VERSION} AS dep_version,
                i % 4 = 3 AND kind NOT IN ('requirements.txt', 'go.mod') AS is_dev FROM md0 WHERE i < len({_NAMES}))"""


def _dirs() -> str:
    return "[" + ", ".join(f"replace('{x}', '{{n}}', CAST(s_suppkey % 7 AS VARCHAR))" for x in adapters.WORKSPACE_DIRS) + "]"


_G = adapters.WORKSPACE_GLOBS
WORKSPACES = f"""nst AS (SELECT project_id, s_name, k - 1 AS k, dirs[k] AS dir FROM (SELECT project_id, s_name, {_dirs()} AS dirs, unnest(range(1, {len(adapters.WORKSPACE_DIRS) + 1})) AS k FROM prj WHERE s_suppkey % 3 = 0) x),
gl AS (SELECT unnest(['{"', '".join(_G)}']) AS "glob", unnest(['^packages/[^/.][^/]*$', '^services(/[^/.][^/]*)*$', '^tools/(alpha|beta)$', '^libs/core$']) AS re),
wsp AS (SELECT project_id, "glob", dir AS path, CASE WHEN k % 3 <> 1 THEN 'w' || CAST(k AS VARCHAR) ELSE dir END AS name,
               CASE WHEN k % 2 = 0 THEN '1.2.3' ELSE '0.0.0' END AS version, s_name AS description FROM nst, gl WHERE regexp_matches(dir, re))"""

_REG = "reg AS (SELECT unnest([" + ", ".join(O.lit(k) for k in FW._ENTRIES) + "]) AS key, unnest([" + ", ".join(O.lit(v[0]) for v in FW._ENTRIES.values()) + "]) AS name, unnest([" + ", ".join(O.lit(v[1]) for v in FW._ENTRIES.values()) + "]) AS category)"
_NUM = "nullif(regexp_extract(dep_version, '[0-9][0-9.]*', 0), '')"
FRAMEWORKS = _REG + f""",
hits AS (
  SELECT project_id, manifest, dep_name, CASE kind WHEN 'package.json' THEN 1 WHEN 'pom.xml' THEN 2 WHEN 'composer.json' THEN 3 WHEN 'Cargo.toml' THEN 7 ELSE 0 END AS o, name, category,
         CASE WHEN kind IN ('package.json', 'composer.json', 'requirements.txt', 'pyproject.toml') THEN {_NUM} END AS version,
         CASE kind WHEN 'pom.xml' THEN {O.d(0.85)} WHEN 'composer.json' THEN {O.d(0.9)} WHEN 'Cargo.toml' THEN {O.d(0.85)} ELSE {O.d(0.95)} END AS confidence
  FROM deps JOIN reg ON key = dep_name WHERE kind NOT IN ('go.mod', 'Gemfile', 'build.gradle', 'pubspec.yaml')
  UNION ALL SELECT project_id, manifest, dep_name, 4, name, category, NULL, {O.d(0.9)} FROM deps JOIN reg ON contains(dep_name, key) WHERE kind = 'go.mod' AND starts_with(dep_name, 'github.com/')
  UNION ALL SELECT project_id, manifest, dep_name, 5, CASE dep_name WHEN 'rails' THEN 'Ruby on Rails' WHEN 'sinatra' THEN 'Sinatra' ELSE 'RSpec' END, CASE dep_name WHEN 'rspec' THEN 'test' ELSE 'web' END,
         CASE WHEN dep_name = 'rails' THEN {_NUM} END, CASE WHEN dep_name = 'rails' THEN {O.d(0.95)} ELSE {O.d(0.9)} END FROM deps WHERE kind = 'Gemfile' AND dep_name IN ('rails', 'sinatra', 'rspec')
  UNION ALL SELECT project_id, manifest, dep_name, 2, CASE WHEN contains(dep_name, 'ktor') THEN 'Ktor' ELSE 'Micronaut' END, 'web', NULL, {O.d(0.9)} FROM deps WHERE kind = 'build.gradle' AND (contains(dep_name, 'ktor') OR contains(dep_name, 'micronaut'))
  UNION ALL SELECT project_id, manifest, dep_name, 6, 'Flutter', 'web', NULL, {O.d(0.95)} FROM deps WHERE kind = 'pubspec.yaml' AND dep_name = 'flutter'),
fw AS (SELECT project_id, name, category, version, confidence FROM (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY o, confidence DESC, manifest, dep_name) AS r FROM hits) x WHERE r = 1)
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY category <> 'web', confidence DESC, name) AS rank FROM fw"""
_SC = "sc AS (SELECT unnest([" + ", ".join(O.lit(k) for k in FW.SCANNED) + "]) AS key, unnest([" + ", ".join(O.lit(v) for v in FW.SCANNED.values()) + "]) AS name)"
SCANNER = _SC + """,
sf AS (SELECT DISTINCT project_id, name AS framework FROM deps JOIN sc ON key = dep_name WHERE kind = 'package.json'
  UNION SELECT project_id, 'Spring Boot' FROM deps WHERE kind = 'pom.xml' AND dep_name LIKE 'spring-boot%'
  UNION SELECT project_id, CASE dep_name WHEN 'flask' THEN 'Flask' WHEN 'django' THEN 'Django' ELSE 'FastAPI' END FROM deps WHERE kind = 'requirements.txt' AND dep_name IN ('flask', 'django', 'fastapi')
  UNION SELECT project_id, 'Ruby on Rails' FROM deps WHERE kind = 'Gemfile' AND dep_name = 'rails'
  UNION SELECT project_id, 'Go' FROM prj WHERE kind = 'go.mod')"""
PATHS = WORKSPACES + """,
allp AS (SELECT project_id, path FROM files UNION ALL SELECT project_id, kind FROM prj UNION ALL SELECT project_id, 'package.json' FROM prj WHERE s_suppkey % 3 = 0 AND kind <> 'package.json'
         UNION ALL SELECT project_id, dir || '/package.json' FROM nst)"""


def _stack_sql() -> str:
    ext = "lower(regexp_extract(path, '[^.]*$', 0))"
    langs = ", ".join(f"CASE WHEN bool_or({ext} IN {O.in_list(e)}) THEN '{n}' END" for n, e in FW.STACK_LANGUAGES.items())
    over = lambda col, values: f"list_has_any({col}, [{', '.join(O.lit(v) for v in values)}])"
    return f"""lg AS (SELECT project_id, list_filter([{langs}], lambda x: x IS NOT NULL) AS ls, bool_or({ext} IN ('tsx', 'jsx')) AS jsx,
       bool_or(regexp_matches(lower(path), '{"|".join(FW.DATABASE_WORDS)}')) AS has_database FROM allp GROUP BY 1),
fr AS (SELECT lg.*, coalesce(f.fs, []) AS fs FROM lg LEFT JOIN (SELECT project_id, list_sort(list(framework)) AS fs FROM sf GROUP BY 1) f USING (project_id))
SELECT project_id, coalesce(ls[1], 'Unknown') AS primary_language, array_to_string(ls, ',') AS languages, array_to_string(fs, ',') AS frameworks,
       {over('fs', FW.BACKEND)} OR {over('ls', FW.BACKEND_LANGUAGES)} AS has_backend, {over('fs', FW.FRONTEND)} OR jsx AS has_frontend,
       {over('fs', FW.MOBILE)} OR list_contains(ls, 'Dart') AS has_mobile, has_database FROM fr"""


def _has(folder: str) -> str:
    return f"bool_or(contains(lower(path), '/{folder}/'))"


_STRUCTURE = f"""SELECT project_id, CASE WHEN {_has('domain')} AND {_has('infrastructure')} OR {_has('domain')} AND {_has('application')} AND {_has('presentation')} THEN 'clean-architecture'
  WHEN {_has('models')} AND {_has('views')} AND {_has('controllers')} THEN 'mvc' WHEN {_has('modules')} OR {_has('features')} THEN 'modular'
  WHEN {_has('packages')} OR {_has('apps')} THEN 'monorepo' WHEN max(len(string_split(path, '/'))) <= 3 THEN 'flat' ELSE 'unknown' END AS structure FROM allp GROUP BY 1"""
_BY = {n: [f for f in fw] for n, _, _, fw, _ in profiles.PROFILES}


def _any(profile: str) -> str:
    return f"coalesce(list_has_any(fs, [{', '.join(O.lit(f.lower()) for f in _BY[profile])}]), false)"


_PROFILES = f"""pf AS (SELECT project_id, kind, s_suppkey % 3 = 0 AS mono, (SELECT list(lower(framework)) FROM sf WHERE sf.project_id = prj.project_id) AS fs FROM prj)
SELECT project_id, CASE WHEN {_any('frontend-spa')} THEN 'frontend-spa' WHEN {_any('backend-monolith')} AND mono THEN 'microservices' WHEN {_any('backend-monolith')} THEN 'backend-monolith'
  WHEN {_any('library')} THEN 'library' WHEN kind = 'go.mod' AND mono THEN 'microservices' WHEN kind IN ('requirements.txt', 'pyproject.toml') AND fs IS NULL THEN 'data-pipeline' ELSE 'default' END AS profile FROM pf"""

SQL = {
    "s03_manifest_dependencies": O.with_views(O.GEO, """x AS (
  SELECT g.r_name AS project_id, p.p_partkey, l.l_suppkey, lower(replace(p.p_brand, '#', '-')) AS brand,
         lower(replace(p.p_type, ' ', '-')) AS ptype
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN geo g ON s.s_nationkey = g.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey),
dp AS (SELECT project_id, brand AS dep_name, '^' || CAST(count(DISTINCT p_partkey) AS VARCHAR) || '.0.0' AS dep_version,
              false AS is_dev FROM x GROUP BY 1, 2),
dv AS (SELECT project_id, ptype AS dep_name, CAST(count(DISTINCT l_suppkey) AS VARCHAR) || '.0.0' AS dep_version,
              true AS is_dev FROM x GROUP BY 1, 2)
SELECT project_id, 'package.json' AS manifest, dep_name, dep_version, is_dev FROM dp
UNION ALL SELECT project_id, 'package.json', dep_name, dep_version, is_dev FROM dv"""),
    "s03_all_manifests": "WITH " + DEPS + "\nSELECT project_id, manifest, dep_name, dep_version, is_dev FROM deps",
    "s04_workspaces": f"WITH {DEPS},\n{WORKSPACES}\nSELECT * FROM wsp",
    "c05_frameworks": f"WITH {DEPS},\n{FRAMEWORKS}",
    "c05_scanner_frameworks": f"WITH {DEPS},\n{SCANNER}\nSELECT * FROM sf",
    "c06_stack_profile": f"WITH {O.PART_GRAPH},\n{DEPS},\n{SCANNER},\n{PATHS},\n{_stack_sql()}",
    "c06_project_structure": f"WITH {O.PART_GRAPH},\n{DEPS},\n{PATHS}\n{_STRUCTURE}",
    "b06_detected_profiles": f"WITH {DEPS},\n{SCANNER},\n{_PROFILES}",
}
