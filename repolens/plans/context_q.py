"""Context packing (P15) over the code files (D2): every supplier file is
an operation target (MODIFY, importance by description), every part file a
consumer reference (import update)."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens import oracle as O
from repolens.operators import context as CX
from repolens.plans.structure import code_files


def q_pack(spark, base):
    files = code_files(spark, base)
    ops = files.select("project_id", "path",
                       F.lit("MODIFY").alias("type"),
                       F.when(F.col("path").contains("/parts/"), "Update imports in file")
                       .otherwise("Extract grouped functionality").alias("description"))
    return CX.pack_context(files, ops)


QUERIES = {"p15_pack_context": q_pack}

_pat = O.lit(CX.EXPORT_PATTERN)
SQL = {"p15_pack_context": O.with_views(O.CODE_FILES, f"""ops AS (
  SELECT project_id, path, CASE WHEN contains(lower(CASE WHEN contains(path, '/parts/') THEN 'Update imports in file'
                                  ELSE 'Extract grouped functionality' END), 'update import') THEN 'consumer-ref'
                                ELSE 'important-context' END AS class FROM code_files),
ab AS (SELECT o.project_id, o.path, o.class, f.content, string_split(f.content, chr(10)) AS lines,
              CASE WHEN regexp_extract(f.path, '\\.([^./]+)$', 1) = 'py' THEN '#' ELSE '//' END AS pre
       FROM ops o JOIN code_files f ON f.project_id = o.project_id AND f.path = o.path),
ab2 AS (SELECT *, array_to_string(list_filter(lines, lambda l: regexp_matches(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), {_pat})), chr(10)) AS ex
        FROM ab),
tx AS (SELECT project_id, path, class,
              CASE WHEN len(lines) <= {CX.SMALL_FILE_LINES} THEN content ELSE concat_ws(chr(10),
                array_to_string(lines[1:{CX.HEAD_LINES}], chr(10)), '',
                pre || ' ... (' || CAST(len(lines) - {CX.HEAD_LINES + CX.TAIL_LINES} AS VARCHAR) || ' lines left out)',
                '', pre || ' exports:',
                CASE WHEN ex <> '' THEN ex ELSE pre || ' none' END,
                '', pre || ' last lines:',
                array_to_string(lines[len(lines) - {CX.TAIL_LINES - 1}:], chr(10))) END AS txt FROM ab2),
tk AS (SELECT project_id, path, class, CAST(ceil(length(txt) / 4) AS BIGINT) AS tokens FROM tx)
SELECT project_id, path, class, tokens,
       CAST(sum(tokens) OVER (PARTITION BY project_id ORDER BY CASE class WHEN 'core-target' THEN 0
            WHEN 'important-context' THEN 1 ELSE 2 END, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens,
       sum(tokens) OVER (PARTITION BY project_id ORDER BY CASE class WHEN 'core-target' THEN 0
            WHEN 'important-context' THEN 1 ELSE 2 END, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {CX.DEFAULT_BUDGET_TOKENS} AS included
FROM tk""")}
