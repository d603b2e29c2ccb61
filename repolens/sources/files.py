"""Corpus scan (S01): every file under a root, ignored folders dropped, kept
extensions only, as (project_id, path, content, bytes).

``binaryFile`` lists and reads the files in parallel; the ignore globs
become one regex on the path, the extension list another, and both run as
the listing's filter so skipped files are never read.  The project is the
first directory under the root.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default ignore globs and scanned extensions.
DEFAULT_IGNORE = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.git/**",
                  "**/.next/**", "**/venv/**", "**/__pycache__/**", "**/target/**", "**/out/**", "**/.cache/**"]
DEFAULT_EXTS = [".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".go", ".rb", ".php", ".cs", ".cpp", ".c",
                ".rs", ".kt", ".scala", ".sql", ".graphql", ".vue", ".html", ".css", ".json", ".yml", ".yaml"]


def normalize_ignore(patterns: list[str]) -> list[str]:
    """A bare name expands to name, name/**, **/name, **/name/**."""
    out = []
    for p in patterns:
        if "*" in p or "/" in p:
            cand = [p]
        else:
            cand = [p, f"{p}/**", f"**/{p}", f"**/{p}/**"]
        for c in cand:
            if c not in out:
                out.append(c)
    return out


def glob_to_regex(glob: str) -> str:
    """Glob over a relative path: ``**`` spans folders, ``*`` one segment."""
    i, out = 0, []
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("(?:/.*)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def read_files(spark: SparkSession, root: str, ignore: list[str] | None = None,
               exts: list[str] | None = None) -> DataFrame:
    root = root.rstrip("/")
    ignore = normalize_ignore(DEFAULT_IGNORE if ignore is None else ignore)
    exts = DEFAULT_EXTS if exts is None else exts
    ign = "|".join(f"(?:{glob_to_regex(g)})" for g in ignore)
    ext_re = "(" + "|".join(re.escape(e) for e in exts) + ")$"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:", ""), "^" + re.escape(root) + "/", "")
    f = df.select(rel.alias("rel"), "content", "length")
    f = f.where(F.col("rel").rlike(ext_re) & ~F.col("rel").rlike(ign) & (F.size(F.split("rel", "/")) > 1))
    return f.select(F.split("rel", "/").getItem(0).alias("project_id"),
                    F.expr("substring(rel, length(split(rel, '/')[0]) + 2)").alias("path"),
                    F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"))
