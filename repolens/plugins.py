"""Plug-in hooks (U01-U03) on DataFrames.

* detectors: ``fn(files_df, edges_df, cfg) -> DataFrame`` of anti-pattern
  rows (project_id, name, severity, location, metric1, metric2, description);
* refactor rules: ``fn(edges_df, files_df, cfg) -> (steps_df, impacts_df)``
  appended after the built-in rules;
* score modifiers: ``fn(parts_df) -> parts_df`` applied to the four part
  scores before the overall is computed.

A hook that fails while its plan is being built (bad column, exception) is
logged and skipped, like a failing plug-in in the reference; errors that
only surface when the job runs stop the job.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators.detect import AP_COLS
from repolens.operators.refactor import IMPACT_COLS, STEP_COLS

log = logging.getLogger("repolens.plugins")


class Registry:
    def __init__(self):
        self.detectors: dict = {}
        self.rules: dict = {}
        self.modifiers: dict = {}

    # ------------------------------------------------------------ U01 ----
    def register_detector(self, name: str, fn) -> None:
        self.detectors[name] = fn

    def run_detectors(self, files: DataFrame | None, edges: DataFrame, cfg: dict | None = None) -> list[DataFrame]:
        out = []
        for name, fn in self.detectors.items():
            try:
                df = fn(files, edges, cfg or {})
                missing = [c for c in AP_COLS if c not in df.columns and c not in ("metric1", "metric2", "description")]
                if missing:
                    raise ValueError(f"missing columns {missing}")
                for c in ("metric1", "metric2"):
                    if c not in df.columns:
                        df = df.withColumn(c, F.lit(None).cast("bigint"))
                if "description" not in df.columns:
                    df = df.withColumn("description", F.lit(None).cast("string"))
                out.append(df.select(*AP_COLS))
            except Exception as e:  # noqa: BLE001 - a failing plug-in is skipped
                log.warning("detector %s failed while building its plan: %s", name, str(e).splitlines()[0])
        return out

    # ------------------------------------------------------------ U02 ----
    def register_rule(self, name: str, fn) -> None:
        self.rules[name] = fn

    def run_rules(self, edges: DataFrame, files: DataFrame | None, cfg: dict | None = None) -> list:
        out = []
        for name, fn in self.rules.items():
            try:
                steps, impacts = fn(edges, files, cfg or {})
                out.append((steps.select(*STEP_COLS), impacts.select(*IMPACT_COLS)))
            except Exception as e:  # noqa: BLE001
                log.warning("refactor rule %s failed while building its plan: %s", name, e)
        return out

    # ------------------------------------------------------------ U03 ----
    def register_score_modifier(self, name: str, fn) -> None:
        self.modifiers[name] = fn

    def score_modifiers(self) -> list:
        def safe(name, fn):
            def apply(parts):
                try:
                    return fn(parts)
                except Exception as e:  # noqa: BLE001
                    log.warning("score modifier %s failed: %s", name, e)
                    return parts
            return apply
        return [safe(n, f) for n, f in self.modifiers.items()]
