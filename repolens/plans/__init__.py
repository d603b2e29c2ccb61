"""Registered queries: each plan module exposes ``QUERIES`` (name -> callable
(spark, sf_dir) -> DataFrame) and ``SQL`` (name -> DuckDB oracle text)."""

from __future__ import annotations


def all_queries() -> dict:
    out = {}
    for mod in _modules():
        out.update(mod.QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for mod in _modules():
        out.update(mod.SQL)
    return out


def _modules():
    import importlib
    names = ["scoring", "history", "snapshots", "structure", "graphs", "refactoring", "forecasting", "rules_q", "paths_q", "profiles_q", "roles_q", "modules_q", "context_q", "review_q", "manifests_q", "corpus", "streams",
             "sources_q", "hooks", "plan_checks_q", "pairs_q", "enrich_q", "domains_q", "summary_q"]
    return [importlib.import_module(f"repolens.plans.{n}") for n in names]
