"""Column-level helpers built from native Spark functions (no Python UDFs)."""

from repolens.functions.core import (  # noqa: F401
    js_round, js_round_to, round6, clamp, ladder_lt, ladder_gt, basename, top_segment,
)
