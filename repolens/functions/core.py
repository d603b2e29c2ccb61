"""Scalar column helpers shared by all operators.

All helpers return ``pyspark.sql.Column`` expressions so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def js_round(x) -> Column:
    """Round half up (towards +inf), i.e. ``floor(x + 0.5)``.

    Spark's ``round`` is half away from zero, which differs for negative
    halves; the scores and trends we reproduce use the half-up rule.
    """
    return F.floor(_c(x) + F.lit(0.5))


def js_round_to(x, decimals: int) -> Column:
    """Half-up rounding to ``decimals`` places: floor(x * 10^d + 0.5) / 10^d."""
    k = float(10 ** decimals)
    return F.floor(_c(x) * F.lit(k) + F.lit(0.5)) / F.lit(k)


def round6(x) -> Column:
    """Stable 6-decimal rounding used on every DOUBLE we publish."""
    return js_round_to(x, 6)


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def ladder_lt(x, steps: Sequence[tuple], default) -> Column:
    """First ``(bound, value)`` with ``x < bound`` wins, else ``default``."""
    expr = None
    xc = _c(x)
    for bound, value in steps:
        cond = xc < _c(bound)
        expr = F.when(cond, _c(value)) if expr is None else expr.when(cond, _c(value))
    return expr.otherwise(_c(default))


def ladder_gt(x, steps: Sequence[tuple], default) -> Column:
    """First ``(bound, value)`` with ``x > bound`` wins, else ``default``."""
    expr = None
    xc = _c(x)
    for bound, value in steps:
        cond = xc > _c(bound)
        expr = F.when(cond, _c(value)) if expr is None else expr.when(cond, _c(value))
    return expr.otherwise(_c(default))


def basename(path) -> Column:
    """Last ``/``-separated piece of a path."""
    return F.element_at(F.split(_c(path), "/"), -1)


def top_segment(path) -> Column:
    """First path segment when the path has a directory, else ''."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 1, parts.getItem(0)).otherwise(F.lit(""))


def parent_dir(path) -> Column:
    """Directory part of a path ('' for a bare file name)."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


_ASCII_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_regex(pattern: str) -> str:
    """Give ``\\b`` the ASCII meaning it has in JavaScript and RE2.

    On JDK 17 ``\\b`` counts any Unicode letter as a word character, so an
    accented letter next to an ASCII word would change the matches.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(_ASCII_B if pattern[i + 1] == "b" else pattern[i:i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)
