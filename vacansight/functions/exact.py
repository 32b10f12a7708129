"""Rounding in whole numbers, so that results do not depend on binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def rounded(num: Column, den: Column, places: int) -> Column:
    """``num / den`` to ``places`` decimals, halves away from zero; NULL when ``den`` is 0.

    ``den`` must not be negative.
    """
    scale = 10**places
    den = F.nullif(den.cast("long"), F.lit(0).cast("long"))
    size = whole_div(F.abs(num.cast("long")) * F.lit(2 * scale) + den, den * F.lit(2)) / F.lit(float(scale))
    return F.when(num < 0, -size).otherwise(size)


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage with two decimals."""
    return rounded(part * F.lit(100), whole, 2)
