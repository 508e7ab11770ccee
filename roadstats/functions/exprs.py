"""Reusable native column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zfill(c: Column | str, width: int) -> Column:
    """Left-pad with zeros to ``width`` without truncating longer values.

    Bare ``lpad`` cuts a longer string down to ``width``; the source's
    zero-fill keeps it whole, so pad only when shorter.
    """
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def ratio_half_up(num: str, den: str, digits: int) -> Column:
    """``round(num / den, digits)`` with half away from zero, computed exactly.

    ``num`` and ``den`` are SQL expressions of integral type; ``den`` must be
    positive where the result is used (callers guard it).  The integer form
    ``(2*|num|*10^d + den) div (2*den)`` cannot drift with summation order,
    unlike averaging doubles.  Returns a double equal to the decimal result.
    """
    scale = 10 ** digits
    body = (f"(CAST(2 AS BIGINT) * abs({num}) * {scale} + ({den})) "
            f"div (CAST(2 AS BIGINT) * ({den}))")
    return (F.expr(f"CAST(sign({num}) AS BIGINT) * ({body})").cast("double")
            / F.lit(float(scale)))

