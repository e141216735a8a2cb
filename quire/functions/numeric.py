"""Exact arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def trunc_div(a, b) -> Column:
    """Integer division truncating toward zero, exact for any integral size.

    Both engines of the case studies truncate ``int / int``. ``(a - a % b) / b``
    is an exact decimal division, so no rounding can push a quotient such as
    5.9999999 up to 6 before truncation.
    """
    a = _c(a).cast("decimal(38,0)")
    b = _c(b).cast("decimal(38,0)")
    return F.when(b == 0, F.lit(None)).otherwise(((a - a % b) / b).cast("bigint"))


def ratio_decimal(num, den, precision: int = 10, scale: int = 2) -> Column:
    """num / den rounded half-up to DECIMAL(precision, scale); NULL when den is 0."""
    n = _c(num).cast("decimal(28,10)")
    return F.try_divide(n, _c(den).cast("decimal(38,0)")).cast(f"decimal({precision},{scale})")


def percent(num, den, scale: int = 2, precision: int = 20) -> Column:
    """100 * num / den rounded half-up to DECIMAL(precision, scale)."""
    n = _c(num).cast("decimal(28,10)") * 100
    return F.round(F.try_divide(n, _c(den).cast("decimal(38,0)")), scale).cast(f"decimal({precision},{scale})")


def mean4(c) -> Column:
    """Arithmetic mean as a double rounded to 4 places (the documented form of every average)."""
    return F.round(F.avg(_c(c).cast("double")), 4)


def exact_mean_of_units(units_sum, count, out_units: int = 10_000, in_units: int = 100,
                        out_scale: int = 4) -> Column:
    """sum / count where ``units_sum`` is a sum of values scaled by ``in_units`` (an
    exact integer), as DECIMAL(38, out_scale) rounded half away from zero."""
    s, n = units_sum, count
    factor = out_units // in_units
    q = trunc_div(F.abs(s) * (2 * factor) + n, n * 2)
    q = F.when(s < 0, -q).otherwise(q)
    return (q.cast("decimal(38,0)") / out_units).cast(f"decimal(38,{out_scale})")


def mean_exact(c, in_scale: int = 2, out_scale: int = 4) -> Column:
    """Exact mean of a DECIMAL(_, in_scale) column as DECIMAL(38, out_scale), rounded half away from zero.

    Computed in integer units (sum of scaled values, then one truncating
    division), so the result does not depend on summation order the way a
    floating-point mean does.
    """
    x = _c(c)
    units = F.sum((x * (10 ** in_scale)).cast("decimal(38,0)"))
    return exact_mean_of_units(units, F.count(x), 10 ** out_scale, 10 ** in_scale, out_scale)
