"""Numeric column helpers shared by all operators.

Rounding follows the evaluation pipeline: scores are rounded to 3 decimals
half-to-even on the binary value (``rint``), which is what NumPy's
``round`` does.  Spark's ``round``/``bround`` work on the decimal
representation instead and disagree on values such as 0.0625.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def round_half_even(col, digits: int) -> Column:
    """Half-to-even rounding on the binary double: ``rint(x * 10^d) / 10^d``."""
    factor = float(10 ** digits)
    return F.rint(_c(col) * F.lit(factor)) / F.lit(factor)


def round3(col) -> Column:
    return round_half_even(col, 3)


def round6(col) -> Column:
    """Final-projection rounding used by reports and the SQL oracle."""
    return round_half_even(col, 6)


def nan_to_null(col) -> Column:
    """Unify missing values on NULL (Spark keeps NaN, which sorts high)."""
    return F.nanvl(_c(col), F.lit(None).cast("double"))


def pearson(x, y) -> Column:
    """Pearson correlation that is NULL (not an error) for constant input.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode; the covariance form with
    ``try_divide`` returns NULL instead, like R's NA.
    """
    x, y = _c(x), _c(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def likert_to_unit(rating, positive) -> Column:
    """1..5 rating -> [0, 1]; negative questions are inverted; NULL flag -> NULL."""
    r = _c(rating).cast("double")
    p = _c(positive)
    unit = (r - F.lit(1.0)) / F.lit(4.0)
    return F.when(p, unit).when(~p, F.lit(1.0) - unit)


def grid_mean(col, digits: int | None = None) -> Column:
    """Mean of NULL-skipping ``col``.

    With ``digits`` the values are taken on their ``10^-digits`` grid (scores
    are 3-decimal values by construction) and summed as integers, so the
    result does not depend on summation order or partitioning: one exact
    integer sum and one IEEE division.  Without ``digits`` it is ``avg``.
    """
    c = _c(col)
    if digits is None:
        return F.avg(c)
    factor = 10 ** digits
    units = F.rint(c * F.lit(float(factor))).cast("bigint")
    return F.try_divide(F.sum(units).cast("double"),
                        (F.count(c) * F.lit(factor)).cast("double"))


def grid_sum(col, digits: int) -> Column:
    """Order-independent sum of values taken on their ``10^-digits`` grid."""
    factor = 10 ** digits
    units = F.rint(_c(col) * F.lit(float(factor))).cast("bigint")
    return F.sum(units).cast("double") / F.lit(float(factor))


def row_grid_mean(cols: list, digits: int | None = None) -> Column:
    """Mean of the non-NULL values among ``cols`` of one row (NULL if none);
    with ``digits`` the same exact grid arithmetic as :func:`grid_mean`."""
    cols = [_c(c) for c in cols]
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    if digits is None:
        total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
        return F.when(n > 0, total / n.cast("double"))
    factor = float(10 ** digits)
    units = sum((F.coalesce(F.rint(c * F.lit(factor)), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, units / (n.cast("double") * F.lit(factor)))
