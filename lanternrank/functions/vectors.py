"""Vector expressions on arrays; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v over its norm, floored so that the zero vector stays zero; v and its norm are computed once a row."""
    over = lambda a, n: F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(FLOOR)))
    return F.get(F.transform(F.array(v), lambda a: F.get(F.transform(F.array(norm(a)), lambda n: over(a, n)), F.lit(0))), F.lit(0))


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded half up; what a negative number rounds to zero is -0.0, as it is in floating point and in SQL engines that round there."""
    r = F.round(x, digits)
    return F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)
