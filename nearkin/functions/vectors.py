"""Row-wise arithmetic on two array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(u: Column, v: Column) -> Column:
    """Dot product of two arrays of equal length."""
    return _total(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_skip_nan(u: Column, v: Column) -> Column:
    """Cosine over the coordinates where neither side is NaN; 1.0 when either kept norm is zero."""

    def over_kept(f):
        return _total(
            F.zip_with(
                u,
                v,
                lambda x, y: F.when(F.isnan(x) | F.isnan(y), 0.0).otherwise(
                    f(x.cast("double"), y.cast("double"))
                ),
            )
        )

    nu = F.sqrt(over_kept(lambda x, y: x * x))
    nv = F.sqrt(over_kept(lambda x, y: y * y))
    return F.when((nu == 0) | (nv == 0), 1.0).otherwise(over_kept(lambda x, y: x * y) / (nu * nv))
