"""Vector expressions that stay in the JVM. All sums run in double precision, from the first element to the last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widen(v: Column | str) -> Column:
    """The vector in double precision."""
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; null if lengths differ."""
    return F.aggregate(F.zip_with(widen(a), widen(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column | str) -> Column:
    """The vector at length 1, rounded to single precision as it is stored; a zero vector stays as it is."""
    norm = l2_norm(v)
    divisor = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    # The norm stands beside the elements: inside the lambda it would be computed anew for each of them.
    return F.zip_with(widen(v), F.array_repeat(divisor, F.size(v)), lambda x, d: (x / d).cast("float"))


def is_finite(v: Column | str) -> Column:
    """Neither the vector nor an element of it is null, NaN or infinite, once it is in single precision."""
    column = (F.col(v) if isinstance(v, str) else v).cast("array<float>")
    top = F.lit(float("inf")).cast("float")
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < top))
    return F.coalesce(good, F.lit(False))


def literal(values) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(x)) for x in values)) if len(values) else F.expr("cast(array() as array<double>)")
