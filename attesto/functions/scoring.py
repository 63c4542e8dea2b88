"""Score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.5, 0.75, 60


def idf(df, n) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_okapi(df, n) -> Column:
    """The other common form, without the one in the logarithm; negative for terms of most documents."""
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25(tf, df, n, length, average, k1=K1, b=B, weight=idf) -> Column:
    """Score of one term; 0 where it doesn't occur or all documents are empty."""
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    norm = tf + k1 * (1 - b + b * length / average)
    return F.when((tf <= 0) | (average <= 0), 0.0).otherwise(weight(df, n) * tf * (k1 + 1) / norm)


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def normalised(x) -> Column:
    """x over its length, itself if that is 0; an error if a component is not finite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    length = norm(x)
    unit = F.when(length > 0, F.transform(x, lambda v: (v.cast("double") / length).cast("float"))).otherwise(F.transform(x, lambda v: v.cast("float")))
    return F.when(bad, F.raise_error(F.lit("vector with a component that is not finite"))).otherwise(unit)


def reciprocal(rank, k: int = RRF_K) -> Column:
    return 1.0 / (F.lit(k) + rank)
