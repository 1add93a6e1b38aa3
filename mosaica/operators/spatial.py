"""Points as arrays: distance, radius and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(column: str | Column, point: Sequence[float], dims: int | None = None) -> Column:
    """Euclidean distance; an error if a point has another number of dimensions than the query."""
    c = (F.col(column) if isinstance(column, str) else column).cast("array<double>")
    c = F.slice(c, 1, dims) if dims else c
    c = F.when(F.size(c) == len(point), c).otherwise(F.raise_error(F.lit(f"points need {len(point)} dimensions")).cast("array<double>"))
    terms = [(c[i] - F.lit(float(v))) * (c[i] - F.lit(float(v))) for i, v in enumerate(point)] if len(point) <= 4 else None
    if terms:
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return F.sqrt(total)
    return F.sqrt(F.aggregate(F.zip_with(c, F.array(*(F.lit(float(v)) for v in point)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))


def within(column: str, point: Sequence[float], radius: float, dims: int | None = None, scalars: Sequence[str] | None = None) -> Column:
    """Within ``radius`` (inclusive).  ``scalars`` name columns of the first coordinates: their box reaches the files."""
    box = F.col(column).isNotNull()
    for i, v in enumerate(point):
        c = F.col(scalars[i]) if scalars and i < len(scalars) else F.get(F.col(column), F.lit(i)).cast("double")
        box = box & (c >= F.lit(float(v) - radius)) & (c <= F.lit(float(v) + radius))
    return box & (distance(column, point, dims) <= F.lit(float(radius)))


def near(df: DataFrame, column: str, point: Sequence[float], radius: float, dims: int | None = None, scalars: Sequence[str] | None = None) -> DataFrame:
    """Rows ``within`` a radius."""
    return df.where(within(column, point, radius, dims, scalars))


def knn(df: DataFrame, column: str, point: Sequence[float], k: int = 1, key: str = "__rid", dims: int | None = None) -> DataFrame:
    """The ``k`` nearest rows, nearest first, ties by ``key``; ``distance`` is shown at six places, which decide nothing."""
    if k <= 0:
        return df.withColumn("distance", F.lit(0.0)).limit(0)
    rows = df.where(F.col(column).isNotNull()).withColumn("distance", distance(column, point, dims)).orderBy("distance", key).limit(k)
    return rows.withColumn("distance", F.round("distance", 6))
