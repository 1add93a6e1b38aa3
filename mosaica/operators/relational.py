"""Scans, projections, predicates and pages.  Literals are cast, columns never: predicates reach the files."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def project(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*columns) if columns else df.select("*")


def literal(df: DataFrame, column: str, value) -> Column:
    """``value`` as a literal of the column's type; VARCHAR(n) values are cut like the stored ones."""
    field = df.schema[column]
    if isinstance(field.dataType, T.StringType):
        n = (field.metadata or {}).get("length")
        return F.lit(str(value)[:n] if n else str(value))
    if isinstance(field.dataType, T.DateType) and isinstance(value, str):
        year, month, day = map(int, value.split("-"))
        return F.lit(datetime.date(year, month, day))
    if isinstance(field.dataType, T.ArrayType):
        return F.array(*(F.lit(float(v)) for v in value)).cast(field.dataType)
    if isinstance(field.dataType, INTEGERS) and isinstance(value, str):
        value = int(value)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)) and isinstance(value, str):
        value = float(value.replace(",", "."))
    return F.lit(value).cast(field.dataType) if not isinstance(field.dataType, INTEGERS) else F.lit(value)


def whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, INTEGERS)


def equals(df: DataFrame, column: str, value) -> Column:
    if whole(df, column) and isinstance(value, float) and value != int(value):
        return F.lit(False)
    if whole(df, column) and isinstance(value, float):
        value = int(value)
    return F.col(column) == literal(df, column, value)


def between(df: DataFrame, column: str, low, high) -> Column:
    """Inclusive; bounds in the wrong order give nothing; fractional bounds of integers close in."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        raise ValueError(f"BETWEEN does not apply to the array column {column}")
    if whole(df, column):
        low, high = (math.ceil(float(low)) if isinstance(low, float) else low), (math.floor(float(high)) if isinstance(high, float) else high)
    return (F.col(column) >= literal(df, column, low)) & (F.col(column) <= literal(df, column, high))


def compare(df: DataFrame, column: str, op: str, value) -> Column:
    if op in ("=", "<>", "!="):
        same = equals(df, column, value)
        return same if op == "=" else ~same & F.col(column).isNotNull()
    if whole(df, column) and isinstance(value, float):
        value = {"<": math.ceil, ">=": math.ceil, ">": math.floor, "<=": math.floor}[op](value)
    c, v = F.col(column), literal(df, column, value)
    return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def page(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000 and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_and_count(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """A page, and the number of rows of the whole."""
    return page(df, order, limit, offset), df.count()
