"""Column store operations: scalar aggregates, filters to row indices, and analytic encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake import errors

_AGGREGATES = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "average": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "stddev": lambda c: F.stddev_samp(c),
    "stddev_pop": lambda c: F.stddev_pop(c),
}


def aggregate(df: DataFrame, column: str, kind: str) -> object:
    """One aggregate of one numeric column; EmptyColumn without rows (also for count), UnsupportedAggregationType for other types."""
    if not isinstance(df.schema[column].dataType, T.NumericType) or kind not in _AGGREGATES:
        raise errors.UnsupportedAggregationType(f"{kind}({column})")
    row = df.agg(F.count("*").alias("n"), _AGGREGATES[kind](F.col(column)).alias("v")).first()
    if not row.n:
        raise errors.EmptyColumn(column)
    return row.v


def aggregates(df: DataFrame, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """The aggregates as one row, columns named by kind."""
    return df.agg(*[_AGGREGATES[k](F.col(column)).alias(k) for k in kinds])


def rows_equal(df: DataFrame, column: str, value: object, index: str = "row_idx") -> DataFrame:
    return df.where(F.col(column) == F.lit(value)).select(index)


def rows_between(df: DataFrame, column: str, low: float, high: float, index: str = "row_idx") -> DataFrame:
    """Both bounds belong to the range; nulls do not."""
    return df.where(F.col(column).between(low, high)).select(index)


def value_at(df: DataFrame, column: str, at: int, index: str = "row_idx") -> object:
    row = df.where(F.col(index) == at).select(column).first()
    if row is None:
        raise errors.IndexOutOfBounds(at)
    return row[0]


def delta_encode(df: DataFrame, column: str, order: str, group: list[str] | None = None) -> DataFrame:
    """``delta``: the difference to the value before in ``order``; the first value stays as it is. Give ``group`` to keep the order local: without it, one task sorts everything."""
    w = Window.partitionBy(*(group or [])).orderBy(order)
    return df.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0)))


def delta_decode(df: DataFrame, order: str, group: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(group or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum("delta").over(w))


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """``(value, code)``: codes from 0 by first appearance in ``order``. Only one row per distinct value is ranked."""
    first = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    return first.select("value", (F.row_number().over(Window.orderBy("_first", "value")) - 1).cast("long").alias("code"))


def run_lengths(df: DataFrame, column: str, order: str, group: list[str]) -> DataFrame:
    """Runs of equal values in ``order`` within each group: ``(group, run, value, start, length)``."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "run").agg(F.first(column).alias("value"), F.min(order).alias("start"), F.count("*").alias("length"))


def bit_width(df: DataFrame, column: str) -> DataFrame:
    """One row: bits that the column's range needs packed, and the bytes that takes."""
    span = F.max(column) - F.min(column)
    bits = F.when(span == 0, F.lit(0)).otherwise(F.length(F.bin(span.cast("long")))).cast("long")
    return df.agg(F.count(column).alias("n"), bits.alias("bits")).withColumn("bytes", F.ceil(F.col("n") * F.col("bits") / 8))
