"""Running totals and ranks whose order spans the whole input, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], cell: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one in its group (exclusive).

    ``cell`` must rise (weakly) with ``order``. Rows are summed by cell first; the totals of earlier cells
    come from a window over one row per cell, so a hot group spreads over its cells.
    """
    w = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*group, cell).agg(F.sum(value).alias("_sum")).select(*group, cell, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    keys = [*group, cell]
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(base, on)
    return out.withColumn(name, (F.col("_in") + F.col("_base")).cast("long")).drop("_in", "_base", *[f"_k{i}" for i in range(len(keys))])
