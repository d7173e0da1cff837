"""Running sums over a whole ordered table without passing it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portrisk.llm.common import stored


def running(df: DataFrame, order: list[Column], values: dict[str, Column], name: str = "running") -> DataFrame:
    """``df`` with a column for each of ``values``: the sum of that value over all rows that
    come earlier in ``order`` (0 for the first row).

    Rows are dealt into ranges of ``order`` and written with their range's number; each range
    is summed on its own and gets the total of the ranges before it (one row a range).  Rows
    equal in all of ``order`` come in any order, so ``order`` should name what tells them apart.
    """
    part = "range_part"
    ranged = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    totals = ranged.groupBy(part).agg(*[F.sum(v).alias(f"{k}_all") for k, v in values.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(part).alias("range_at"), *[
        F.coalesce(F.sum(f"{k}_all").over(before), F.lit(0)).alias(f"{k}_start") for k in values])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{k}_in")
                                  for k, v in values.items()])
    return summed.join(starts, F.col(part) == F.col("range_at")).select(
        *df.columns, *[(F.col(f"{k}_in") + F.col(f"{k}_start")).alias(k) for k in values])
