"""Positions in a global order, natively and without one large group.

Rows fall into buckets; only the counts (or sums) of buckets are added up across groups, and a row's own
place is found in its bucket. A bucket is a bounded share of the rows, whatever the sizes of groups are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], bucket: list[str], order: list[Column], amount: Column,
            out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the same group that come before.

    The order is by the ``bucket`` columns, then by ``order``.
    """
    inside = Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, *bucket).agg(F.sum(amount).alias("_total"))
    before = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group + bucket)],
                           F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    held = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group + bucket)]
    return (held.join(before, on).withColumn(out, F.col("_before") + F.col("_inside"))
            .drop("_before", "_inside", *[f"_k{i}" for i in range(len(group + bucket))]))
