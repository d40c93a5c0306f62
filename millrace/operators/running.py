"""Running totals in a global order, without a task that sees all rows.

Rows are range-partitioned by (keys, order) and written once with the number of their
range. The totals of each range, as few as there are ranges and keys, are added up in
order; a row's running total is the total of the ranges before its own plus a window
inside its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.quantiles import join_keys
from millrace.storage import written

RANGE = "_range"


def running_totals(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name: column): its total up to and with each row, by keys.

    Rows of a key must not tie in ``order``; sum ties up before.
    """
    by = [F.col(k) for k in keys]
    dealt = df.repartitionByRange(ranges, *by, *order) if ranges else df.repartitionByRange(*by, *order)
    ranged = written(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    offsets = totals.select(*keys, RANGE, *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    here = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_keys(ranged, offsets, [*keys, RANGE])
    return joined.withColumns({n: F.col(f"_before_{n}") + F.sum(c).over(here) for n, c in sums.items()}).drop(RANGE, *[f"_before_{n}" for n in sums])
