"""Exclusive lags and rolling statistics, ranks, gaps and block changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import round_even


def lag_features(df: DataFrame, y: str, t: str, lags: list[int], means: list[int], stds: list[int], series: list[str] | None = None) -> DataFrame:
    """lag_k, rolling_mean_w and rolling_std_w (population) over earlier rows only; null before there are enough."""
    order = Window.partitionBy(*(series or [])).orderBy(t)
    seen = F.row_number().over(order) - 1
    over = lambda f, w: F.when(seen >= w, f(y).over(order.rowsBetween(-w, -1)))
    columns = {f"lag_{k}": F.lag(y, k).over(order) for k in lags}
    columns |= {f"rolling_mean_{w}": over(F.avg, w) for w in means}
    columns |= {f"rolling_std_{w}": over(F.stddev_pop, w) for w in stds}
    return df.withColumns(columns)


def drop_warmup(df: DataFrame, t: str, lags: list[int], windows: list[int], series: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(*(series or [])).orderBy(t)
    return df.withColumn("_seen", F.row_number().over(order) - 1).filter(F.col("_seen") >= max([*lags, *windows])).drop("_seen")


def top_hashed(df: DataFrame, label: str, key: Column, n: int, seed: str = "42") -> DataFrame:
    """n rows per label with the smallest md5 of seed|key: a sample that every engine repeats.

    A first cut keeps n rows per label and task group, so a hot label is not
    ranked whole in one task.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(seed + "|"), key)))
    salted = Window.partitionBy(label, F.pmod(F.crc32("_hash"), F.lit(64))).orderBy("_hash")
    some = hashed.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= n)
    whole = Window.partitionBy(label).orderBy("_hash")
    return some.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n).withColumnRenamed("_r", "sample_rank").drop("_hash")


def time_deltas(df: DataFrame, time: str) -> DataFrame:
    """Counts of the gaps, in seconds, between consecutive distinct times."""
    order = Window.orderBy(time)
    gaps = df.select(time).distinct().withColumn("delta", F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(order))).filter("delta IS NOT NULL")
    return gaps.groupBy("delta").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_seen"))


def gap_features(first: Column, last: Column, n: Column, snapshot: Column) -> dict[str, Column]:
    """Whole days since the last and first purchase, and the mean gap in days (0 for one purchase)."""
    seconds = lambda a, b: (F.unix_timestamp(b) - F.unix_timestamp(a)).cast("double")
    return {
        "recency_days": F.floor(seconds(last, snapshot) / 86400),
        "tenure_days": F.floor(seconds(first, snapshot) / 86400),
        "avg_purchase_gap_days": F.when(n > 1, round_even(seconds(first, last) / 86400 / (n - 1), 4)).otherwise(F.lit(0.0)),
    }


def block_change(df: DataFrame, t: str, y: str, length: int) -> DataFrame:
    """Sum of the last ``length`` periods, of those before, and the change in percent."""
    end = df.agg(F.max(t).alias("_end"))
    rows = df.crossJoin(F.broadcast(end))  # one row
    now = F.sum(F.when(F.col(t) > F.col("_end") - length, F.col(y)))
    before = F.sum(F.when((F.col(t) <= F.col("_end") - length) & (F.col(t) > F.col("_end") - 2 * length), F.col(y)))
    return rows.agg(now.alias("current"), before.alias("previous")).withColumn("percent", F.when(F.abs("previous") > 1e-9, 100 * (F.col("current") - F.col("previous")) / F.abs("previous")))


def rank_rows(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
