"""Point-in-time cohort: features before a cutoff, and whether the customer returned after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import round_even
from millrace.operators.filters import between_snapshot
from millrace.operators.quantiles import with_quantiles
from millrace.operators.windows import gap_features


def cohort(transactions: DataFrame, cutoffs: list[str], lookback: int = 90, horizon: int = 60, amount: str = "amount") -> DataFrame:
    """One row per customer and cutoff; transactions have customer, order_id, ts, product and an amount.

    Rows are dealt to cutoffs by an expression, all cutoffs are one job, and
    orders are combined before the shuffle by customer.
    """
    cut = F.explode(F.array(*[F.lit(c).cast("timestamp") for c in cutoffs]))
    tx = transactions.select("customer", "order_id", "ts", "product", F.col(amount).alias("amount"), cut.alias("cutoff"))
    ts, cutoff = F.col("ts"), F.col("cutoff")
    past, recent = between_snapshot(ts, cutoff), between_snapshot(ts, cutoff, lookback)
    future = (ts >= cutoff) & (ts < cutoff + F.make_dt_interval(F.lit(horizon)))
    orders = tx.filter(past).groupBy("cutoff", "customer", "order_id").agg(F.min("ts").alias("ts"))
    lifetime = orders.groupBy("cutoff", "customer").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_orders"))
    activity = tx.filter(recent).groupBy("cutoff", "customer").agg(F.count_distinct("order_id").alias("orders_90d"), round_even(F.sum("amount"), 2).alias("monetary_90d"), F.count_distinct("product").alias("products_90d"))
    returned = tx.filter(future).select("cutoff", "customer").distinct().withColumn("returned_60d", F.lit(1))
    gaps = gap_features(F.col("first_ts"), F.col("last_ts"), F.col("n_orders"), cutoff)
    joined = lifetime.join(activity, ["cutoff", "customer"], "left").join(returned, ["cutoff", "customer"], "left").na.fill(0, ["orders_90d", "monetary_90d", "products_90d", "returned_60d"])
    return joined.select("customer", "cutoff", *[c.alias(k) for k, c in gaps.items()], "orders_90d", "monetary_90d", "products_90d", "returned_60d", (cutoff + F.make_dt_interval(F.lit(horizon))).alias("label_end_exclusive"))


def drift(cohorts: DataFrame, columns: list[str]) -> DataFrame:
    """Deciles 1, 5 and 9 of each feature by cutoff, and the share that returned."""
    out = cohorts.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("returned_60d"), 6).alias("share"))
    for c in columns:
        out = with_quantiles(out, cohorts, ["cutoff"], c, (0.1, 0.5, 0.9), c)
    return out
