"""An approved feed as a stream: validate, aggregate, publish by replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.aggregates import cube_with_blank
from millrace.operators.filters import KEPT, first_fail
from millrace.sources.sinks import current_version, read_table, replace_table

FEED = "listing_id string, transaction_type string, currency string, area_unit string, total_price_vnd double, area_m2 double, province string, area_name string, property_type string, date timestamp"


def feed_reasons(now=None, provinces: list[str] | None = None) -> list:
    """The ordered reasons for which a record is refused."""
    c = F.col
    today = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    out = [
        ("missing_id", c("listing_id").isNull() | (F.trim("listing_id") == "")),
        ("transaction_type", c("transaction_type").isNull() | (c("transaction_type") != "SALE")),
        ("currency", c("currency").isNull() | (c("currency") != "VND")),
        ("area_unit", c("area_unit").isNull() | (c("area_unit") != "m2")),
        ("price", c("total_price_vnd").isNull() | F.isnan("total_price_vnd") | (c("total_price_vnd") <= 0) | (c("total_price_vnd") == float("inf"))),
        ("area", c("area_m2").isNull() | F.isnan("area_m2") | (c("area_m2") <= 0) | (c("area_m2") == float("inf"))),
        ("date", c("date").isNull() | (c("date") > today)),
    ]
    return out + ([("province", c("province").isNull() | ~c("province").isin(*provinces))] if provinces else [])


#: The order in which records of one id are preferred: the earliest, then the cheapest, then by the other columns.
PREFERENCE = ("date", "total_price_vnd", "area_m2", "province", "area_name", "property_type", "transaction_type", "currency", "area_unit")


def accepted(feed: DataFrame, now=None, provinces: list[str] | None = None) -> DataFrame:
    """Records that no reason refuses, ids repeated as they are."""
    return feed.withColumn("_why", first_fail(feed_reasons(now, provinces))).filter(F.col("_why") == KEPT).drop("_why")


def valid_records(feed: DataFrame, now=None, provinces: list[str] | None = None) -> DataFrame:
    """Accepted records, of each id the first by ``PREFERENCE``."""
    good = accepted(feed, now, provinces)
    order = F.struct(*PREFERENCE)
    return good.groupBy("listing_id").agg(F.min(order).alias("r")).select("listing_id", "r.*").select(*feed.columns)


def market_stats(records: DataFrame, least: int = 5) -> DataFrame:
    per = records.withColumn("price_per_m2", F.col("total_price_vnd") / F.col("area_m2"))
    return cube_with_blank(per, "province", "area_name", "property_type", "price_per_m2", least)


def first_of_each_id(records: DataFrame, remember: str = "400 days") -> DataFrame:
    """The first record of each id in a stream, with one small state per id.

    An id's records of one micro-batch meet in one call, where ``PREFERENCE`` decides; later ones are
    dropped. An id that was not seen for the time ``remember`` is forgotten.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    held, columns = int(pd.Timedelta(remember).total_seconds() * 1000), records.columns

    def first(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        known = state.exists
        state.update((True,))
        state.setTimeoutTimestamp(int(rows["seen_at"].max().timestamp() * 1000) + held)
        if not known:
            yield rows.sort_values(list(PREFERENCE), na_position="first", kind="stable").head(1)[columns]

    # the time of the micro-batch is the event time, so that time passes with the data
    timed = records.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", "1 hour")
    return timed.groupBy("listing_id").applyInPandasWithState(first, FEED, "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)


def publish_stream(spark: SparkSession, source: str, records_path: str, stats_path: str, checkpoint: str, provinces: list[str] | None = None, remember: str = "400 days") -> StreamingQuery:
    """Accept each micro-batch's new ids, and bring the statistics of their provinces up to date.

    A micro-batch costs what it and the provinces it touches hold: accepted ids are streaming state, its records
    become a partition of their own, and only the touched provinces are read and summarised again. A
    micro-batch that is run again after a crash overwrites its own partition, so that a restart gives the same
    tables. Read the statistics with ``sinks.read_table``.
    """
    place = F.concat(F.lit("p_"), F.coalesce("province", F.lit("")))

    def publish(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = batch.withColumns({"batch": F.lit(number), "place": place}).persist()
        try:
            touched = [r["place"] for r in new.select("place").distinct().collect()]
            if not touched:
                return
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("place", "batch").parquet(records_path)
            mine = session.read.schema(f"{FEED}, place string, batch long").parquet(records_path).filter(F.col("place").isin(touched))
            stats = market_stats(mine.select(*new.columns[: -2]))
            if current_version(session, stats_path):
                old = read_table(session, stats_path, stats.schema)
                stats = stats.unionByName(old.filter(~place.isin(touched)))
            replace_table(stats, stats_path)
        finally:
            new.unpersist()

    records = accepted(spark.readStream.schema(FEED).json(source), provinces=provinces)
    return first_of_each_id(records, remember).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, value: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Tumbling-window counts and sums with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
