"""Top-k, pages and previews: the limits here are the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extremes(df: DataFrame, metrics: dict[str, Column], columns: list[str], k: int = 5, largest: bool = True) -> DataFrame:
    """The k largest (or smallest) finite values of each metric, ties by ``columns``."""
    out = None
    for name, value in metrics.items():
        part = df.select(F.lit(name).alias("metric"), value.cast("double").alias("value"), *columns).filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
        part = part.orderBy(F.desc("value") if largest else F.asc("value"), *columns).limit(k)
        out = part if out is None else out.unionByName(part)
    return out


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def preview(df: DataFrame, row: str, n: int = 12) -> DataFrame:
    return df.orderBy(row).limit(n)


def ranked(df: DataFrame, column: str, descending: bool = True, *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last(), *ties)
