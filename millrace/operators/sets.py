"""Unions, distinct projections and set assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def disjoint(a: DataFrame, b: DataFrame) -> bool:
    return a.intersect(b).isEmpty()


def subset(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty()


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return subset(a, b) and subset(b, a)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
