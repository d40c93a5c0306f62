"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def round_even(c: Column, digits: int) -> Column:
    """Rounding of ties to the even digit, as numerical libraries do."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def sigmoid(c: Column) -> Column:
    """1 / (1 + exp(-c)) without overflow."""
    return F.when(c >= 0, 1 / (1 + F.exp(-F.abs(c)))).otherwise(F.exp(-F.abs(c)) / (1 + F.exp(-F.abs(c))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_price(price: Column, size: Column) -> Column:
    return F.when((size > 0) & is_finite(size), price / size)


def line_amount(quantity: Column, value: Column, rate: Column | float = 1.0, kind: str = "unit_price") -> Column:
    """Amount of a line in the base currency; ``value`` is a unit price or the line's total."""
    return (quantity * value if kind == "unit_price" else value) / rate


def coverage(n: Column, least: int = 30) -> Column:
    """Bucket of a sample size."""
    return F.when(n >= 1000, "HIGH").when(n >= 200, "MEDIUM").when(n >= least, "LOW").otherwise("INSUFFICIENT")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = F.try_divide(hits, n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def complement_percent(p: Column) -> tuple[Column, Column]:
    """Two labels with one decimal that add up to 100.0."""
    tenths = F.round(p * 1000)
    return tenths / 10, (1000 - tenths) / 10
