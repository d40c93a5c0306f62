"""First-fail funnels and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import contains_folded

KEPT = "kept"


def first_fail(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds, or ``kept``; null conditions do not hold."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(reasons):
        out = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(out)
    return F.coalesce(out, F.lit(KEPT))


def funnel(df: DataFrame, reasons: list[tuple[str, Column]], column: str = "reason") -> DataFrame:
    return df.withColumn(column, first_fail(reasons))


def funnel_counts(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Rows per reason; each row counts once."""
    return funnel(df, reasons).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def mark_repeats(df: DataFrame, keys: list[str], row: str, column: str = "is_repeat") -> DataFrame:
    """Flags every row but the first of each group of equal keys (nulls are equal)."""
    first = df.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"k_{k}") for k in keys]).agg(F.min(row).alias("first_row"))
    on = [F.coalesce(df[k].cast("string"), F.lit("\u0000")) == first[f"k_{k}"] for k in keys]
    return df.join(first, on).select(*[df[c] for c in df.columns], (df[row] != first["first_row"]).alias(column))


def between_snapshot(time: Column, snapshot: Column, days: int | None = None) -> Column:
    """Strictly before the snapshot and, with ``days``, not earlier than that many days before it."""
    before = time < snapshot
    return before if days is None else before & (time >= snapshot - F.make_dt_interval(F.lit(days)))


def search(df: DataFrame, text: list[str], needle: str, **equal: str | None) -> DataFrame:
    """Rows where any text column holds the needle, whatever its accents, and columns equal a value or are missing (None)."""
    found = F.lit(not needle)
    for c in text:
        found = found | contains_folded(F.col(c), needle)
    for c, value in equal.items():
        found = found & (F.col(c).isNull() if value is None else F.col(c) == value)
    return df.filter(found)


def owner_view(df: DataFrame, owner: str, column: str = "user_id") -> DataFrame:
    """Row-level policy: an owner sees own rows only."""
    return df.filter(F.col(column) == owner)


def violations(df: DataFrame, checks: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Rows per broken check; a null check passes, as in SQL. ``keys`` adds a uniqueness check."""
    counted = [F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in checks.items()]
    if keys:
        counted.append((F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("repeated_key"))
    wide = df.agg(*counted)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in wide.columns])).alias("x")).select("x.*")
