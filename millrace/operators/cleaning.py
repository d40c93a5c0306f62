"""Cleaning of all-string tables: empty rows and columns, duplicates, imputation, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.parse import symbol_number
from millrace.functions.text import MISSING_TABLE, norm_missing, snake_headers
from millrace.operators.quantiles import medians

ROW = "_row"


def with_row(df: DataFrame, row: str = ROW) -> DataFrame:
    """An id that follows the order of the source's partitions; file scans give it in file order."""
    return df if row in df.columns else df.withColumn(row, F.monotonically_increasing_id())


def normalize_missing(df: DataFrame, tokens=MISSING_TABLE) -> DataFrame:
    return df.select(*[norm_missing(F.col(c), tokens).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def drop_empty_rows(df: DataFrame, keep: tuple[str, ...] = (ROW,)) -> DataFrame:
    return df.na.drop(how="all", subset=[c for c in df.columns if c not in keep])


def drop_empty_columns(df: DataFrame, keep: tuple[str, ...] = (ROW,)) -> DataFrame:
    """One pass of counts decides which columns stay."""
    names = [c for c in df.columns if c not in keep]
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first().asDict()
    return df.select(*[c for c in df.columns if c in keep or counts[c]])


def drop_repeats(df: DataFrame, keys: list[str] | None = None, row: str = ROW) -> DataFrame:
    """The first row, by ``row``, of each group of equal keys; nulls are equal.

    A partial aggregate finds the first rows, so a hot group is combined before
    the shuffle instead of being sorted in one task.
    """
    keys = keys or [c for c in df.columns if c != row]
    if row not in df.columns:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in (*keys, row)]
    first = df.groupBy(*keys).agg(F.min(row).alias(row), *[F.min_by(F.struct(*rest), row).alias("_rest")] * bool(rest))
    return first.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def modes(df: DataFrame, columns: list[str], row: str = ROW) -> dict[str, str | None]:
    """The commonest value of each column; of equally common ones the first seen."""
    long = df.select(row, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(row, "x.*")
    counts = long.filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    best = counts.groupBy("name").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("mode")).collect()
    return {c: None for c in columns} | {r["name"]: r["mode"] for r in best}


def impute(df: DataFrame, numeric: list[str], other: list[str], row: str = ROW) -> tuple[DataFrame, int]:
    """Medians into missing or unreadable numbers, modes (or 'Unknown') into other gaps; and how many cells changed."""
    typed = df.withColumns({c: symbol_number(F.col(c)) for c in numeric})
    gaps = [F.sum(F.col(c).isNull().cast("long")).alias(f"gap{i}") for i, c in enumerate([*numeric, *other])]
    middle = medians(typed, {c: F.col(c) for c in numeric})
    row_ = typed.agg(*gaps).first()
    common = modes(typed, other, row) if other else {}
    fills = {c: F.coalesce(F.col(c), F.lit(middle[c]).cast("double")) for c in numeric}
    fills |= {c: F.coalesce(F.col(c), F.lit(common[c] or "Unknown")) for c in other}
    return typed.withColumns(fills), sum(row_[f"gap{i}"] or 0 for i in range(len(gaps)))


def clean_table(df: DataFrame, tokens=MISSING_TABLE) -> tuple[DataFrame, dict[str, int]]:
    """The whole cleaning: headers, missing tokens, empty rows and columns, duplicates, types, gaps, duplicates again."""
    rows = with_row(df.toDF(*snake_headers(df.columns)))
    rows = normalize_missing(rows, tokens)
    total = rows.count()
    full = drop_empty_rows(rows)
    n_full = full.count()
    wide = drop_empty_columns(full)
    once = drop_repeats(wide)
    n_once = once.count()
    names = [c for c in wide.columns if c != ROW]
    shares = once.agg(*[F.avg(F.when(F.col(c).isNotNull(), symbol_number(F.col(c)).isNotNull().cast("double"))).alias(c) for c in names]).first().asDict()
    numeric = [c for c in names if (shares[c] or 0) > 0.5]
    filled, changed = impute(once, numeric, [c for c in names if c not in numeric])
    final = drop_repeats(filled)
    n_final = final.count()
    report = {"missing": changed, "duplicates": (n_full - n_once) + (n_once - n_final), "empty_columns": len(rows.columns) - len(wide.columns), "empty_rows": total - n_full}
    return final, report


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows whose id no other row has; all rows of a repeated id go."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(key)
    return df.join(counts, key, "left_semi")


def date_parts(c: Column) -> dict[str, Column]:
    return {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "day_of_week": F.weekday(c)}


def last_by_time(df: DataFrame, key: str, value: str, time: str, row: str) -> DataFrame:
    """The latest value of each key; of equal times the last row wins."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(time, row)).alias(value))


def strictly_monotone(df: DataFrame, column: str, order: str) -> bool:
    """True if the column rises, or falls, at every step."""
    before = F.lag(column).over(Window.orderBy(order))
    row = df.select(F.col(column).alias("x"), before.alias("p")).filter("p IS NOT NULL").agg(F.bool_and(F.expr("x > p")).alias("up"), F.bool_and(F.expr("x < p")).alias("down")).first()
    return bool(row["up"] or row["down"])
