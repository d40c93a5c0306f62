"""Grouped, hierarchical and weighted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import coverage, is_finite
from millrace.operators.quantiles import rows_of_sets, with_quantiles

AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def grouped(df: DataFrame, x: str, y: str, how: str = "mean", digits: int = 2) -> DataFrame:
    """y by x: rows without x, and groups without a y, are left out; rounded but for counts."""
    value = AGGREGATES[how](y)
    out = df.filter(F.col(x).isNotNull()).groupBy(x).agg(value.alias("value"), F.count(y).alias("_n")).filter("_n > 0").drop("_n")
    return out if how == "count" else out.withColumn("value", F.round("value", digits))


def by_key_order(df: DataFrame, key: str, first_row: str) -> DataFrame:
    """Whole numbers ascending first, then the other keys as first seen."""
    number = F.when(F.col(key).cast("string").rlike("^(0|[1-9][0-9]{0,9})$"), F.col(key).cast("string").try_cast("long"))
    return df.orderBy(number.isNull(), number, first_row)


def scoped_distribution(df: DataFrame, a: str, b: str, value: str, points: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Counts, range and exact percentiles of the finite values over all rows, by a, by b, and by both."""
    ok = is_finite(F.col(value))
    finite = F.when(ok, F.col(value))
    groups = [[], [a], [b], [a, b]]
    sets = df.groupingSets(groups, a, b)
    scope = (
        F.when((F.grouping(a) == 1) & (F.grouping(b) == 1), "all").when((F.grouping(a) == 0) & (F.grouping(b) == 1), a).when(F.grouping(a) == 1, b).otherwise(f"{a}_and_{b}")
    )
    out = sets.agg(
        scope.alias("scope"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("undefined_count"),
        F.count_if(F.col(value).isNotNull() & ~ok).alias("nonfinite_count"),
        F.count(finite).alias("finite_count"),
        F.min(finite).alias("min_value"),
        F.max(finite).alias("max_value"),
        F.grouping(a).alias("_grouping0"),
        F.grouping(b).alias("_grouping1"),
    )
    rows, keys = rows_of_sets(df, [a, b], groups, finite)
    out = with_quantiles(out, rows, keys, "_of_set", points)
    return out.select("scope", a, b, "n_rows", "undefined_count", "nonfinite_count", "finite_count", "min_value", "max_value", *[F.col("_p")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(points)])


def level_stats(df: DataFrame, levels: list[tuple[str, list[str]]], value: str, date: str | None = None, least: int = 30) -> DataFrame:
    """n, quartiles, latest date and coverage by each level's keys; rows with a blank key skip that level."""
    keys = list(dict.fromkeys(k for _, ks in levels for k in ks))
    out = None
    for name, ks in levels:
        present = F.lit(True)
        for k in ks:
            present = present & F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
        aggs = [F.count(F.lit(1)).alias("n")] + ([F.max(date).alias("latest")] if date else [])
        rows = df.filter(present)
        part = with_quantiles(rows.groupBy(*ks).agg(*aggs), rows, ks, value, (0.25, 0.5, 0.75))
        part = part.select(F.lit(name).alias("level"), *[(F.col(k).cast("string") if k in ks else F.lit("")).alias(k) for k in keys], "n", *[F.col("_p")[i].alias(p) for i, p in enumerate(("p25", "median", "p75"))], *(["latest"] if date else []))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("coverage", coverage(F.col("n"), least))


def cube_with_blank(df: DataFrame, fixed: str, a: str, b: str, value: str, least: int = 5) -> DataFrame:
    """Quartiles by ``fixed`` and every subset of (a, b), '' standing for all; groups of ``least`` rows and more.

    Blank inputs are no group of their own, so '' never mixes with the totals.
    """
    groups = [[fixed], [fixed, a], [fixed, b], [fixed, a, b]]
    sets = df.groupingSets(groups, fixed, a, b)
    out = sets.agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_grouping{i}") for i, c in enumerate((fixed, a, b))])
    rows, keys = rows_of_sets(df, [fixed, a, b], groups, F.col(value))
    out = with_quantiles(out, rows, keys, "_of_set", (0.25, 0.5, 0.75)).withColumnsRenamed({"_grouping1": "_a", "_grouping2": "_b"})
    shown = lambda c, g: F.when(F.col(g) == 1, "").otherwise(F.col(c).cast("string"))
    kept = out.filter((F.col("n") >= least) & ((F.col("_a") == 1) | (F.coalesce(F.col(a).cast("string"), F.lit("")) != "")) & ((F.col("_b") == 1) | (F.coalesce(F.col(b).cast("string"), F.lit("")) != "")))
    return kept.select(fixed, shown(a, "_a").alias(a), shown(b, "_b").alias(b), "n", *[F.col("_p")[i].alias(p) for i, p in enumerate(("p25", "median", "p75"))])


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, points: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The smallest value at which the cumulative share of weight reaches each point; equal values count together.

    Rows of equal value are summed before the shuffle, so the window sees
    distinct values only.
    """
    w = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    order = Window.partitionBy(*keys).orderBy(value)
    share = F.sum("_w").over(order) / F.sum("_w").over(Window.partitionBy(*keys))
    return w.withColumn("_c", share).groupBy(*keys).agg(*[F.min(F.when(F.col("_c") >= p - 1e-12, F.col(value))).alias(f"q{round(p * 100)}") for p in points])


def duplicate_stats(df: DataFrame, key: Column) -> DataFrame:
    """Groups of equal keys: how many, rows beyond the first, rows in all, and the largest."""
    groups = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    zero = F.lit(0).cast("long")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("excess_rows"), F.coalesce(F.sum("n"), zero).alias("rows_in_groups"), F.max("n").alias("max_group_size"))


def size_distribution(df: DataFrame, key: str) -> DataFrame:
    """How many groups there are of each size."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def disagreements(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each column the number of groups with more than one distinct value."""
    per = df.groupBy(key).agg(*[(F.count_distinct(c) > 1).alias(c) for c in columns])
    return per.agg(*[F.count_if(F.col(c)).alias(c) for c in columns])


def frequency(df: DataFrame, column: str, row: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min(row).alias("first_row")] if row else [])
    return df.groupBy(column).agg(*aggs)


def two_level(df: DataFrame, outer: str, inner: str, time: str, amount: str) -> DataFrame:
    """Per ``outer``: first and last ``inner``, their number, and the amount; an ``inner`` starts at its first row."""
    first = df.groupBy(outer, inner).agg(F.min(time).alias("_t"), F.sum(amount).alias("_a"))
    return first.groupBy(outer).agg(F.min("_t").alias("first_time"), F.max("_t").alias("last_time"), F.count(F.lit(1)).alias("n_inner"), F.sum("_a").alias("amount"))


def with_percent(counts: DataFrame, n: str = "n") -> DataFrame:
    """Each count's share of the total in percent; the total is a one-row aggregate, not a window over one task."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percentage", 100.0 * F.col(n) / F.col("_total")).drop("_total")


def month_counts(df: DataFrame, time: str, by: str) -> DataFrame:
    return df.groupBy(F.date_format(time, "yyyy-MM").alias("month"), by).agg(F.count(F.lit(1)).alias("n"))


def match_matrix(df: DataFrame, stated: Column, actual: Column, factors: dict[str, float], tolerances: tuple[float, ...]) -> DataFrame:
    """For every hypothesis on the unit and every tolerance: rows compared and rows that match."""
    hypotheses = F.array(*[F.struct(F.lit(k).alias("hypothesis"), F.lit(float(v)).alias("factor")) for k, v in factors.items()])
    long = df.select(stated.cast("double").alias("_s"), actual.cast("double").alias("_x"), F.explode(hypotheses).alias("_h")).filter("_s > 0 AND _x > 0")
    error = F.abs(F.col("_s") * F.col("_h.factor") - F.col("_x")) / F.col("_x")
    out = long.groupBy(F.col("_h.hypothesis").alias("hypothesis")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.lit(t).alias("tolerance"), F.count_if(error <= t).alias("matches")) for t in tolerances]).alias("_t"))
    return out.select("hypothesis", "n", F.explode("_t").alias("_t")).select("hypothesis", "n", "_t.*")


def ratio_bins(df: DataFrame, a: Column, b: Column, factors: tuple[float, ...], tolerance: float = 0.02) -> DataFrame:
    """Rows by the factor that a / b lies within ``tolerance`` of, or 'other'."""
    ratio = F.try_divide(a, b)
    label = F.lit("other")
    for f in reversed(factors):
        label = F.when(F.abs(ratio / f - 1) <= tolerance, str(f)).otherwise(label)
    return df.select(F.when(ratio.isNull(), "undefined").otherwise(label).alias("factor")).groupBy("factor").agg(F.count(F.lit(1)).alias("n"))


def exact_sum(c: Column, scale: int = 10) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def rating_summary(df: DataFrame, rating: str, feedback: str | None = None) -> DataFrame:
    r = F.col(rating)
    ok = r.between(1, 5)
    n = F.count_if(ok)
    aggs = [F.count_if(r == k).alias(f"n_{k}") for k in range(1, 6)]
    aggs += [n.alias("n"), F.round(F.avg(F.when(ok, r)), 6).alias("average"), F.round(F.try_divide(F.count_if(ok & (r <= 2)), n), 6).alias("low_ratio"), F.round(F.try_divide(F.count_if(ok & (r >= 4)), n), 6).alias("high_ratio")]
    return df.agg(*aggs, *([F.count_if(F.trim(feedback) != "").alias("n_feedback")] if feedback else []))
