"""Profiles, histograms, leakage audit, chart suggestions and integrity checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import is_finite
from millrace.functions.parse import ambiguous_number, locale_number
from millrace.functions.text import phrase_seconds
from millrace.operators.aggregates import exact_sum
from millrace.operators.columns import cell_counts, leakage_audit  # noqa: F401
from millrace.operators.quantiles import long_values, with_quantiles


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: counts, mean, median, population deviation, range."""
    aggs = []
    for c in columns:
        v = F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs.append(
            F.struct(
                F.lit(c).alias("name"), F.count(v).alias("n_valid"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.round(exact_sum(v) / F.count(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
            ).alias(f"s_{c}")
        )
    wide = df.agg(*aggs)
    stats = wide.select(F.explode(F.array(*[F.col(x) for x in wide.columns])).alias("s")).select("s.*")
    cells = cell_counts(df, columns)  # counted before the shuffle; distinct counts inside one aggregate would multiply the rows
    stats = stats.join(cells.groupBy("name").agg(F.count("value").alias("n_unique")), "name")
    values = long_values(df, {c: F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    out = with_quantiles(stats, values, ["name"], "value", (0.5,), "_median").withColumn("median", F.col("_median")[0])
    return out.select("name", "n_valid", "n_missing", "n_unique", "mean", "median", "std", "min", "max")


def histogram(df: DataFrame, column: str, most: int = 30) -> DataFrame:
    """min(most, ceil(sqrt(n))) equal bins, the last one closed; a single bin if all values are equal."""
    v = F.col(column).cast("double")
    ok = df.filter(is_finite(v)).select(v.alias("v"))
    span = ok.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.least(F.lit(most), F.ceil(F.sqrt(F.count(F.lit(1))))).alias("bins"))
    rows = ok.crossJoin(F.broadcast(span))  # one row
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.col("bins") - 1))
    return rows.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def date_distribution(df: DataFrame, time: str) -> DataFrame:
    """Counts by year, month or day, as the span of the dates suggests."""
    span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).select(F.datediff("b", "a").alias("days"))
    rows = df.filter(F.col(time).isNotNull()).crossJoin(F.broadcast(span))  # one row
    unit = F.when(F.col("days") > 3 * 365, F.date_format(time, "yyyy")).when(F.col("days") >= 90, F.date_format(time, "yyyy-MM")).otherwise(F.date_format(time, "yyyy-MM-dd"))
    return rows.groupBy(unit.alias("period")).agg(F.count(F.lit(1)).alias("n"))


ID_NAME = re.compile(r"(^|_)(id|uuid|guid|code|key)($|_)|email", re.IGNORECASE)
DATE_LIKE = r"^(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})(?:[T ].*)?$"
TIME_LIKE = r"^(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$"
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def model_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Kind, uniqueness, missing and malformed cells, date, id and cardinality flags of string columns, from cells counted once."""
    t, rows = F.col("value"), F.col("n")
    total = lambda ok: F.coalesce(F.sum(F.when(ok, rows)), F.lit(0)).cast("long")
    counted = cell_counts(df, columns).groupBy("name").agg(
        total(t.isNotNull()).alias("n"), total(t.isNull()).alias("missing"), F.count(t).alias("n_unique"), total(locale_number(t).isNotNull()).alias("n_numeric"), total(ambiguous_number(t)).alias("n_ambiguous"),
        total(t.rlike(DATE_LIKE) | t.rlike(TIME_LIKE)).alias("n_date"), total(t.rlike(UUID)).alias("n_uuid"),
    )
    names = df.sparkSession.createDataFrame([(c, bool(ID_NAME.search(c))) for c in columns], "name string, id_name boolean")
    s = names.join(counted, "name", "left").na.fill(0)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    numeric = (F.col("n") > 0) & (F.col("n_ambiguous") == 0) & (share("n_numeric") >= 0.9)
    s = s.withColumns({"kind": F.when(numeric, "numeric").otherwise("categorical"), "unique_ratio": F.round(share("n_unique"), 6), "is_date": share("n_date") >= 0.9})
    s = s.withColumn("id_like", F.col("id_name") | (share("n_uuid") > 0.9) | ((share("n_unique") >= 0.98) & (F.col("kind") == "categorical") & ~F.col("is_date")))
    task = F.when((F.col("kind") == "categorical") | (F.col("n_unique") <= 2) | ((F.col("n_unique") <= 20) & (share("n_unique") <= 0.15)), "classification").otherwise("regression")
    high = (F.col("kind") == "categorical") & ((F.col("n_unique") > 50) | ((F.col("n_unique") > 20) & (share("n_unique") > 0.5))) & ~F.col("is_date")
    target = (F.col("n") >= 2) & (F.col("n_unique") > 1) & ~F.col("id_like") & ~F.col("is_date")
    malformed = F.when(numeric, F.col("n") - F.col("n_numeric")).otherwise(0)
    return s.select("name", "kind", "n_unique", "unique_ratio", "missing", malformed.alias("malformed_numeric"), F.col("n_ambiguous").alias("ambiguous_numeric"), "is_date", "id_like", high.alias("high_cardinality"), task.alias("suggested_task"), target.alias("target_candidate"))


def quality_row(df: DataFrame, numbers: list[str], keys: list[list[str]]) -> DataFrame:
    """Missing, non-positive and non-finite counts of numbers; distinct counts of keys without nulls in their last part."""
    aggs = []
    for c in numbers:
        v = F.col(c).cast("double")
        aggs += [F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}_missing"), F.count_if(v <= 0).alias(f"{c}_nonpositive"), F.count_if(v.isNotNull() & ~is_finite(v)).alias(f"{c}_nonfinite")]
    for ks in keys:
        whole = F.when(F.col(ks[-1]).isNotNull(), F.struct(*ks))  # a struct keeps keys whose first parts are null
        aggs.append(F.count_distinct(whole).alias("_".join(ks) + "_keys"))
    return df.agg(*aggs)


def chart_suggestions(kinds: dict[str, str], most: int = 6) -> list[dict[str, str]]:
    """Lines over dates, bars over categories, scatters of numbers; at most six, in that order."""
    by = lambda kind: [c for c, k in kinds.items() if k == kind]
    total = re.compile(r"sum|total|amount|sales|revenue|quantity|count|doanh|tong", re.IGNORECASE)
    how = lambda c: "sum" if total.search(c) else "mean"
    numbers = by("numeric")
    out = [{"chart": "line", "x": d, "y": n, "agg": how(n)} for d in by("date") for n in numbers]
    out += [{"chart": "bar", "x": c, "y": n, "agg": how(n)} for c in by("category") for n in numbers]
    out += [{"chart": "scatter", "x": a, "y": b, "agg": ""} for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    return out[:most]


def chart_gates(groups: DataFrame, value: str = "value") -> DataFrame:
    """Which charts a grouped result allows: shares need no negative and one positive value, a radar 3 to 12 groups."""
    share = F.coalesce(F.min(value) >= 0, F.lit(False)) & F.coalesce(F.max(value) > 0, F.lit(False))
    return groups.agg(share.alias("pie"), share.alias("doughnut"), share.alias("treemap"), share.alias("polar"), F.count(F.lit(1)).between(3, 12).alias("radar"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()


def cross_totals(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Rows in all, rows of each part, and whether the parts add up."""
    total = F.count(F.lit(1))
    counts = [F.count_if(F.coalesce(c, F.lit(False))) for c in parts.values()]
    return df.agg(total.alias("total"), *[c.alias(k) for k, c in zip(parts, counts)], (sum(counts[1:], counts[0]) == total).alias("adds_up"))


def relative_time_check(df: DataFrame, phrase: str, seen: str, stated: str, within: int = 60) -> DataFrame:
    """One row: do relative phrases, taken from the time they were seen, agree with the stated times?

    Rows with a readable phrase, those whose error is at most ``within`` seconds, and the exact median error.
    Rows without one of the times count as readable, not as matching.
    """
    seconds = phrase_seconds(F.col(phrase))
    apart = F.abs(F.unix_timestamp(seen) - F.unix_timestamp(stated) - seconds)
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(seconds).alias("n_supported"), F.count_if(apart <= within).alias("n_matching"))
    stats = counts.withColumn("check", F.lit("relative"))
    values = df.select(F.lit("relative").alias("check"), apart.cast("double").alias("value")).filter("value IS NOT NULL")
    out = with_quantiles(stats, values, ["check"], "value", (0.5,), "_median")
    return out.select("n_rows", "n_supported", "n_matching", F.col("_median")[0].alias("median_seconds"))


def unsupported_phrases(df: DataFrame, phrase: str) -> DataFrame:
    """(phrase, n): the texts that are no relative time, with their rows."""
    return df.filter(F.col(phrase).isNotNull() & phrase_seconds(F.col(phrase)).isNull()).groupBy(F.col(phrase).alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


def file_checksums(spark, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def treemap(df: DataFrame, label: str, value: str, width: float, height: float, charts: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(charts, label, x, y, w, h): rectangles that tile the area of each chart, their areas in proportion to the values.

    A chart's groups, by the column ``order`` or else largest first, then by label, are cut in two where half of their weight is reached, the longer side
    of the area is divided accordingly, and each half is cut again. Groups without a positive value get no
    rectangle. A chart is a bounded group: one row per tile.
    """
    import numpy as np
    import pandas as pd

    keys = charts or []

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "_label"], kind="stable")
        upto = np.concatenate([[0.0], (pdf["_value"] / pdf["_value"].max()).cumsum()])
        areas, open_ = np.zeros((len(pdf), 4)), [(0, len(pdf), 0.0, 0.0, width, height)]
        while open_:
            a, b, x, y, w, h = open_.pop()
            if b - a == 1:
                areas[a] = x, y, w, h
                continue
            cut = a + 1 + int(np.searchsorted(upto[a + 1 : b - 1], (upto[a] + upto[b]) / 2))
            share = (upto[cut] - upto[a]) / (upto[b] - upto[a])
            across = w >= h
            open_.append((a, cut, x, y, w * share if across else w, h if across else h * share))
            open_.append((cut, b, x + w * share if across else x, y if across else y + h * share, w * (1 - share) if across else w, h if across else h * (1 - share)))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, label: pdf["_label"], "x": areas[:, 0], "y": areas[:, 1], "w": areas[:, 2], "h": areas[:, 3]})

    types = dict(df.dtypes)
    v = F.col(value).cast("double")
    rows = df.filter((v > 0) & (v < float("inf"))).select(*keys, F.col(label).alias("_label"), v.alias("_value"), (F.col(order) if order else -v).alias("_order"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, label]) + ", x double, y double, w double, h double"
    return rows.withColumn("_all", F.lit(0)).groupBy("_all", *keys).applyInPandas(tile, schema)
