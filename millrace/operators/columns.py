"""Profiles of any number of columns from counted cells.

Every profile here is a function of (column, value, rows): cells are counted once,
combined before the shuffle, and each parse runs once per distinct value. What
relates a column to a target is a function of (column, value, target, rows). So a
table is read once for all columns, and once more for a target.

Null and missing tokens are counted as missing; a column without values has null
ranges and zero counts; an empty table gives one row of zeros per column; repeated
rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import parse
from millrace.functions.numeric import is_finite
from millrace.functions.text import MISSING_AUDIT, MISSING_MODEL
from millrace.storage import written

#: Names that hint at a time or a target, and at what is known only after the outcome.
TIME_HINT = r"date|datetime|timestamp|month|day|time|ngày"
TARGET_HINT = r"sales|revenue|quantity|amount|demand|units|turnover|doanh"
AFTER_HINT = r"outcome|post_|after_|result|final_status"
#: The date formats of candidate files.
FILE_DATES = ("yyyy-M-d", "yyyy-M-d H:m:s", "d/M/yyyy H:m")
PLAIN_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def _as_text(df: DataFrame, name: str) -> Column:
    """The cell as text; -0.0 is 0.0, as for grouping."""
    c = F.col(f"`{name}`")
    return (c + 0.0 if dict(df.dtypes)[name] in ("double", "float") else c).cast("string")


def _cells(df: DataFrame, columns: list[str]) -> Column:
    pairs = [F.struct(F.lit(c).alias("name"), _as_text(df, c).alias("value")) for c in columns]
    return F.inline(F.array(*pairs))


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n): each distinct cell of each column as text; null is a value of its own."""
    return df.select(_cells(df, columns)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(name, value, y, n): each distinct cell of each column beside the target's cell."""
    rows = df.select(_as_text(df, target).alias("y"), _cells(df, columns))
    return rows.groupBy("name", "value", "y").agg(F.count(F.lit(1)).alias("n"))


def _names(df: DataFrame, columns: list[str]) -> DataFrame:
    """(place, name): the columns themselves, in their order."""
    return df.sparkSession.createDataFrame(list(enumerate(columns)), "place int, name string")


def _missing(value: Column, tokens: tuple[str, ...]) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(*tokens)


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")


def plain_number(value: Column) -> Column:
    """The finite number that a plain decimal text means, else null."""
    number = F.when(value.rlike(PLAIN_NUMBER), F.trim(value).try_cast("double"))
    return F.when(is_finite(number), number)


def file_date(value: Column) -> Column:
    """The time that the first fitting format of candidate files reads, else null."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in FILE_DATES])


def file_profile(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column of ``cell_counts``: missing, distinct and repeated cells, numbers with their range, dates with theirs, least and greatest text."""
    present = ~_missing(F.col("value"), MISSING_AUDIT)
    parsed = cells.withColumns({"ok": present, "x": F.when(present, plain_number(F.col("value"))), "t": F.when(present, file_date(F.col("value")))})
    text = F.when(F.col("ok"), F.col("value"))
    out = parsed.groupBy("name").agg(
        F.sum("n").alias("n_rows"),
        _rows_where(~F.col("ok")).alias("n_missing"),
        F.count(text).alias("n_distinct"),
        (_rows_where(F.col("ok")) - F.count(text)).alias("n_repeated"),
        _rows_where(F.col("x").isNotNull()).alias("n_numeric"),
        _rows_where(F.col("ok") & F.col("x").isNull()).alias("n_not_numeric"),
        _rows_where(F.col("x") <= 0).alias("n_nonpositive"),
        F.min("x").alias("least"),
        F.max("x").alias("greatest"),
        _rows_where(F.col("t").isNotNull()).alias("n_dates"),
        F.min("t").alias("first_date"),
        F.max("t").alias("last_date"),
        F.min(text).alias("least_text"),
        F.max(text).alias("greatest_text"),
    )
    return _names(cells, columns).join(out, "name", "left").drop("place").na.fill(0, [c for c in out.columns if c.startswith("n_")])


def table_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows without any text, and rows that repeat an earlier one in full."""
    texts = [_as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)]
    blank = F.lit(True)
    for i in range(len(columns)):
        blank = blank & (F.trim(F.coalesce(F.col(f"c{i}"), F.lit(""))) == "")
    distinct = df.select(*texts).groupBy(*[f"c{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))
    return distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), _rows_where(blank).alias("n_blank_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated_rows"))


def top_values(cells: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` frequent values of each column, equal counts by value; nulls last. Ranks are cut per task before the shuffle."""
    order = Window.partitionBy("name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def derived_counts(cells: DataFrame, column: str, derive) -> DataFrame:
    """(value, n) of an expression of one column's cells, such as ``last_token`` or ``domain``."""
    return cells.filter(F.col("name") == column).groupBy(derive(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))


def last_token(value: Column) -> Column:
    """The text behind the last comma."""
    return F.trim(F.element_at(F.split(F.coalesce(value, F.lit("")), ",", -1), -1))


def domain(value: Column) -> Column:
    """The text between a leading http:// or https:// and the next slash."""
    return F.element_at(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), "^https?://", ""), "/", -1), 1)


def inspection(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Type and scores of each column, and which one to take as time and which as target.

    Scores are the share of readable dates or numbers among cells that are not
    missing, plus one where the name hints at it. The time column has the highest
    date score, if that is above 0.5; the target the highest target score among the
    others. Equal scores go to the earlier column. All rows are judged.
    """
    value = F.col("value")
    present = cells.withColumn("ok", ~_missing(value, MISSING_MODEL))
    day, month = (F.regexp_extract(F.trim(value), parse.DMY, k).try_cast("int") for k in (1, 2))
    slashed = F.trim(value).rlike(parse.DMY)
    facts = {
        "d": slashed & (day > 12) & (month <= 12),
        "m": slashed & (month > 12) & (day <= 12),
        "either": slashed & (day <= 12) & (month <= 12) & (day != month),
        "auto": parse.parse_date(value).isNotNull(),
        "day_first": parse.parse_date(value, "day_first").isNotNull(),
        "month_first": parse.parse_date(value, "month_first").isNotNull(),
        "numbers": parse.convention_number(value).isNotNull(),
    }
    sums = present.groupBy("name").agg(_rows_where(F.col("ok")).alias("n"), *[_rows_where(F.col("ok") & c).alias(k) for k, c in facts.items()])
    c = F.broadcast(_names(cells, columns)).join(sums, "name", "left").na.fill(0)  # one row per column of the table
    both = (F.col("d") > 0) & (F.col("m") > 0)
    dates = F.when(both, F.col("auto")).when(F.col("d") > 0, F.col("day_first")).when(F.col("m") > 0, F.col("month_first")).otherwise(F.col("auto"))
    share = lambda x: F.coalesce(F.try_divide(x, F.col("n")), F.lit(0.0))
    hint = lambda pattern: F.lower("name").rlike(pattern).cast("int")
    scored = c.select(
        "place",
        "name",
        F.when(share(dates) > 0.7, "datetime").when(share(F.col("numbers")) > 0.7, "numeric").otherwise("text").alias("type"),
        (share(dates) + hint(TIME_HINT)).alias("date_score"),
        (share(F.col("numbers")) + hint(TARGET_HINT)).alias("target_score"),
        (both | ((F.col("d") == 0) & (F.col("m") == 0) & (F.col("either") > 0))).alias("ambiguous_dates"),
    )
    best = lambda score: F.max(F.struct(F.col(score), -F.col("place")))["col2"] * -1
    scored = scored.crossJoin(F.broadcast(scored.agg(best("date_score").alias("time_place"))))  # one row
    rest = scored.filter(F.col("place") != F.col("time_place"))
    scored = scored.crossJoin(F.broadcast(rest.agg(best("target_score").alias("target_place"))))  # one row
    role = F.when((F.col("place") == F.col("time_place")) & (F.col("date_score") > 0.5), "time").when(F.col("place") == F.col("target_place"), "target")
    return scored.select("name", "type", "date_score", "target_score", "ambiguous_dates", role.alias("suggested"))


def leakage_audit(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """One row per feature: copy of the target, decides the target, correlation with it, name of something known later.

    Only rows where both are given count. A feature decides the target if each of
    its values has one target, at least 10 rows show it, the target varies and the
    values are at most 30 and a fifth of the rows. Correlation is over rows where
    both are numbers, at least 10 of them, with sums taken about the means. Copies
    are severe, a deciding or almost perfectly correlated feature or a telling name a warning.
    """
    pairs = written(pair_counts(df.filter(F.col(f"`{target}`").isNotNull()), target, features).filter("value IS NOT NULL"), "pairs")
    of_value = pairs.groupBy("name", "value").agg(F.count(F.lit(1)).alias("targets"), F.sum("n").alias("n"), F.bool_and(F.col("value") == F.col("y")).alias("same"))
    whole = of_value.groupBy("name").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_values"), F.max("targets").alias("targets"), F.bool_and("same").alias("same"))
    varied = pairs.groupBy("name").agg((F.min("y") < F.max("y")).alias("varied"))
    numbers = pairs.select("name", parse.locale_number(F.col("value")).alias("x"), parse.locale_number(F.col("y")).alias("t"), F.col("n").cast("double").alias("n")).na.drop()
    means = numbers.groupBy("name").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mx"), (F.sum(F.col("n") * F.col("t")) / F.sum("n")).alias("mt"), F.sum("n").alias("n_numbers"))
    u, v, n = F.col("x") - F.col("mx"), F.col("t") - F.col("mt"), F.col("n")
    moments = numbers.join(F.broadcast(means), "name").groupBy("name").agg(  # one row per feature
        F.first("n_numbers").alias("n_numbers"), F.sum(n * u * v).alias("uv"), F.sum(n * u * u).alias("uu"), F.sum(n * v * v).alias("vv")
    )
    r = F.when(F.col("n_numbers") >= 10, F.try_divide(F.col("uv"), F.sqrt("uu") * F.sqrt("vv")))
    out = _names(df, features).join(whole, "name", "left").join(varied, "name", "left").join(moments, "name", "left")
    few = (F.col("n_pairs") >= 10) & (F.col("n_values") <= F.least(F.lit(30), F.floor(F.col("n_pairs") / 5)))
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = out.select(
        F.col("name").alias("feature"),
        flag(F.col("same")).alias("is_copy"),
        flag(few & (F.col("targets") == 1) & F.col("varied")).alias("decides_target"),
        F.round(r, 6).alias("correlation"),
        (F.lower("name").rlike(AFTER_HINT) & F.col("n_pairs").isNotNull()).alias("suspicious_name"),
    )
    warns = F.col("decides_target") | flag(F.abs("correlation") >= 0.995) | F.col("suspicious_name")
    return out.withColumn("severity", F.when(F.col("is_copy"), "hard").when(warns, "warning").otherwise("none"))
