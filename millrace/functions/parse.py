"""Parsers that return null rather than guess: numbers by locale, money, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold

#: The accepted shapes of numbers.
PLAIN = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
DOT_GROUPED = r"^[+-]?\d{1,3}(?:,\d{3})+\.\d+(?:[eE][+-]?\d+)?$"
COMMA_GROUPED = r"^[+-]?\d{1,3}(?:\.\d{3})+,\d+(?:[eE][+-]?\d+)?$"
COMMA_DECIMAL = r"^[+-]?\d+,\d+(?:[eE][+-]?\d+)?$"
AMBIGUOUS = r"^[+-]?\d{1,3},\d{3}$"


def _number(text: Column, limit: float) -> Column:
    value = F.when(text.rlike(PLAIN), text.try_cast("double"))
    return F.when(F.abs(value) <= limit, value)


def _drop(text: Column, char: str) -> Column:
    return F.replace(text, F.lit(char), F.lit(""))


def symbol_number(c: Column) -> Column:
    """A number after stripping currency signs, percent signs and blanks."""
    return _number(F.regexp_replace(c, "[$₫€£%\\s]", ""), float("inf"))


def ambiguous_number(c: Column) -> Column:
    """True for 1,234, which may be a decimal or a thousand."""
    return F.coalesce(F.trim(c).rlike(AMBIGUOUS), F.lit(False))


def locale_number(c: Column, decimal_comma: Column | bool = False, limit: float = 1e100) -> Column:
    """1,234.56 and 1.234,56 and 12,5; a lone 1,234 only where the column is known to use decimal commas."""
    text = F.trim(c)
    known = decimal_comma if isinstance(decimal_comma, Column) else F.lit(decimal_comma)
    plain = (
        F.when(text.rlike(DOT_GROUPED), _drop(text, ","))
        .when(text.rlike(COMMA_GROUPED), F.replace(_drop(text, "."), F.lit(","), F.lit(".")))
        .when(text.rlike(COMMA_DECIMAL), F.when(~text.rlike(AMBIGUOUS) | known, F.replace(text, F.lit(","), F.lit("."))))
        .otherwise(text)
    )
    return _number(plain, limit)


def decimal_comma_evidence(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which columns write decimals with commas: two clear cases at least, and no dotted number; one pass."""
    aggs = []
    for name in columns:
        text = F.trim(F.col(name))
        aggs.append(F.count_if(text.rlike(COMMA_DECIMAL) & ~text.rlike(AMBIGUOUS)).alias(f"{name}_e"))
        aggs.append(F.count_if(text.contains(".") & locale_number(F.col(name)).isNotNull()).alias(f"{name}_c"))
    row = df.agg(*aggs).first()
    return {name: row[f"{name}_e"] >= 2 and row[f"{name}_c"] == 0 for name in columns}


def convention_number(c: Column, convention: str = "auto", limit: float = 1e12) -> Column:
    """Numbers under an explicit convention: auto, decimal_dot or decimal_comma."""
    text = F.trim(c)
    swap = F.replace(_drop(text, "."), F.lit(","), F.lit("."))
    if convention == "decimal_comma":
        rest = F.when(text.contains(".") & ~text.contains(",") & ~text.rlike(r"^[+-]?\d{1,3}(?:\.\d{3})+$"), F.lit(None)).otherwise(swap)
    elif convention == "decimal_dot":
        rest = F.when(text.contains(",") & ~text.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"), F.lit(None)).otherwise(_drop(text, ","))
    else:
        rest = F.when(text.rlike(AMBIGUOUS), F.lit(None)).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    plain = F.when(text.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+\.\d+$"), _drop(text, ",")).when(text.rlike(r"^[+-]?\d{1,3}(?:\.\d{3})+,\d+$"), swap).otherwise(rest)
    return _number(plain, limit)


def grouped_number(c: Column, decimal: str = "dot") -> Column:
    """Strict grouping: plain digits or groups of three, under one decimal sign."""
    text = F.trim(c)
    if decimal == "comma":
        ok, plain = text.rlike(r"^[+-]?(?:\d+|\d{1,3}(?:\.\d{3})+)(?:,\d+)?$"), F.replace(_drop(text, "."), F.lit(","), F.lit("."))
    else:
        ok, plain = text.rlike(r"^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?$"), _drop(text, ",")
    return F.when(ok, plain.try_cast("double"))


def vn_number(c: Column) -> Column:
    """Vietnamese digits: 1.250 is a thousand, 87,5 a decimal."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{1,3}(?:[.,]\d{3})+$"), F.regexp_replace(text, "[.,]", "").try_cast("double")).when(
        text.rlike(r"^\d+(?:[.,]\d+)?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    )


def vn_money(c: Column) -> Column:
    """22,96 tỷ -> 2.296e10, 1.250 triệu -> 1.25e9."""
    text = fold(F.trim(c))
    pattern = r"^([\d.,]+)\s*(ty|trieu)$"
    scale = F.when(F.regexp_extract(text, pattern, 2) == "ty", 1e9).otherwise(1e6)
    return F.when(text.rlike(pattern), vn_number(F.regexp_extract(text, pattern, 1)) * scale)


def vn_area(c: Column) -> Column:
    """4.667 m² -> 4667."""
    pattern = r"^([\d.,]+)\s*m(?:2|²)$"
    text = F.lower(F.trim(c))
    return F.when(text.rlike(pattern), vn_number(F.regexp_extract(text, pattern, 1)))


def positive_number(c: Column, most: float = float("inf"), whole: bool = False) -> Column:
    """c where it is finite, positive, at most ``most`` and, if asked, whole; else null."""
    ok = ~F.isnan(c) & (c > 0) & (c <= most) & (F.abs(c) < float("inf"))
    return F.when(ok & (c == F.floor(c)) if whole else ok, c)


DMY = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?\s*(Z|[+-]\d{2}:\d{2})?)?$"


def _part(text: Column, pattern: str, k: int) -> Column:
    found = F.regexp_extract(text, pattern, k)
    return F.when(found == "", 0).otherwise(found.try_cast("int"))


def _moment(y: Column, m: Column, d: Column, text: Column, pattern: str, at: int) -> Column:
    parts = [_part(text, pattern, at + k) for k in range(3)]
    return F.try_make_timestamp(y, m, d, *parts)


def parse_date(c: Column, order: str = "auto") -> Column:
    """A UTC timestamp from ISO text, or D/M/Y by ``order``: auto (null where it could be either), day_first, month_first."""
    text = F.trim(c)
    text = F.when(text.rlike(r"^\d{4}[-/]\d{1,2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    iso = _moment(_part(text, ISO, 1), _part(text, ISO, 2), _part(text, ISO, 3), text, ISO, 4)
    zone = F.regexp_extract(text, ISO, 8)
    sign = F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
    minutes = F.when(zone.rlike(r"^[+-]"), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))).otherwise(0)
    iso = F.timestamp_micros(F.unix_micros(iso) - minutes.cast("long") * 60_000_000)
    a, b, y = (_part(text, DMY, k) for k in (1, 2, 3))
    day_first, month_first = _moment(y, b, a, text, DMY, 4), _moment(y, a, b, text, DMY, 4)
    if order == "auto":
        slashed = F.when(a > 12, day_first).when(b > 12, month_first).when(a == b, day_first)
    else:
        slashed = month_first if order == "month_first" else day_first
    return F.when(text.rlike(ISO), iso).when(text.rlike(DMY), slashed)


def excel_date(c: Column) -> Column:
    """The timestamp of an Excel serial number from 1 to 100000."""
    return F.when((c >= 1) & (c <= 100000), F.timestamp_seconds(F.round((c - 25569) * 86400).cast("long")))


def date_order(df: DataFrame, column: str) -> tuple[str, bool]:
    """(order, ambiguous) that the whole column shows; raises if it shows both orders."""
    text = F.trim(F.col(column))
    a, b = _part(text, DMY, 1), _part(text, DMY, 2)
    fits = text.rlike(DMY)
    row = df.agg(
        F.count_if(fits & (a > 12) & (b <= 12)).alias("d"), F.count_if(fits & (b > 12) & (a <= 12)).alias("m"), F.count_if(fits & (a <= 12) & (b <= 12) & (a != b)).alias("x")
    ).first()
    if row["d"] and row["m"]:
        raise ValueError("the column mixes day-first and month-first dates")
    return "day_first" if row["d"] else "month_first" if row["m"] else "auto", bool(row["x"]) and not row["d"] and not row["m"]


def vote_formats(df: DataFrame, date_col: str, number_cols: list[str], rows: int = 200) -> dict[str, str | None]:
    """The date and number format that every readable sample of the first rows allows; integers do not vote."""
    sample = df.limit(rows)  # the feature: a bounded format vote
    date_ok = {"ISO": F.col(date_col).rlike(ISO) & parse_date(F.col(date_col)).isNotNull(), "DMY": F.col(date_col).rlike(DMY) & parse_date(F.col(date_col), "day_first").isNotNull(), "MDY": F.col(date_col).rlike(DMY) & parse_date(F.col(date_col), "month_first").isNotNull()}
    readable = F.coalesce(date_ok["ISO"] | date_ok["DMY"] | date_ok["MDY"], F.lit(False))
    aggs = [F.bool_and(F.when(readable, F.coalesce(ok, F.lit(False)))).alias(k) for k, ok in date_ok.items()]
    for name, decimal in (("dot", "dot"), ("comma", "comma")):
        votes = [F.bool_and(F.when(grouped_number(F.col(c), "dot").isNotNull() | grouped_number(F.col(c), "comma").isNotNull(), grouped_number(F.col(c), decimal).isNotNull())) for c in number_cols]
        out = votes[0]
        for v in votes[1:]:
            out = F.coalesce(out, F.lit(True)) & F.coalesce(v, F.lit(True))
        aggs.append(out.alias(name))
    differ = F.lit(False)
    for c in number_cols:
        differ = differ | F.coalesce(F.bool_or(grouped_number(F.col(c), "dot") != grouped_number(F.col(c), "comma")), F.lit(False))
    row = sample.agg(*aggs, differ.alias("differ")).first()
    dates = [k for k in date_ok if row[k]]
    numbers = [k for k in ("dot", "comma") if row[k]]
    return {"date": dates[0] if len(dates) == 1 else None, "number": numbers[0] if len(numbers) == 1 else "dot" if len(numbers) == 2 and not row["differ"] else None}
