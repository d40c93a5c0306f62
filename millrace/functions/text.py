"""Text expressions: missing tokens, accent folding, headers, safe export, display."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean "missing" after trimming and lower-casing, by product.
MISSING_TABLE = ("", "null", "nan", "na", "n/a", "none")
MISSING_MODEL = ("", "null", "nan", "na", "n/a", "none", "-", "--")
MISSING_AUDIT = ("", "nan", "null", "none", "n/a")
MISSING_HEALTH = ("", "null", "nan", "na", "n/a", "none", "?")


def norm_missing(c: Column, tokens: Iterable[str] = MISSING_TABLE, empty: Column | None = None) -> Column:
    """Trimmed text, or null (or ``empty``) where it is a missing token."""
    trimmed = F.trim(c)
    return F.when(F.lower(trimmed).isin(*tokens) | c.isNull(), F.lit(None) if empty is None else empty).otherwise(trimmed)


def _accent_table() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter and marks, and those letters; built from Unicode data."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(x) != "Mn")
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            source.append(chr(code))
            target.append(plain)
    return "".join(source) + "đĐ", "".join(target) + "dD"


ACCENTED, PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    """Letters without their marks, and đ as d; plain Catalyst, no UDF."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return strip_accents(F.lower(F.coalesce(c, F.lit(""))))


def collapse(c: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def contains_folded(c: Column, needle: str) -> Column:
    """Accent- and case-insensitive substring search."""
    plain = "".join(x for x in unicodedata.normalize("NFD", needle.lower()) if unicodedata.category(x) != "Mn").replace("đ", "d")
    return fold(c).contains(plain)


def snake_headers(names: list[str]) -> list[str]:
    """snake_case names without accents; blanks become column_i, repeats get _2, _3 and so on."""
    out: list[str] = []
    for i, name in enumerate(names, 1):
        plain = "".join(x for x in unicodedata.normalize("NFD", (name or "").lower()) if unicodedata.category(x) != "Mn").replace("đ", "d")
        base = re.sub("[^a-z0-9]+", "_", plain).strip("_") or f"column_{i}"
        pick, k = base, 2
        while pick in out:
            pick, k = f"{base}_{k}", k + 1
        out.append(pick)
    return out


def trimmed_headers(names: list[str], blank: str = "unnamed") -> list[str]:
    """Trimmed names; blanks become blank_i, repeats get _2, _3 and so on."""
    out: list[str] = []
    for i, name in enumerate(names, 1):
        base = (name or "").strip() or f"{blank}_{i}"
        pick, k = base, 2
        while pick in out:
            pick, k = f"{base}_{k}", k + 1
        out.append(pick)
    return out


def reject_headers(names: list[str]) -> None:
    """Raise on blank headers and on headers equal but for case, accents and punctuation."""
    keys = [re.sub("_", "", k) for k in snake_headers([n or "" for n in names])]
    if any(not (n or "").strip() for n in names) or len({snake_headers([n])[0] for n in names}) != len(keys):
        raise ValueError("headers must be present and distinct")


#: The headers under which customer files hold each of the ten fields; the first six are required.
CUSTOMER_FIELDS = {
    "customer": ["customer_id", "customerid", "buyer_id", "buyerid", "user_id", "user", "khach_hang", "ma_khach_hang", "username"],
    "order": ["order_id", "invoice_no", "invoiceno", "invoice", "order_code", "ma_don_hang"],
    "date": ["order_date", "invoice_date", "invoicedate", "created_at", "purchase_date", "ngay_mua", "ngay_dat_hang"],
    "quantity": ["quantity", "qty", "so_luong"],
    "value": ["unit_price", "unitprice", "price", "amount", "total", "order_value", "revenue", "gia", "gia_tri_don"],
    "country": ["country", "nation", "quoc_gia"],
    "product": ["stockcode", "stock_code", "product_id", "product", "product_name", "item", "description", "sku", "san_pham"],
    "rating": ["rating", "stars", "star", "review_score", "danh_gia", "so_sao"],
    "feedback": ["review", "feedback", "comment", "review_text", "phan_hoi", "nhan_xet"],
    "status": ["order_status", "status", "trang_thai", "trang_thai_don"],
}
REQUIRED_FIELDS = ("customer", "order", "date", "quantity", "value", "country")


def customer_columns(names: list[str]) -> tuple[dict[str, str | None], list[str]]:
    """The column of each of the ten fields, None where none or several fit, and the required fields without one."""
    found = map_columns(names, CUSTOMER_FIELDS)
    return found, [f for f in REQUIRED_FIELDS if found[f] is None]


def map_columns(names: list[str], aliases: dict[str, list[str]], preferred: dict[str, list[str]] | None = None) -> dict[str, str | None]:
    """Logical field -> the one column whose folded name is among its aliases; None if none or several."""
    key = lambda n: snake_headers([n])[0].replace("_", "")
    out: dict[str, str | None] = {}
    for field, words in aliases.items():
        wanted = {key(w) for w in words}
        found = [n for n in names if key(n) in wanted]
        out[field] = found[0] if len(found) == 1 else None
        if len(found) > 1 and preferred and field in preferred:
            out[field] = next((n for n in found if key(n) in {key(p) for p in preferred[field]}), None)
    return out


def guard_formula(c: Column) -> Column:
    """Text with an apostrophe before what a spreadsheet would run as a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    risky = text.rlike(r"^[\s\x{FEFF}]*[=+\-@]") | text.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def six_digits(c: Column) -> Column:
    """A number at six significant digits."""
    size = F.when(c == 0, 0).otherwise(F.floor(F.log10(F.abs(c))))
    scale = F.pow(F.lit(10.0), 5 - size)
    return F.round(c * scale) / scale


def vnd_display(c: Column) -> Column:
    """Billions as tỷ and millions as triệu."""
    return (
        F.when(F.abs(c) >= 1e9, F.concat(F.format_number(c / 1e9, 2), F.lit(" tỷ")))
        .when(F.abs(c) >= 1e6, F.concat(F.format_number(c / 1e6, 1), F.lit(" triệu")))
        .otherwise(F.format_number(c, 0))
    )


def relative_seconds(c: Column) -> Column:
    """Seconds of a Vietnamese relative time such as '5 ngày trước'."""
    text = fold(c)
    n = F.try_to_number(F.regexp_extract(text, r"(\d+)\s+(giay|phut|gio|ngay|tuan|thang|nam)", 1), F.lit("999999999")).cast("long")
    unit = F.regexp_extract(text, r"(\d+)\s+(giay|phut|gio|ngay|tuan|thang|nam)", 2)
    seconds = {"giay": 1, "phut": 60, "gio": 3600, "ngay": 86400, "tuan": 604800, "thang": 2592000, "nam": 31536000}
    out = F.lit(None).cast("long")
    for name, s in seconds.items():
        out = F.when(unit == name, n * s).otherwise(out)
    return out


#: Seconds of the units of a relative time; a month has 30 days, a year 365.
UNIT_SECONDS = {"giây": 1, "phút": 60, "giờ": 3600, "ngày": 86400, "tuần": 604800, "tháng": 2592000, "năm": 31536000}


def phrase_seconds(c: Column) -> Column:
    """Seconds of a text that is a relative time and nothing else, accents included; null for any other."""
    phrase = rf"^(\d+) ({'|'.join(UNIT_SECONDS)}) trước$"
    size = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    return F.when(c.rlike(phrase), F.regexp_extract(c, phrase, 1).try_cast("long") * F.try_element_at(size, F.regexp_extract(c, phrase, 2)))
