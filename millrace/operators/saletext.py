"""The later generations of the rules over sale listings: intent, stated prices, reference price, and what a stored price is.

All of it is column expressions. A text is folded and cut before each stated price;
what stands before and after a price is put together from the parts around it, as many
as can share the letters looked at. Prices that complete the one before ("200 million"
in "5 billion 200 million") are told by walking over the prices in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import fold
from millrace.operators.filters import first_fail
from millrace.operators.textrules import RENT_LABEL, SALE_LABEL, UNCLEAR

# The patterns of the later intent rules, over folded text.
SALE = r"\b(?:can ban|chinh chu ban|ban gap|ban nhanh|gia ban|chuyen nhuong|rao ban|ban (?:nha|can ho|chung cu|dat|biet thu|lo|nen|shophouse|khach san|toa nha|mat tien|kho|xuong|trang trai|van phong))\b"
RENT = r"\b(?:cho thue|gia thue|can cho thue)\b"
MONTHLY = r"(?:/\s*thang\b|\b(?:trieu|tr|trd)\s*/\s*thang\b)"
CASHFLOW = r"\b(?:dang cho thue|hien (?:dang )?cho thue|hop dong (?:cho )?thue|dong tien|thu nhap|doanh thu|khai thac cho thue)\b"
DUAL = r"\b(?:ban\s*(?:hoac|va|hay|/)\s*(?:cho )?thue|vua ban vua cho thue|cho thue (?:hoac|va) ban)\b"
WANTED = r"\b(?:can mua|tim mua|can thue|tim thue|khong ban|chua ban)\b"
RENT_OPEN = r"^\W*(?:(?:chinh chu |can |gap )*cho thue\b|(?:villa )?for\s*rent\b)"
SALE_OPEN = r"^\W*(?:chinh chu |can |gap )?(?:ban\b|chuyen nhuong\b)"
# The patterns of strict sale titles.
STRICT_SALE = r"\b(ban|chuyen nhuong)\b"
STRICT_RENT = r"\b(cho thue|tim nguoi thue|can thue|tim thue|gia thue)\b"
STRICT_NEGATIVE = r"\b(khong ban|chua ban|can mua|tim mua|ban va cho thue|ban hoac cho thue)\b"
# A stated price, what makes it none, and what it is a rate of, in audits.
PRICE = r"(?<![\d.,])(\d+(?:[.,]\d+)*)\s*(ty|ti|trieu|trd|tr)(?![a-z])"
EXCLUDE = r"\b(?:thue|thu nhap|doanh thu|dong tien|tra gop|tra truoc|chi can|dat coc|tien coc|von|lai suat|hoa hong|vay|qua tang|tang tien|giam|booking|chi phi|dat cho)\b"
NAMED_PRICE = r"gia ban\s*[:=]?\s*$"
APPROXIMATE = r"\b(?:hon|nhinh|duoi|tu|chi tu|khoang|tam)\s*$"
PER_M2 = r"^\s*(?:vnd|vnđ|dong)?\s*(?:/|moi)\s*(?:1\s*)?m\s*(?:2|²)(?!\d)"
OTHER_RATE = r"^\s*(?:/|moi)\s*(?:1\s*)?(?:sao|ha\b|hecta|cong\b|mn\b|met ngang|m\s+ngang|m(?!\s*[2²])\b)"
PERIOD_RATE = r"^\s*(?:/|moi|mot)\s*(?:thang|ngay|nam|tuan)"
AREA_BEFORE, HIDDEN = r"\d\s*m$", r"^\s*x+"
MILLIONS_BEHIND, DECIMALS_BEHIND = r"^\s*(\d{1,3})\s*(?:trieu|tr)\b", r"^\s*(\d{1,3})(?!\d)(?=$|[\s,;.)/\-])"
# The same for verified totals.
TOTAL = r"(?<![\d.,])(\d+(?:[.,]\d+)?)\s*(ty|ti|trieu)\b"
TOTAL_CONTEXT = r"\b(thue|thu nhap|doanh thu|dong tien|tra gop|tra truoc|dat coc|tien coc|von ban dau|gia cu|gia goc|gia truoc|gia thi truong|dinh gia)\b"
TOTAL_RATE = r"^\s*(?:/|moi|mot)\s*(?:m\s*(?:2|²)|thang|ngay|nam|tuan)\b"
TOTAL_FOREIGN, TOTAL_TAIL, TOTAL_UNSURE = r"^\s*(?:usd|dollar|\$)", r"^\s+(\d{3})(?:\s+trieu\b)?(?![\d.,])", r"^\s+\d+(?:\s*(?:trieu|ty)\b)"
#: Letters looked at before and behind a price, and around it in an excerpt.
LEFT, RIGHT, SHOWN_LEFT, SHOWN_RIGHT = 90, 65, 20, 15
#: A price has at least three letters, so that so many parts hold the letters looked at.
PARTS = LEFT // 3 + 1


def _has(c: Column, pattern: str) -> Column:
    return c.rlike("(?U)" + pattern)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, "(?U)" + pattern, group)


def intent(title: Column, description: Column, head: int = 300) -> Column:
    """struct(label, reason): what the title offers, unless it is a wish, offers both, or the opening disagrees."""

    def flags(x: Column) -> Column:
        t, d = x["t"], x["d"]
        cash = _has(t, CASHFLOW)
        return F.struct(
            _has(t, WANTED).alias("wanted"), (_has(t, DUAL) | _has(d, DUAL)).alias("dual"), _has(t, SALE).alias("sale"), cash.alias("cash"), ((_has(t, RENT) | _has(t, MONTHLY)) & ~cash).alias("rent"),
            _has(d, RENT_OPEN).alias("then_rent"), _has(d, SALE_OPEN).alias("then_sale"), (_has(t, RENT_OPEN) | _has(d, RENT_OPEN)).alias("opens_rent"),
        )

    def judge(f: Column) -> Column:
        return first_fail(
            [
                ("wanted_or_negated_title", f["wanted"]),
                ("dual_offer", f["dual"]),
                ("sale_title_rental_offer_conflict", f["sale"] & (f["rent"] | f["then_rent"])),
                ("rent_title_sale_opening_conflict", f["rent"] & f["then_sale"]),
                ("explicit_sale_with_cashflow", f["sale"] & f["cash"]),
                ("explicit_sale_title", f["sale"]),
                ("explicit_rental_title", f["rent"] & f["opens_rent"]),
                ("rental_context_without_primary_rental_offer", f["rent"]),
                ("insufficient_primary_title_intent", F.lit(True)),
            ]
        )

    def label(reason: Column) -> Column:
        said = F.when(reason.startswith("explicit_sale"), SALE_LABEL).when(reason == "explicit_rental_title", RENT_LABEL).otherwise(UNCLEAR)
        return F.struct(said.alias("label"), reason.alias("reason"))

    folded = F.struct(fold(F.coalesce(title, F.lit(""))).alias("t"), F.left(fold(F.coalesce(description, F.lit(""))), F.lit(head)).alias("d"))
    return _once(_once(_once(folded, flags), judge), label)


def strict_sale(title: Column) -> Column:
    """A title that offers a sale and neither mentions an offer or wish to rent, nor denies the sale."""
    return _once(fold(F.coalesce(title, F.lit(""))), lambda t: _has(t, STRICT_SALE) & ~_has(t, STRICT_RENT) & ~_has(t, STRICT_NEGATIVE))


def _mentions(text: Column, pattern: str) -> Column:
    """Array of (whole, digits, billions, left, right, joined): the matches of a price pattern and the letters around each.

    ``joined``: only blanks lie between the match and the next one.
    """
    mark = "\x01"
    marked = F.regexp_replace(F.replace(fold(F.coalesce(text, F.lit(""))), F.lit(mark), F.lit(" ")), "(?U)" + pattern, mark + "$0")
    own = "^" + pattern

    def cut(parts: Column, part: Column, i: Column) -> Column:
        start = F.greatest(i + 2 - PARTS, F.lit(1))
        behind = F.array_join(F.slice(parts, i + 2, F.lit(PARTS)), "")
        return F.struct(part.alias("part"), F.right(F.array_join(F.slice(parts, start, i + 2 - start), ""), F.lit(LEFT)).alias("left"), F.left(behind, F.lit(LEFT + 3 * RIGHT)).alias("behind"))

    def read(p: Column) -> Column:
        whole = _first(p["part"], own)
        rest = F.substr(p["part"], F.length(whole) + 1)
        return F.struct(
            whole.alias("whole"), _first(p["part"], own, 1).alias("digits"), _first(p["part"], own, 2).isin("ty", "ti").alias("billions"),
            p["left"].alias("left"), F.substr(p["behind"], F.length(whole) + 1).alias("right"), (~_has(rest, r"\S")).alias("joined"),
        )

    cuts = lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda part, i: cut(parts, part, i))
    return F.transform(_once(F.split(marked, mark), cuts), read)


def _in_order(every: Column) -> Column:
    """The ``out`` of each (keep, eats, joined, out) that the one before has not taken as its own completion."""
    return _once(every, _walk)


def _walk(marked: Column) -> Column:
    none = F.slice(F.transform(marked, lambda m: m["out"]), 1, 0)
    start = F.struct(none.alias("found"), F.lit(False).alias("taken"))
    step = lambda a, m: F.struct(
        F.when(~a["taken"] & m["keep"], F.concat(a["found"], F.array(m["out"]))).otherwise(a["found"]).alias("found"), (~a["taken"] & m["eats"] & m["joined"]).alias("taken")
    )
    return F.aggregate(marked, start, step, lambda a: a["found"])


def _clause(left: Column, ends: str) -> Column:
    return F.regexp_extract(left, f"([^{ends}]*)$", 1)


def stated_prices(text: Column, source: str, area: Column) -> Column:
    """Array of (source, basis, amount, total, approximate, excerpt): the sale prices that a text states.

    ``basis`` is total, per_m2 or other_area_rate; ``total`` is null where it would need an area that is missing, or
    for other rates. Numbers with two readings, hidden digits and unknown completions are left out.
    """
    size = F.when((area > 0) & (area < float("inf")), area)

    def judge(m: Column) -> Column:
        near = F.left(m["right"], F.lit(RIGHT))
        clause = _clause(m["left"], ";\\n!•")
        unclear = m["digits"].rlike(r"^\d{1,3}[.,]\d{3}$") & ~m["digits"].startswith("0")
        grouped = m["digits"].rlike(r"^\d{1,3}([.,]\d{3}){2,}$")
        number = F.when(unclear, None).when(grouped, F.regexp_replace(m["digits"], "[.,]", "").try_cast("double")).otherwise(F.replace(m["digits"], F.lit(","), F.lit(".")).try_cast("double"))
        refused = _has(m["left"], AREA_BEFORE) | (_has(clause, EXCLUDE) & ~_has(clause, NAMED_PRICE)) | _has(near, PERIOD_RATE) | _has(near, HIDDEN)
        return F.struct(
            m.alias("m"), clause.alias("clause"), number.alias("number"), (~refused & F.coalesce(number > 0, F.lit(False))).alias("fits"),
            F.when(m["billions"], _first(near, MILLIONS_BEHIND)).otherwise("").alias("millions"), F.when(m["billions"], _first(near, DECIMALS_BEHIND)).otherwise("").alias("decimals"),
            (m["billions"] & _has(near, r"^\s*\d")).alias("goes_on"),
        )

    def price(j: Column) -> Column:
        tail = F.when(j["millions"] != "", j["millions"]).otherwise(j["decimals"])
        digits = F.regexp_extract(tail, r"(\d+)", 1)
        more = F.when(tail == "", 0.0).when(j["millions"] != "", digits.try_cast("double") * 1e6).otherwise(digits.try_cast("double") * F.pow(F.lit(10.0), 9 - F.length(digits)))
        behind = F.substr(j["m"]["right"], F.length(tail) + 1)
        return F.struct(j.alias("j"), tail.alias("tail"), (j["number"] * F.when(j["m"]["billions"], 1e9).otherwise(1e6) + more).alias("amount"), F.left(behind, F.lit(RIGHT)).alias("behind"))

    def mark(p: Column) -> Column:
        j, tailed = p["j"], p["tail"] != ""
        rate = _has(p["behind"], PER_M2)
        other = _has(p["behind"], OTHER_RATE) & ~rate
        out = F.struct(
            F.lit(source).alias("source"), F.when(other, "other_area_rate").when(rate, "per_m2").otherwise("total").alias("basis"), p["amount"].alias("amount"),
            F.when(other, None).when(rate, p["amount"] * size).otherwise(p["amount"]).alias("total"), _has(j["clause"], APPROXIMATE).alias("approximate"),
            F.concat(F.right(j["m"]["left"], F.lit(SHOWN_LEFT)), j["m"]["whole"], p["tail"], F.left(p["behind"], F.lit(SHOWN_RIGHT))).alias("excerpt"),
        )
        return F.struct((j["fits"] & (tailed | ~j["goes_on"])).alias("keep"), (j["fits"] & tailed).alias("eats"), j["m"]["joined"].alias("joined"), out.alias("out"))

    return _in_order(F.transform(F.transform(F.transform(_mentions(text, PRICE), judge), price), mark))


def listing_prices(title: Column, description: Column, area: Column) -> Column:
    size = area.cast("double")
    return F.concat(stated_prices(title, "title", size), stated_prices(description, "description", size))


def total_prices(text: Column) -> Column:
    """Array of the total prices in VND that a text states, by the stricter rules of verified sales."""

    def judge(m: Column) -> Column:
        clause = _clause(m["left"], ";\\n.!")
        tail = F.when(m["billions"], _first(m["right"], TOTAL_TAIL)).otherwise("")
        amount = F.replace(m["digits"], F.lit(","), F.lit(".")).try_cast("double") * F.when(m["billions"], 1e9).otherwise(1e6) + F.when(tail != "", F.regexp_extract(tail, r"(\d{3})", 1).try_cast("double") * 1e6).otherwise(0.0)
        return F.struct((~_has(clause, TOTAL_CONTEXT) | _has(clause, NAMED_PRICE)).alias("fits"), tail.alias("tail"), amount.alias("amount"), F.substr(m["right"], F.length(tail) + 1).alias("behind"), m["joined"].alias("joined"))

    def mark(j: Column) -> Column:
        kept = j["fits"] & ~_has(j["behind"], TOTAL_RATE) & ~_has(j["behind"], TOTAL_FOREIGN) & ~_has(j["behind"], TOTAL_UNSURE) & F.coalesce((j["amount"] > 0) & (j["amount"] < float("inf")), F.lit(False))
        return F.struct(kept.alias("keep"), (j["fits"] & (j["tail"] != "")).alias("eats"), j["joined"].alias("joined"), j["amount"].alias("out"))

    return _in_order(F.transform(F.transform(_mentions(text, TOTAL), judge), mark))


def verified_price(title: Column, description: Column, stored: Column, tolerance: float = 0.05) -> Column:
    """The stored price if the text states any total and every one of them lies within ``tolerance`` of it, else null."""
    s = stored.try_cast("double")
    agreed = _once(F.concat(total_prices(title), total_prices(description)), lambda stated: (F.size(stated) > 0) & F.forall(stated, lambda v: F.abs(v - s) / v <= tolerance))
    return F.when((s > 0) & (s < float("inf")) & agreed, s)


def _near(a: Column, b: Column, of: Column, tolerance: float) -> Column:
    return F.abs(a - b) / of <= tolerance


def reference_price(prices: Column, tolerance: float = 0.01) -> Column:
    """struct(value, reason): the one price that the title, or else the description, states.

    Prices within ``tolerance`` of the first count as one. A rate of another area unit anywhere, or a total
    that repeats the figure of a rate, makes the text unusable.
    """
    return _once(prices, lambda p: _reference(p, tolerance))


def _reference(prices: Column, tolerance: float) -> Column:
    basis = lambda name: F.filter(prices, lambda p: p["basis"] == name)
    rates, totals = basis("per_m2"), basis("total")
    clash = F.exists(rates, lambda r: F.exists(totals, lambda t: _near(t["amount"], r["amount"], r["amount"], tolerance) & F.coalesce(~_near(t["amount"], r["total"], r["total"], tolerance), F.lit(False))))
    titles = F.filter(prices, lambda p: p["source"] == "title")
    values = F.filter(F.transform(F.when(F.size(titles) > 0, titles).otherwise(prices), lambda p: p["total"]), lambda v: v.isNotNull())
    return _once(values, lambda v: _verdict(v, F.size(titles) > 0, F.size(basis("other_area_rate")) > 0, clash, tolerance))


def _verdict(values: Column, titled: Column, other_rate: Column, clash: Column, tolerance: float) -> Column:
    first = F.try_element_at(values, F.lit(1))
    one = F.forall(values, lambda v: _near(v, first, F.greatest(v, first), tolerance))
    reason = (
        F.when(other_rate, "unsupported_area_rate_basis").when(clash, "conflicting_total_and_rate_basis").when(F.size(values) == 0, "no_supported_reference").when(~one, "multiple_reference_amounts")
        .when(titled, "title_reference").otherwise("description_reference")
    )
    return _once(reason, lambda r: F.struct(F.when(r.isin("title_reference", "description_reference"), first).alias("value"), r.alias("reason")))


def target_basis(price: Column, prices: Column, tolerance: float = 0.02) -> Column:
    """struct(label, reason): whether a stored price in millions is a total or a rate, by the text alone."""

    def facts(p: Column) -> Column:
        titles = F.filter(p, lambda x: x["source"] == "title")
        rates = F.filter(F.when(F.size(titles) > 0, titles).otherwise(p), lambda x: x["basis"] == "per_m2")
        return F.struct(_reference(p, 0.01).alias("reference"), F.exists(rates, lambda r: _near(price * 1e6, r["amount"], r["amount"], tolerance)).alias("rate"))

    def judge(f: Column) -> Column:
        value, rate = f["reference"]["value"], F.coalesce(f["rate"], F.lit(False))
        usable = F.coalesce(value.isNotNull() & (price > 0) & (price < float("inf")), F.lit(False))
        total = _near(price * 1e6, value, value, tolerance)
        reason = F.when(~usable, f["reference"]["reason"]).when(total & ~rate, "matches_text_total_or_rate_times_area").when(rate & ~total, "matches_explicit_text_rate").when(total, "total_rate_indistinguishable").otherwise("text_price_mismatch")
        label = F.when(usable & total & ~rate, "TOTAL_PRICE").when(usable & rate & ~total, "PRICE_PER_M2").otherwise(UNCLEAR)
        return F.struct(label.alias("label"), reason.alias("reason"))

    return _once(_once(prices, facts), judge)
