"""The later listing rules, by cases."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import saletext


def each(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


PRICED = "t string, d string, area double"


def prices():
    return saletext.listing_prices(F.col("t"), F.col("d"), F.col("area"))


def test_amounts(spark):
    cases = [("2,7 tỷ", 2.7e9), ("2.7 tỷ", 2.7e9), ("2 tỷ 700 triệu", 2.7e9), ("850 triệu", 850e6), ("12 tỷ 500 triệu", 12.5e9), ("7 tỷ 500", 7.5e9), ("1ty560", 1.56e9), ("3tỷ450", 3.45e9), ("5 ty 2", 5.2e9), ("1.250.000 tr", 1.25e12), ("0.500 tỷ", 5e8)]
    got = each(spark, [("Bán nhà giá " + t, "", 50.0) for t, _ in cases], PRICED, prices())
    for (text, total), found in zip(cases, got):
        assert len(found) == 1 and math.isclose(found[0]["total"], total) and found[0]["basis"] == "total", text
    assert [r["value"] for r in each(spark, [("Giá " + t, "", 50.0) for t, _ in cases], PRICED, saletext.reference_price(prices()))] == [f[0]["total"] for f in got]


@pytest.mark.parametrize("text", ["Bán nhà giá 2.700 tỷ", "Căn hộ 2PN89m23.4tỷ", "Giảm 200tr", "Vốn 710tr", "Bán nhà giá 6 tỷ x", "vay tối đa 963tr.", "thu nhập 5 tỷ 200 triệu", "30 triệu/tháng", "5ty2000", "", None])
def test_no_sale_price(spark, text):
    assert each(spark, [(text, None, 89.0), (None, text, 89.0)], PRICED, prices()) == [[], []]


def test_bases_and_excerpts(spark):
    rows = [("Bán đất giá 65 triệu/m²", "", 50.0), ("Bán đất giá 65 triệu/m²", "", None), ("Bán đất giá 30 triệu VND/m²", "", 40.0), *[("Bán đất giá 65 triệu" + s, "", 50.0) for s in ("/ha", "/công", "/mét ngang", "/sào")], ("giá bán: 4 tỷ, khoảng 5 tỷ", "thuê; 6 tỷ 100 triệu 300 triệu", 1.0)]
    got = each(spark, rows, PRICED, prices())
    assert [(f[0]["basis"], f[0]["total"]) for f in got[:3]] == [("per_m2", 3.25e9), ("per_m2", None), ("per_m2", 1.2e9)]
    assert {f[0]["basis"] for f in got[3:7]} == {"other_area_rate"} and all(f[0]["total"] is None for f in got[3:7])
    assert [(p["source"], p["total"], p["approximate"]) for p in got[7]] == [("title", 4e9, False), ("title", 5e9, True), ("description", 6.1e9, False), ("description", 3e8, False)]
    assert got[7][0]["excerpt"] == "gia ban: 4 ty, khoang 5 ty" and got[7][2]["excerpt"] == "thue; 6 ty 100 trieu 300 trieu"


def test_many_prices_are_read_in_linear_context(spark):
    (found,) = each(spark, [(" ".join(f"{k} tỷ;" for k in range(1, 400)), "", 1.0)], PRICED, prices())
    assert [p["total"] for p in found] == [k * 1e9 for k in range(1, 400)]


def test_reference_and_target(spark):
    rows = [
        ("Bán nhà giá 2,7 tỷ hoặc 3,5 tỷ", "", 50.0, 2700.0), ("Bán vườn giá 190 triệu", "Giá 190 triệu/sào", 5514.6, 190.0), ("Bán đất 2 tỷ/m²", "Giá 2 tỷ", 52.0, 2000.0), ("Bán nhà 4 tầng giá 2 tỷ", "", 50.0, 2000.0), ("Bán nhà", "Giá 2 tỷ, bao phí 2,01 tỷ", 50.0, 1990.0),
        ("Bán đất giá 65 triệu/m²", "", 50.0, 65.0), ("Bán đất giá 65 triệu/m²", "", 50.0, 3250.0), ("Bán đất giá 65 triệu/m²", "", None, 65.0), ("Bán đất giá 30 triệu VND/m²", "", 40.0, 1200.0), ("Bán đất giá 65 triệu/m²", "", 1.0, 65.0), ("Bán nhà giá 3 tỷ", "", 50.0, None), ("Bán nhà giá 3 tỷ", "", 50.0, 3500.0),
    ]
    got = each(spark, rows, PRICED + ", p double", F.struct(saletext.reference_price(prices()).alias("r"), saletext.target_basis(F.col("p"), prices()).alias("b")))
    assert [(g["r"]["value"], g["r"]["reason"]) for g in got] == [
        (None, "multiple_reference_amounts"), (None, "unsupported_area_rate_basis"), (None, "conflicting_total_and_rate_basis"), (2e9, "title_reference"), (2e9, "description_reference"),
        (3.25e9, "title_reference"), (3.25e9, "title_reference"), (None, "no_supported_reference"), (1.2e9, "title_reference"), (6.5e7, "title_reference"), (3e9, "title_reference"), (3e9, "title_reference"),
    ]
    assert [g["b"]["label"] for g in got] == ["AMBIGUOUS"] * 3 + ["TOTAL_PRICE"] * 2 + ["PRICE_PER_M2", "TOTAL_PRICE", "AMBIGUOUS", "TOTAL_PRICE"] + ["AMBIGUOUS"] * 3
    assert [g["b"]["reason"] for g in got[-3:]] == ["total_rate_indistinguishable", "title_reference", "text_price_mismatch"]


def test_intent(spark):
    rows = {
        ("Bán nhà đang cho thuê, dòng tiền ổn định", ""): ("SALE_HIGH_CONFIDENCE", "explicit_sale_with_cashflow"), ("Bán hoặc cho thuê nhà", ""): ("AMBIGUOUS", "dual_offer"), ("Cần mua nhà", ""): ("AMBIGUOUS", "wanted_or_negated_title"),
        ("Cần thuê căn hộ", None): ("AMBIGUOUS", "wanted_or_negated_title"), ("Rao bán kho", ""): ("SALE_HIGH_CONFIDENCE", "explicit_sale_title"), ("Cho thuê căn hộ", ""): ("RENT_HIGH_CONFIDENCE", "explicit_rental_title"),
        ("Cho thuê căn hộ", "- Bán gấp"): ("AMBIGUOUS", "rent_title_sale_opening_conflict"), ("Bán nhà", "Chính chủ cho thuê"): ("AMBIGUOUS", "sale_title_rental_offer_conflict"), ("Căn hộ 15 triệu/tháng", ""): ("AMBIGUOUS", "rental_context_without_primary_rental_offer"),
        ("Căn hộ 15 triệu/tháng", "For rent now"): ("RENT_HIGH_CONFIDENCE", "explicit_rental_title"), (None, None): ("AMBIGUOUS", "insufficient_primary_title_intent"), ("Bán nhà", " " * 301 + "cho thuê"): ("SALE_HIGH_CONFIDENCE", "explicit_sale_title"),
    }
    got = each(spark, list(rows), "t string, d string", saletext.intent(F.col("t"), F.col("d")))
    assert [(g["label"], g["reason"]) for g in got] == list(rows.values())


def test_strict_sale_and_verified_price(spark):
    titles = {"Bán nhà": True, "Chuyển nhượng đất": True, "Bán nhà cho thuê": False, "Bán và cho thuê": False, "Không bán": False, "Nhà đẹp": False, "Bán nhà tìm người thuê": False, None: False}
    assert each(spark, [(t,) for t in titles], "t string", saletext.strict_sale(F.col("t"))) == list(titles.values())
    rows = [
        ("Bán nhà 5 tỷ", "", "5e9", 5e9), ("Bán nhà 5 tỷ 200", "", "5200000000", 5.2e9), ("Bán nhà 5 tỷ 200 triệu", "giá 5,3 tỷ", "5200000000", 5.2e9), ("Bán nhà 5 tỷ", "hoặc 9 tỷ", "5000000000", None), ("Bán nhà 5 tỷ 2", "", "5000000000", 5e9), ("Bán nhà 5 tỷ 2 tỷ", "", "2000000000", 2e9),
        ("Bán 50 triệu/m2, tổng 5 tỷ", "", "5000000000", 5e9), ("Giá gốc 9 tỷ; bán 5 tỷ", "", "5000000000", 5e9), ("Bán 5 tỷ", "5 triệu usd", "5000000000", 5e9), ("Bán nhà", "", "5000000000", None), ("Bán 5 tỷ", "", "x", None), ("Bán 5 tỷ", "", None, None),
    ]
    got = each(spark, [r[:3] for r in rows], "t string, d string, s string", saletext.verified_price(F.col("t"), F.col("d"), F.col("s")))
    assert got == [r[3] for r in rows]
