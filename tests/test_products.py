"""The product flows end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import forecasting
from millrace.plans import products


def test_table_analysis(spark):
    rows = [(f"2024-01-{i % 28 + 1:02d}", "north" if i % 2 else "south", str(i * 1.5), "") for i in range(60)]
    out = products.analyze_table(spark.createDataFrame(rows, "`Ngày` string, Region string, Sales string, blank string"))
    assert out["kinds"] == {"ngay": "date", "region": "category", "sales": "numeric"} and out["report"]["empty_columns"] == 1
    assert [c["chart"] for c in out["charts"]] == ["line", "bar"]
    assert out["charts"][1]["data"].count() == 2 and out["profile"].first()["n_valid"] == 60


def test_forecast_flow(spark):
    rows = [((dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(), str(100 + 20 * (i % 7))) for i in range(120) if i != 50]
    series, frequency = products.prepare_series(spark.createDataFrame(rows, "d string, v string"), "d", "v")
    assert frequency == "daily" and series.count() == 120 and series.filter("is_missing").count() == 1
    out = products.forecast_sales(series, frequency, 14, floor_at_zero=True)
    ranked = [r["model"] for r in out["ranking"].orderBy("rank").collect()]
    assert sorted(ranked) == sorted(forecasting.MODELS) and out["model"] == ranked[0] and out["forecast"].count() == 14
    out = products.forecast_sales(series, frequency, 14, floor_at_zero=True, models=(forecasting.NAIVE, forecasting.SEASONAL))
    assert out["model"] == "Seasonal Naive" and out["forecast"].count() == 14
    assert {r["prediction"] for r in out["forecast"].collect()} <= {100.0 + 20 * k for k in range(7)}
    assert out["summary"].first()["total"] > 0 and out["season"].filter("detected").count() > 0
    with pytest.raises(ValueError):
        products.prepare_series(spark.createDataFrame([("2024-01-01", "1,234")] * 4, "d string, v string"), "d", "v")


def test_customer_flow(spark):
    rows = [
        ("a", "o1", "2024-01-01", "1", "10", "VN", "p1", "", "5", "x"), ("a", "o1", "2024-01-01", "1", "10", "VN", "p1", "", "1", ""), ("a", "o2", "2024-03-01", "2", "10", "UK", "p2", "", "", ""),
        ("b", "o3", "2024-02-30", "1", "10", "VN", "p1", "", "", ""), ("b", "o4", "2024-02-01", "-1", "10", "VN", "p1", "", "", ""), ("b", "o5", "2024-02-01", "1", "10", "VN", "p1", "Đã hủy", "", ""), ("c", "o6", "2024-03-31", "1", "10", "VN", "p1", "", "", ""), ("", "o7", "2024-03-01", "1", "10", "VN", "p1", "", "", ""),
    ]
    raw = spark.createDataFrame(rows, "customer string, `order` string, date string, quantity string, value string, country string, product string, status string, rating string, feedback string").coalesce(1)
    tx, counts = products.prepare_transactions(raw)
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"kept": 3, "exact_repeat": 1, "invalid_date": 1, "not_positive": 1, "cancelled_or_refunded": 1, "missing_or_long_key": 1}
    f = products.customer_features(tx, F.lit("2024-03-31"))
    (a,) = f.collect()
    assert (a["customer"], a["recency_days"], a["tenure_days"], a["orders_90d"], a["monetary_90d"], a["products_90d"], a["avg_purchase_gap_days"], a["country"]) == ("a", 30, 90, 2, 30.0, 2, 60.0, "UK")
    scored, summary = products.score_customers(f, F.lit(0.7))
    assert scored.first()["band"] == "HIGH" and summary.first()["returning"] == 1


def test_market_flow(spark):
    rows = [("Bán nhà 5 tỷ", "đẹp", "house", "Hà Nội", "Ba Đình", "5000000000", 100.0, "2025-07-01")] * 2 + [("Cho thuê nhà", "", "house", "Hà Nội", "Ba Đình", "5000000000", 100.0, "2025-07-01"), ("Bán nhà 9 tỷ", "", "house", "Hà Nội", "Ba Đình", "5000000000", 100.0, "2025-07-01"), ("Bán nhà 5 tỷ", "", "house", "X", "Ba Đình", "5000000000", 100.0, "2025-07-01")]
    raw = spark.createDataFrame(rows, "name string, description string, property_type_name string, province_name string, district_name string, price string, area double, published_at string")
    sales, counts = products.verified_sales(raw, {"ha noi": "Hà Nội"})
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"kept": 2, "intent": 1, "unverified_total_price": 1, "unknown_province": 1}
    assert sales.count() == 1
    assert {r["coverage"] for r in products.market_statistics(sales).collect()} == {"INSUFFICIENT"}


def test_health_flow(spark):
    model = {"intercept": 0.5, "features": {"age": {"coefficient": 1.0, "mean": 50, "scale": 10, "median": 55}, "chol": {"coefficient": -0.5, "mean": 200, "scale": 50, "median": 210}}}
    out = products.health_risk(spark.createDataFrame([("60", "?"), ("?", "250")], "age string, chol string"), model).collect()
    assert [round(r["c_age"], 3) for r in out] == [1.0, 0.5] and [round(r["c_chol"], 3) for r in out] == [-0.1, -0.5]
    assert out[0]["predicted"] == 1
