"""Single operators on small vectors."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric, parse, text
from millrace.operators import aggregates, cleaning, compare, filters, joins, market, metrics, profiling, sampling, scoring, textrules, timeseries, windows
from millrace.sources import files, sinks
from millrace.streaming import feed


def values(spark, expr, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i long, c {kind}")
    return [r["x"] for r in df.select("i", expr(F.col("c")).alias("x")).orderBy("i").collect()]


def test_numbers_by_locale(spark):
    cells = ["1,234.56", "1.234,56", "12,5", "1,234", "-7", "1e3", "1d", "NaN", "Infinity", "", None, "1_000", " 5 ", "1.5.5", "1,5"]
    assert values(spark, parse.locale_number, cells) == [1234.56, 1234.56, 12.5, None, -7.0, 1000.0, None, None, None, None, None, None, 5.0, None, 1.5]
    assert values(spark, lambda c: parse.locale_number(c, True), ["1,234", "1,2"]) == [1.234, 1.2]
    assert values(spark, lambda c: parse.convention_number(c, "decimal_comma"), ["1.234", "1,5", "12.5", "1.234,5"]) == [1234.0, 1.5, None, 1234.5]
    assert values(spark, lambda c: parse.convention_number(c, "decimal_dot"), ["1,234", "1,5", "12.5", "1,234.5"]) == [1234.0, None, 12.5, 1234.5]
    assert values(spark, lambda c: parse.grouped_number(c, "comma"), ["1.234,5", "1234", "1,234.5", "12,34"]) == [1234.5, 1234.0, None, 12.34]
    assert values(spark, parse.symbol_number, ["$1200", "5 %", "€ 3.5", "x", "1d"]) == [1200.0, 5.0, 3.5, None, None]


def test_decimal_comma_needs_evidence(spark):
    df = spark.createDataFrame([("1,5", "1,5"), ("2,25", "2.5"), ("1,234", "2,5")], "a string, b string")
    assert parse.decimal_comma_evidence(df, ["a", "b"]) == {"a": True, "b": False}


def test_money_area_and_relative_time(spark):
    assert values(spark, parse.vn_money, ["22,96 tỷ", "1.250 triệu", "5 tỷ", "5 usd"]) == [2.296e10, 1.25e9, 5e9, None]
    assert values(spark, parse.vn_area, ["4.667 m²", "87,5 m2", "x"]) == [4667.0, 87.5, None]
    assert values(spark, text.relative_seconds, ["5 ngày trước", "2 giờ trước", "hôm nay"]) == [432000, 7200, None]


def test_dates(spark):
    t = lambda *a: dt.datetime(*a)
    cells = ["2024-02-29", "2023-02-29", "31/12/2020", "12/31/2020", "03/04/2020", "05/05/2020", "2020-01-02T03:04:05+02:00", "2021/7", "x", None]
    assert values(spark, parse.parse_date, cells) == [t(2024, 2, 29), None, t(2020, 12, 31), t(2020, 12, 31), None, t(2020, 5, 5), t(2020, 1, 2, 1, 4, 5), t(2021, 7, 1), None, None]
    assert values(spark, lambda c: parse.parse_date(c, "day_first"), ["03/04/2020", "13/13/2020"]) == [t(2020, 4, 3), None]
    df = lambda *c: spark.createDataFrame([(x,) for x in c], "d string")
    assert parse.date_order(df("13/01/2020", "01/02/2020"), "d") == ("day_first", False)
    assert parse.date_order(df("01/02/2020"), "d") == ("auto", True)
    with pytest.raises(ValueError):
        parse.date_order(df("13/01/2020", "01/13/2020"), "d")
    assert values(spark, parse.excel_date, [1.5, 45000.0, 0.0], "double") == [t(1899, 12, 31, 12), t(2023, 3, 15), None]


def test_format_vote(spark):
    df = spark.createDataFrame([("31/01/2020", "1.234,5", "5"), ("01/02/2020", "7", "x")], "d string, q string, v string")
    assert parse.vote_formats(df, "d", ["q", "v"]) == {"date": "DMY", "number": "comma"}
    neutral = spark.createDataFrame([("2020-01-02", "7", "5")], "d string, q string, v string")
    assert parse.vote_formats(neutral, "d", ["q", "v"]) == {"date": "ISO", "number": "dot"}


def test_headers_and_mapping():
    assert text.snake_headers(["Tên Đường", "", "a b", "A-B", "a b"]) == ["ten_duong", "column_2", "a_b", "a_b_2", "a_b_3"]
    assert text.trimmed_headers([" a ", "", "a"]) == ["a", "unnamed_2", "a_2"]
    assert text.map_columns(["Customer ID", "Invoice No", "Sku", "Product"], {"customer": ["customerid"], "product": ["sku", "product"], "date": ["date"]}, {"product": ["sku"]}) == {"customer": "Customer ID", "product": "Sku", "date": None}
    with pytest.raises(ValueError):
        text.reject_headers(["a", "A "])


def test_rounding_and_bands(spark):
    assert values(spark, lambda c: numeric.round_even(c, 2), [0.125, 2.675, 0.135], "double") == [0.12, 2.68, 0.14]
    assert values(spark, numeric.sigmoid, [0.0, 800.0, -800.0], "double") == [0.5, 1.0, 0.0]
    assert values(spark, scoring.band, [0.1, 0.5, 0.9], "double") == ["LOW", "MEDIUM", "HIGH"]


def test_cleaning_counts_both_dedupes(spark):
    rows = [("1", "x", ""), ("1", "x", ""), ("", "x", ""), ("3", "", ""), ("", "", ""), ("2", "x", " ")]
    out, report = cleaning.clean_table(spark.createDataFrame(rows, "`Số` string, b string, c string").coalesce(1))
    assert report == {"missing": 2, "duplicates": 2, "empty_columns": 1, "empty_rows": 1}
    assert sorted((r["so"], r["b"]) for r in out.collect()) == [(1.0, "x"), (2.0, "x"), (3.0, "x")]


def test_grouped_rounds_and_drops(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.005), (None, 5.0), ("b", None)], "x string, y double")
    assert [tuple(r) for r in aggregates.grouped(df, "x", "y").collect()] == [("a", 1.5)]


def test_feed_aggregates(spark):
    rows = [(f"l{i}", "SALE", "VND", "m2", i * 1e9, 100.0, "P", "A", "house", dt.datetime(2024, 1, i)) for i in range(1, 6)]
    bad = [("l1", *rows[0][1:]), ("", *rows[0][1:]), ("z", "RENT", *rows[0][2:]), ("y", *rows[0][1:4], -1.0, *rows[0][5:])]
    good = feed.valid_records(spark.createDataFrame(rows + bad, feed.FEED), now="2025-01-01")
    stats = feed.market_stats(good).collect()
    assert good.count() == 5 and len(stats) == 4
    assert {(r["p25"], r["median"], r["p75"], r["n"]) for r in stats} == {(2e7, 3e7, 4e7, 5)}
    assert feed.market_stats(good.limit(4)).count() == 0


def test_feed_stream(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    for part in range(2):
        lines = [json.dumps({"listing_id": f"{part}-{i}", "transaction_type": "SALE", "currency": "VND", "area_unit": "m2", "total_price_vnd": 1e9 * i, "area_m2": 50, "province": "P", "area_name": "A", "property_type": "house", "date": "2024-01-01T00:00:00Z"}) for i in range(1, 4)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
    q = feed.publish_stream(spark, str(tmp_path / "in"), str(tmp_path / "records"), str(tmp_path / "stats"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "records")).count() == 6
    assert {r["n"] for r in sinks.read_table(spark, str(tmp_path / "stats")).collect()} == {6}


def test_funnel_takes_the_first_reason(spark):
    df = spark.createDataFrame([(1, None), (-1, 5), (2, 9)], "a int, b int")
    out = filters.funnel(df, [("low", F.col("a") < 0), ("b", F.col("b") > 4)]).orderBy("a").collect()
    assert [r["reason"] for r in out] == ["low", "kept", "b"]


def test_weighted_quantile_ties(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 1.0), ("k", 2.0, 1.0), ("k", 9.0, 1.0)], "g string, v double, w double")
    r = aggregates.weighted_quantiles(df, ["g"], "v", "w").first()
    assert (r["q25"], r["q50"], r["q75"]) == (1.0, 2.0, 2.0)


def test_resolution_levels(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "i int, p string, w string")
    ward = spark.createDataFrame([("a", "x", 50, 1.0), ("a", "y", 3, 2.0)], "p string, w string, n long, v double")
    prov = spark.createDataFrame([("a", 90, 5.0)], "p string, n long, v double")
    out = joins.resolve_levels(df, [("WARD", ward, ["p", "w"], 30), ("PROVINCE", prov, ["p"], 30)], "v").orderBy("i").collect()
    assert [(r["resolution_level"], r["resolved_value"]) for r in out] == [("WARD", 1.0), ("PROVINCE", 5.0), ("NONE", None)]


def test_intent_and_prices(spark):
    rows = [("Bán nhà mặt tiền đang cho thuê 20tr/tháng", ""), ("Cho thuê căn hộ", "bán nhà"), ("Cần mua đất", ""), ("Bán hoặc cho thuê nhà", ""), ("Nhà đẹp", "")]
    out = textrules.intent(spark.createDataFrame(rows, "t string, d string"), "t", "d").collect()
    assert [r["rule_label"] for r in out] == [textrules.SALE_LABEL, textrules.UNCLEAR, textrules.UNCLEAR, textrules.UNCLEAR, textrules.UNCLEAR]
    cases = [
        ("Giá bán 5 tỷ 200 triệu", None, [5_200_000_000]),
        ("bán 5ty250", None, [5_250_000_000]),
        ("bán 5 tỷ 250", None, [5_000_000_000]),
        ("85 triệu/m2", 100.0, [8_500_000_000]),
        ("85 triệu/m2", None, []),
        ("thu nhập 30 triệu; giá bán 4,5 tỷ", None, [4_500_000_000]),
        ("thu nhập 30 triệu, giá bán: 4,5 tỷ", None, [4_500_000_000]),
        ("cho thuê 15 triệu/tháng", None, []),
        ("đặt cọc 200 triệu", None, []),
        ("2 tỷ usd", None, []),
        ("2 tỷ hoặc 3.250 triệu", None, [2_000_000_000, 3_250_000_000]),
        ("1.250.000 triệu, mười tỷ", None, [1_250_000_000_000]),
        ("1.2.3 tỷ, 7 tyx", None, []),
        (None, 1.0, []),
    ]
    priced = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "i int, t string, a double").withColumn("p", textrules.price_mentions(F.col("t"), "title", F.col("a")))
    assert [[round(x) for x in r[0]] for r in priced.orderBy("i").select(F.transform("p", lambda x: x["total"])).collect()] == [want for *_, want in cases]
    unclear = spark.createDataFrame([("3.250 tỷ",)], "t string").select(textrules.price_mentions(F.col("t"), "title", F.lit(None).cast("double"), strict=True))
    assert unclear.first()[0] == []


def test_reference_and_basis(spark):
    df = spark.createDataFrame([("giá 5 tỷ", "5,02 tỷ", 100.0, 5e9), ("5 tỷ và 6 tỷ", None, 50.0, 5e9), (None, "50 triệu/m2", 100.0, 5e7), (None, None, 1.0, 1.0)], "t string, d string, a double, p double")
    rows = textrules.extract_prices(df, "t", "d", "a").withColumn("r", textrules.reference_price(F.col("prices")))
    out = rows.select("r.value", "r.reason", textrules.target_basis(F.col("p"), F.col("a"), F.col("r.value")).alias("b"), textrules.comparison(F.col("p"), F.col("r.value"), F.col("r.reason")).alias("c")).collect()
    assert [tuple(r) for r in out] == [(5e9, "title", "TOTAL_PRICE", "matched_2pct"), (None, "multiple_text_prices", "AMBIGUOUS", "multiple_text_prices"), (5e9, "description", "PRICE_PER_M2", "mismatch"), (None, "no_supported_price", "AMBIGUOUS", "no_supported_price")]


def test_property_type(spark):
    cases = [
        ("Bán nhà mặt tiền đường lớn", "Nhà", "STREET_HOUSE"), ("Bán nhà riêng", "Nhà", "HOUSE"), ("Bán nhà mặt phố, có ngõ sau", "Nhà", None), ("Bán căn hộ", "Nhà", None),
        ("Bán nhà xưởng trong ngõ", "Nhà", None), ("Chưa bán nhà riêng", "Nhà", None), ("Bánh trong ngõ", "Nhà", None), ("Chuyển  nhượng liền kề", "Biệt thự/Nhà liền kề", "VILLA"),
        ("Bán lô góc", "Đất", "LAND"), ("Bán đồng", "Đất", None), ("bán SHOPHOUSE", "Shophouse", "SHOPHOUSE"), ("Bán nhà riêng", None, None), (None, "Nhà", None), ("Bán nhà riêng", "khác", None),
    ]
    df = spark.createDataFrame(cases, "t string, s string, want string").withColumn("kind", textrules.property_type(F.col("t"), F.col("s")))
    assert [r["kind"] for r in df.collect()] == [c[2] for c in cases]


def test_relative_times(spark):
    from datetime import datetime, timedelta

    phrases = ["5 ngày trước", "2 giờ trước", "1 tháng trước", "đăng 5 ngày trước", "5 ngay trước", "hôm nay", None]
    assert values(spark, text.phrase_seconds, phrases) == [432000, 7200, 2592000, None, None, None, None]
    seen = datetime(2024, 5, 1, 12)
    rows = [("5 ngày trước", seen, seen - timedelta(days=5, seconds=60)), ("2 giờ trước", seen, seen - timedelta(hours=2, seconds=61)), ("1 tuần trước", seen, None), ("mới", seen, seen)]
    df = spark.createDataFrame(rows, "p string, seen timestamp, stated timestamp")
    assert tuple(profiling.relative_time_check(df, "p", "seen", "stated").first()) == (4, 3, 1, 60.5)
    assert tuple(profiling.relative_time_check(df.limit(0), "p", "seen", "stated").first()) == (0, 0, 0, None)
    assert [tuple(r) for r in profiling.unsupported_phrases(df, "p").collect()] == [("mới", 1)]


def test_merged_units(spark):
    df = spark.createDataFrame([("nhập Xã A, Xã B và Xã C thành Xã D; nhập một phần Xã E thành Xã F. nhập Xã A thành Xã G",)], "text string")
    assert sorted(tuple(r) for r in textrules.merged_units(df).collect()) == [("Xã B", "Xã D"), ("Xã C", "Xã D")]


def test_walk_forward_plan():
    assert sampling.walk_forward_plan(10, 5)["folds"] == []
    plan = sampling.walk_forward_plan(100, 10)
    assert plan["holdout_start"] == 80 and [f["train_end"] for f in plan["folds"]] == [50, 60, 70] and plan["ranking_source"] == "backtest_rmse"
    assert len(sampling.walk_forward_plan(300, 90)["folds"]) == 5
    for n in range(12, 700, 7):
        for horizon in (1, 9, 90):
            plan = sampling.walk_forward_plan(n, horizon)
            edges = [plan["folds"][0]["train_end"]] + [f["validation_end"] for f in plan["folds"]]
            assert edges[-1] == plan["holdout_start"] == n - min(90, max(2, n // 5)) and edges == sorted(set(edges)) and edges[0] > 0
            assert len({b - a for a, b in zip(edges, edges[1:])}) == 1 and edges[1] - edges[0] <= min(horizon, 60)


def test_features_never_see_the_present(spark):
    s = spark.createDataFrame([(t, float(t * t)) for t in range(20)], "t long, y double")
    changed = s.withColumn("y", F.when(F.col("t") >= 10, 1e6).otherwise(F.col("y")))
    pick = lambda d: [tuple(r)[2:] for r in windows.lag_features(d, "y", "t", [1, 2], [3], [3]).filter("t <= 10").orderBy("t").collect()]
    assert pick(s) == pick(changed)


def test_recursive_forecast_of_a_line(spark):
    rows = [("a", t, dt.datetime(2024, 1, 1) + dt.timedelta(days=t), 3.0 + 2 * t) for t in range(60)]
    s = spark.createDataFrame(rows, "k string, t long, period timestamp, y double")
    out = timeseries.forecast_linear(s, ["k"], "daily", 5).orderBy("step").collect()
    # calendar features follow the line too, so that the fit is exact but not its split between them
    assert all(abs(r["prediction"] - (3.0 + 2 * t)) < 1 for r, t in zip(out, range(60, 65)))
    assert timeseries.infer_frequency(s, "period")["frequency"] == "daily"


def test_frequency_of_months_and_quarters(spark):
    months = spark.createDataFrame([(dt.datetime(2020 + m // 12, m % 12 + 1, 1),) for m in range(18)], "d timestamp")
    assert timeseries.infer_frequency(months, "d")["frequency"] == "monthly"
    assert timeseries.infer_frequency(months.filter("month(d) % 3 = 1"), "d")["frequency"] == "quarterly"


def test_interval_nesting(spark):
    f = spark.createDataFrame([(i, 10.0) for i in range(1, 9)], "step int, prediction double")
    r = spark.createDataFrame([(float(x),) for x in range(-10, 11)], "residual double")
    for x in timeseries.intervals(f, r, 4).collect():
        assert x["lower_95"] <= x["lower_80"] <= x["prediction"] <= x["upper_80"] <= x["upper_95"]


def test_group_split_keeps_copies_together(spark):
    df = spark.createDataFrame([(i % 40, i) for i in range(400)], "g int, i int")
    assert sampling.group_split(df, ["g"]).groupBy("g").agg(F.count_distinct("is_test").alias("n")).filter("n > 1").count() == 0


def test_thinning_keeps_ends_and_extremes(spark):
    s = spark.createDataFrame([(t, 100.0 if t == 777 else float(t % 7)) for t in range(3000)], "t long, y double")
    kept = sampling.envelope(s, "t", "y", 100)
    ts = {r["t"] for r in kept.collect()}
    assert {0, 2999, 777} <= ts and len(ts) <= 102
    thin = {r["t"] for r in sampling.thin(s, "t", 250).collect()}
    assert {0, 2999} <= thin and len(thin) <= 250


def test_perfect_and_tied_rankings(spark):
    good = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, p double")
    assert metrics.ranking_scores(good, "y", "p").first()["roc_auc"] == 1.0
    assert metrics.ranking_scores(good.withColumn("p", F.lit(0.5)), "y", "p").first()["roc_auc"] == 0.5


def test_bootstrap_interval_holds_the_difference(spark):
    df = spark.createDataFrame([(i, i % 2, 0.8 if i % 2 else 0.3, 0.5) for i in range(300)], "id int, y int, a double, b double")
    r = metrics.bootstrap_difference(df, "y", "a", "b", "id", 400).first()
    # both errors are constant by class: the difference is the share of ones between -0.21 and -0.16
    assert r["low"] <= -0.185 <= r["high"] and abs((r["high"] - r["low"]) - 2 * 1.96 * 0.05 / 2 / 300**0.5) < 0.002
    again = metrics.bootstrap_difference(df.orderBy(F.rand(5)).repartition(7), "y", "a", "b", "id", 400).first()
    assert all(abs(again[c] - r[c]) < 1e-12 for c in ("low", "median", "high"))


def test_shapley_adds_up(spark):
    x = {"a": F.lit(2.0), "b": F.lit(3.0), "c": F.lit(5.0)}
    parts = scoring.shapley(["a", "b", "c"], lambda s: sum((x[k] for k in sorted(s)), F.lit(1.0)) * (F.lit(2.0) if {"a", "b"} <= s else F.lit(1.0)))
    r = spark.range(1).select(*[v.alias(k) for k, v in parts.items()]).first()
    assert abs(sum(r) - (11 * 2 - 1)) < 1e-9


def test_tree_contributions_add_up(spark):
    tree = {"left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "feature": [0, -1, 1, -1, -1], "threshold": [0.25, 0, -0.1, 0, 0], "value": [0.1, -0.6, 0.3, 0.15, 0.7]}
    cols = [F.col("a"), F.col("b")]
    df = spark.createDataFrame([(0.1, 0.0), (0.5, -1.0), (0.5, 1.0)], "a double, b double")
    parts = scoring.tree_contributions(tree, cols, ["a", "b"])
    for r in df.select(scoring.tree_value(tree, cols).alias("v"), (parts["a"] + parts["b"] + 0.1).alias("s")).collect():
        assert abs(r["v"] - r["s"]) < 1e-9
    with pytest.raises(ValueError):
        scoring.check_tree({**tree, "left": [1, -1, 0, -1, -1]})


def test_calibrators(spark):
    df = spark.createDataFrame([(float(i) / 50 - 1, int(i % 7 < i / 15)) for i in range(100)], "m double, y int")
    slope, _ = scoring.calibrate_sigmoid(df, "m", "y")
    assert slope > 0
    assert scoring.calibrate_isotonic(df, "m", "y").boundaries.size > 1
    assert set(scoring.calibrate_beta(df.withColumn("p", numeric.sigmoid(F.col("m"))), "p", "y")) == {"a", "b", "c"}


def test_evaluation_plan():
    assert compare.evaluation_plan(200, {"a": 100, "b": 100}) == {"tier": "normal", "mode": "holdout_cv", "folds": 5, "has_holdout": True}
    assert compare.evaluation_plan(40, {"a": 38, "b": 2})["mode"] == "cv_only"
    assert compare.evaluation_plan(6, {"a": 5, "b": 1})["mode"] == "exploratory"


def test_neighbours(spark):
    train = spark.createDataFrame([(float(i), "low" if i < 5 else "high") for i in range(10)], "x double, l string")
    out = {r["k"]: r["label"] for r in compare.nearest_neighbours(train, spark.createDataFrame([(1, 0.0), (2, 9.0)], "k int, x double"), "k", ["x"], "l", 3).collect()}
    assert out == {1: "low", 2: "high"}


def test_leakage(spark):
    df = spark.createDataFrame([(i, str(i % 2), str(i % 2), "g" + str(i % 2), float(i)) for i in range(40)], "i int, y string, copy string, code string, x double")
    out = {r["feature"]: r for r in profiling.leakage_audit(df, "y", ["copy", "code", "x"]).collect()}
    assert out["copy"]["severity"] == "hard" and out["code"]["decides_target"] and out["x"]["severity"] == "none"


def test_chart_suggestions():
    out = profiling.chart_suggestions({"day": "date", "sales": "numeric", "age": "numeric", "kind": "category"})
    assert out[0] == {"chart": "line", "x": "day", "y": "sales", "agg": "sum"} and out[-1]["chart"] == "scatter" and len(out) <= 6


def test_estimates(spark):
    e = market.estimate(F.lit(100.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = spark.range(1).select(*[c.alias(k) for k, c in e.items()]).first()
    assert tuple(r) == (100.0, 200.0, 300.0)


def test_csv_sniffing_and_padding(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿a;b;b\n1,5;"x;y\nz";N/A\n2;q\n', encoding="utf-8")
    out = files.read_csv(spark, str(p), tokens=("n/a",))
    assert out.columns == ["a", "b", "b_2"]
    assert sorted(tuple(r) for r in out.collect()) == [("1,5", "x;y\nz", None), ("2", "q", None)]
    p.write_text("a,b\n1,2,3\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), sep=",", strict=True)
    wide = tmp_path / "wide.csv"
    wide.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError, match="wider"):
        files.read_csv(spark, str(wide), sep=",")
    assert [tuple(r) for r in files.read_csv(spark, str(wide), sep=",", cut_wide=True).collect()] == [("1", "2"), ("3", "4")]


def workbook(rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook([["when", "n"], [45000, "x"], [None, "y"]]))
    out = files.excel_timestamps(files.read_xlsx(spark, str(tmp_path / "w.xlsx")), ["when"]).orderBy("_row").collect()
    assert [(r["when"], r["n"]) for r in out] == [(dt.datetime(2023, 3, 15), "x"), (None, "y")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5.0), (" @x", float("nan")), ("ok", 1.0)], "t string, v double")
    sinks.export_csv(df, str(tmp_path / "o.csv"))
    raw = (tmp_path / "o.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\"'=1+1\",\"-5.0\"\r\n" in raw and b"\"' @x\"" in raw
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.schema("t string, v double").json(str(tmp_path / "j")).filter("v IS NULL").count() == 1
    sinks.write_parquet(df.withColumn("user_id", F.lit("u")).withColumn("id", F.col("t")), str(tmp_path / "p"))
    sinks.delete_owned(spark, str(tmp_path / "p"), "u", "ok")
    assert sinks.read_table(spark, str(tmp_path / "p")).count() == 2


def test_geojson_and_rows(spark, tmp_path):
    import json

    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    shape = {"type": "FeatureCollection", "features": [{"properties": {"code": "1", "name": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"code": "2", "name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(shape))
    assert sorted(r["code"] for r in files.read_geojson(spark, str(tmp_path / "g.json")).collect()) == ["1", "2", "2"]
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [r["_row"] for r in files.read_parquet(spark, str(tmp_path / "p")).orderBy("id").collect()] == list(range(5))


def test_key_order_and_positive_numbers(spark):
    df = spark.createDataFrame([("b", 1), ("10", 2), ("2", 3), ("a", 4), ("01", 5)], "k string, r int")
    assert [r["k"] for r in aggregates.by_key_order(df, "k", "r").collect()] == ["2", "10", "b", "a", "01"]
    assert values(spark, lambda c: parse.positive_number(c, 20, whole=True), [3.0, 2.5, -1.0, 21.0, float("nan"), None], "double") == [3.0, None, None, None, None, None]


def test_samples_repeat(spark):
    df = spark.range(500)
    a = sorted(r["id"] for r in sampling.hashed_sample(df, F.col("id"), 40).collect())
    assert len(a) == 40 and a == sorted(r["id"] for r in sampling.hashed_sample(df.repartition(7), F.col("id"), 40).collect())
    assert {r["fold"] for r in sampling.time_folds(df.withColumn("t", F.col("id") % 50), "t", 4).collect()} == set(range(5))


def test_rule_precision_against_reviews(spark):
    rules = spark.createDataFrame([(i, "SALE") for i in range(10)], "id int, rule_label string")
    reviews = spark.createDataFrame([(i, "SALE" if i < 8 else "RENT") for i in range(10)], "id int, review_label string")
    r = textrules.rule_precision(rules, reviews, "id").first()
    assert (r["n"], r["hits"], r["precision"]) == (10, 8, 0.8) and r["low"] < 0.8 < r["high"]


def test_thresholds_and_choice(spark):
    df = spark.createDataFrame([(int(i >= 60), i / 100) for i in range(100)], "y int, p double")
    best = metrics.best_threshold(metrics.threshold_grid(df, "y", "p")).first()
    assert abs(best["threshold"] - 0.6) < 0.011 and best["macro_f1"] == 1.0
    records = [{"name": "a", "roc_auc": 0.8, "macro_f1": 0.7, "ece": 0.2}, {"name": "b", "roc_auc": 0.7, "macro_f1": 0.65, "ece": 0.05}]
    assert scoring.choose_model(records, {"roc_auc": 0.65, "macro_f1": 0.6, "ece": 0.1})["name"] == "b"
    assert scoring.choose_model(records, {"roc_auc": 0.9, "macro_f1": 0.6, "ece": 0.1}) is None


def test_action_plan(spark):
    mode, priority = scoring.action_plan(F.lit(0.3), F.lit(0.1), F.lit(9), F.lit(2), F.lit(10))
    assert tuple(spark.range(1).select(mode, priority).first()) == ("retention", "reactivation")


def test_display(spark):
    assert values(spark, text.vnd_display, [2.5e9, 3e6, 1200.0], "double") == ["2.50 tỷ", "3.0 triệu", "1,200"]
    assert values(spark, text.six_digits, [1234567.0, 0.00012345678, 0.0], "double") == [1234570.0, 0.000123457, 0.0]
    assert values(spark, text.slug, ["Hà Nội – Đông Anh"]) == ["ha-noi-dong-anh"]


def test_model_comparison_ranks_before_the_holdout(spark):
    df = spark.createDataFrame([(i, (i * 37 % 100) / 100, "ab"[i % 2], int((i * 37 % 100) > 50)) for i in range(200)], "k int, x double, c string, y int")
    found = compare.compare_models(df, "y", ["x"], ["c"], "k", names=["Logistic Regression", "Decision Tree"])
    assert [r["rank"] for r in found] == [1, 2] and found[0]["cv_score"] >= found[1]["cv_score"] > 0.8
    assert found[0]["importances"][0][0] == "x"
