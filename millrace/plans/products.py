"""The product flows as compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import parse
from millrace.functions.numeric import line_amount, round_even
from millrace.functions.text import MISSING_HEALTH, MISSING_MODEL, fold, norm_missing
from millrace.operators import aggregates, cleaning, filters, forecasting, profiling, saletext, scoring, textrules, timeseries
from millrace.operators.windows import gap_features

#: Statuses of cancelled or refunded orders, folded.
VOID_STATUS = ("cancelled", "canceled", "refunded", "huy", "da huy", "hoan tien", "da hoan tien")


def analyze_table(df: DataFrame) -> dict:
    """Clean a raw table, profile its numbers, and chart what its column kinds suggest."""
    clean, report = cleaning.clean_table(df)
    names = [c for c in clean.columns if c != cleaning.ROW]
    numeric = [c for c, t in clean.dtypes if t == "double" and c != cleaning.ROW]
    distinct = clean.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in names], *[F.avg((F.col(c).rlike("[-/]") & parse.parse_date(F.col(c), "day_first").isNotNull()).cast("double")).alias(f"t_{c}") for c in names if c not in numeric]).first()
    kinds = {}
    for c in names:
        if c in numeric:
            kinds[c] = "numeric"
        elif (distinct[f"t_{c}"] or 0) >= 0.8:
            kinds[c] = "date"
        else:
            kinds[c] = "category" if distinct[f"d_{c}"] <= 20 or distinct[f"d_{c}"] <= 0.5 * distinct["n"] else "text"
    charts = []
    for s in profiling.chart_suggestions(kinds):
        data = profiling.scatter(clean, s["x"], s["y"]) if s["chart"] == "scatter" else aggregates.grouped(clean, s["x"], s["y"], s["agg"])
        charts.append(s | {"data": data})
    return {"table": clean, "report": report, "kinds": kinds, "profile": profiling.numeric_profile(clean, numeric) if numeric else None, "charts": charts}


def prepare_series(df: DataFrame, time: str, value: str, frequency: str = "auto", order: str = "auto", convention: str = "auto") -> tuple[DataFrame, str]:
    """A dense series from raw text columns, and its frequency; unclear dates or numbers raise."""
    rows = df.select(norm_missing(F.col(time), MISSING_MODEL).alias("d"), norm_missing(F.col(value), MISSING_MODEL).alias("v"))
    if order == "auto":
        order, unclear = parse.date_order(rows, "d")
        if unclear:
            raise ValueError("dates can be read day-first or month-first; choose an order")
    if convention == "auto" and rows.filter(F.col("v").rlike(r"^[+-]?\d{1,3}[,.]\d{3}$")).limit(1).count():
        raise ValueError("numbers such as 1,234 can be decimals or thousands; choose a convention")
    points = rows.select(parse.parse_date(F.col("d"), order).alias("ts"), parse.convention_number(F.col("v"), convention).alias("value"))
    counts = points.agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("t"), F.count(F.when(F.col("ts").isNotNull(), F.col("value"))).alias("v")).first()
    if counts["t"] < counts["n"] / 2 or counts["v"] < max(3, counts["n"] / 2):
        raise ValueError("too few rows have a readable date and number")
    good = points.na.drop()
    if frequency == "auto":
        frequency = timeseries.infer_frequency(good, "ts")["frequency"]
    return timeseries.densify(timeseries.period_sums(good, "ts", "value", frequency), frequency), frequency


def forecast_sales(series: DataFrame, frequency: str, horizon: int = 30, floor_at_zero: bool = False, models: tuple[str, ...] = forecasting.MODELS) -> dict:
    """Quality, trend, season, the ranking of all models by rolling origin, and the best one's forecast with intervals."""
    found = forecasting.forecast(series, frequency, horizon, models=models, floor_at_zero=floor_at_zero)
    figures = {"quality": timeseries.quality(series), "trend": timeseries.trend(series), "season": timeseries.season_correlations(series, frequency)}
    named = {k: found[k] for k in ("ranking", "status", "best", "forecast", "importance")}
    return figures | named | {"model": found["best"].first()["model"], "summary": timeseries.forecast_summary(found["forecast"], series)}


def transaction_reasons(decimal: str = "dot", order: str = "ISO", kind: str = "unit_price", rate: float = 1.0) -> tuple[list, dict[str, Column]]:
    """Ordered refusal reasons of raw transactions with a ``is_repeat`` flag, and the typed columns of the others."""
    c = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    when = parse.parse_date(c("date"), {"ISO": "auto", "DMY": "day_first", "MDY": "month_first"}[order])
    quantity, value = parse.grouped_number(c("quantity"), decimal), parse.grouped_number(c("value"), decimal)
    amount = line_amount(quantity, value, rate, kind)
    rating = parse.grouped_number(c("rating"), decimal)
    reasons = [
        ("exact_repeat", F.col("is_repeat")),
        ("missing_or_long_key", (c("customer") == "") | (c("order") == "") | (F.length(c("customer")) > 200) | (F.length(c("order")) > 200)),
        ("invalid_date", when.isNull()),
        ("cancelled_or_refunded", fold(c("status")).isin(*VOID_STATUS)),
        ("not_positive", ~F.coalesce((quantity > 0) & (value > 0), F.lit(False))),
        ("invalid_country", (c("country") == "") | (F.length(c("country")) > 100)),
        ("no_amount", ~F.coalesce((amount > 0) & (amount < float("inf")), F.lit(False))),
    ]
    typed = {"customer": c("customer"), "order_id": c("order"), "ts": when, "amount": amount, "product": c("product"), "country": c("country"), "rating": F.when(rating.between(1, 5) & (rating == F.floor(rating)), rating.cast("int")), "feedback": c("feedback") != ""}
    return reasons, typed


TRANSACTION_KEY = ["customer", "order", "date", "quantity", "value", "country", "product", "status"]


def prepare_transactions(raw: DataFrame, **formats) -> tuple[DataFrame, DataFrame]:
    """(typed transactions, rows per refusal reason); ratings and feedback do not tell rows apart."""
    need = [*TRANSACTION_KEY, "rating", "feedback"]
    rows = cleaning.with_row(raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in need]))
    marked = filters.mark_repeats(rows, TRANSACTION_KEY, cleaning.ROW)
    reasons, typed = transaction_reasons(**formats)
    judged = filters.funnel(marked, reasons)
    return judged.filter(F.col("reason") == filters.KEPT).select(F.col(cleaning.ROW), *[v.alias(k) for k, v in typed.items()]), judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def customer_features(tx: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """Features per customer strictly before the snapshot, by default the latest purchase."""
    at = tx.agg(F.max("ts").alias("snapshot")) if snapshot is None else tx.sparkSession.range(1).select(snapshot.cast("timestamp").alias("snapshot"))
    past = tx.crossJoin(F.broadcast(at)).filter("ts < snapshot")  # one row
    recent = F.col("ts") >= F.col("snapshot") - F.make_dt_interval(F.lit(90))
    orders = past.groupBy("customer", "order_id", "snapshot").agg(F.min("ts").alias("ts"))
    life = orders.groupBy("customer", "snapshot").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    active = past.groupBy("customer").agg(
        F.count_distinct(F.when(recent, F.col("order_id"))).alias("orders_90d"),
        F.coalesce(round_even(F.sum(F.when(recent, F.col("amount"))), 2), F.lit(0.0)).alias("monetary_90d"),
        F.when(F.min(F.col("product") != ""), F.count_distinct(F.when(recent, F.col("product")))).alias("products_90d"),
        F.max_by("country", F.struct("ts", cleaning.ROW)).alias("country"),
        F.avg("rating").alias("rating"),
    )
    gaps = gap_features(F.col("first_ts"), F.col("last_ts"), F.col("n"), F.col("snapshot"))
    return life.join(active, "customer").select("customer", *[v.alias(k) for k, v in gaps.items()], "orders_90d", "monetary_90d", "products_90d", "country", "rating", F.col("last_ts").alias("last_purchase"))


def score_customers(features: DataFrame, probability: Column, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(scored customers, one-row summary); rows that break an input rule get a reason instead of a score."""
    reason = F.when(F.col("products_90d").isNull(), "missing_product").otherwise(scoring.input_reason())
    p = F.when(reason.isNull(), probability)
    scored = features.withColumn("reason", reason).withColumn("probability", p)
    scored = scored.withColumns({"classification": (F.col("probability") >= threshold).cast("int"), "band": scoring.band(F.col("probability"))})
    return scored, scoring.score_summary(scored, "probability", threshold)


def verified_sales(listings: DataFrame, provinces: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(verified sale listings, rows per refusal reason): intent, text price, unit price, place, date, repeats, in this order.

    Cheap range filters and the title's intent run before the price scan.
    """
    c = F.col
    scope = c("price").between(2e8, 1e11) & c("area").between(15, 1500)
    base = listings.withColumn("price", c("price").try_cast("double")).filter(F.coalesce(scope, F.lit(False)))
    agreed = saletext.verified_price(c("name"), c("description"), c("price").cast("string"))
    priced = base.withColumns({"is_sale": saletext.strict_sale(c("name")), "verified": agreed})
    names = F.create_map(*[F.lit(x) for kv in provinces.items() for x in kv])
    place = F.try_element_at(names, fold(F.trim(c("province_name"))))
    when = parse.parse_date(c("published_at"))
    unit = c("price") / c("area")
    reasons = [
        ("intent", ~c("is_sale")),
        ("unverified_total_price", c("verified").isNull()),
        ("unit_price_scope", ~unit.between(2e6, 5e8)),
        ("unknown_province", place.isNull()),
        ("unknown_area", (F.trim(F.coalesce(c("district_name"), F.lit(""))) == "") | (F.length(F.trim("district_name")) > 100)),
        ("date", when.isNull()),
    ]
    judged = filters.funnel(priced, reasons)
    good = judged.filter(c("reason") == filters.KEPT).select(
        textrules.row_key(judged, ["name", "description", "property_type_name", "province_name", "district_name", "price", "area"]).alias("listing_id"), when.alias("listing_date"), place.alias("province"), F.trim("district_name").alias("area_name"), c("property_type_name").alias("property_type"), c("price").alias("price_vnd"), c("area").alias("area_m2"), unit.alias("price_per_m2")
    )
    first = good.groupBy("listing_id").agg(*[F.min(k).alias(k) for k in good.columns if k != "listing_id"])
    return first, judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def market_statistics(sales: DataFrame) -> DataFrame:
    """Quartiles of price per m2 by province, area and type, with coverage."""
    return aggregates.level_stats(sales, [("PROVINCE", ["province", "property_type"]), ("AREA", ["province", "area_name", "property_type"])], "price_per_m2", "listing_date", least=30)


def health_risk(df: DataFrame, model: dict) -> DataFrame:
    """Risk, class and each feature's contribution, from text columns with '?' for missing values."""
    typed = df.select(*[parse.locale_number(norm_missing(F.col(c), MISSING_HEALTH)).alias(c) if c in model["features"] else F.col(c) for c in df.columns])
    p, parts = scoring.logistic(model)
    return typed.select("*", p.alias("risk"), (p >= 0.5).cast("int").alias("predicted"), *[v.alias(f"c_{k}") for k, v in parts.items()])
