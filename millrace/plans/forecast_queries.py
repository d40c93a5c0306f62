"""Queries of rolling-origin evaluation, over the weekly order values of each priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import forecasting, timeseries
from millrace.plans.registry import query, table

KEYS, HORIZON = ["o_orderpriority"], 13

_WEEKS = """WITH s AS (
  SELECT o_orderpriority AS k, date_trunc('week', o_orderdate) AS p, sum(o_totalprice) AS y FROM orders GROUP BY ALL
), e AS (SELECT k, min(p) AS a, max(p) AS b FROM s GROUP BY k
), g AS (SELECT k, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS p FROM e
), x AS (
  SELECT g.k, g.p, row_number() OVER (PARTITION BY g.k ORDER BY g.p) - 1 AS t, coalesce(s.y, 0) AS y FROM g LEFT JOIN s ON g.k = s.k AND g.p = s.p
), n AS (SELECT k, count(*) AS n, CASE WHEN count(*) >= 300 THEN 5 WHEN count(*) >= 60 THEN 3 WHEN count(*) >= 24 THEN 2 WHEN count(*) >= 12 THEN 1 ELSE 0 END AS blocks FROM x GROUP BY k
), h AS (SELECT *, n - greatest(2, least(n // 5, 90)) AS ends FROM n WHERE blocks > 0
), w AS (SELECT *, least(13, greatest(1, ends // (blocks + 3)), 60) AS width FROM h
), f AS (SELECT k, i AS fold, width, ends - (blocks - i + 1) * width AS cut, ends - blocks * width AS smallest FROM w, range(1, 6) AS r(i) WHERE i <= blocks
), m AS (
  SELECT f.k, f.fold, 'Naive Forecast' AS model, a.t, a.y, b.y AS p FROM f JOIN x a ON a.k = f.k AND a.t >= cut AND a.t < cut + width JOIN x b ON b.k = f.k AND b.t = cut - 1
  UNION ALL
  SELECT f.k, f.fold, 'Seasonal Naive', a.t, a.y, b.y FROM f JOIN x a ON a.k = f.k AND a.t >= cut AND a.t < cut + width JOIN x b ON b.k = f.k AND b.t = cut - 52 + (a.t - cut) % 52 WHERE smallest >= 104
), z AS (
  SELECT k, model, fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse,
    100 * avg(CASE WHEN abs(y) + abs(p) > 1e-9 THEN 2 * abs(y - p) / (abs(y) + abs(p)) ELSE 0 END) AS smape FROM m GROUP BY ALL
)"""


def weekly(spark, d):
    sums = timeseries.period_sums(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "weekly", KEYS)
    return timeseries.densify(sums, "weekly", KEYS)


@query(f"{_WEEKS} SELECT k AS o_orderpriority, model, CAST(fold AS INTEGER) AS fold, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(smape, 6) AS smape FROM z")
def ts14_rolling_origin(spark, d):
    """Errors of the naive models in every fold of every series."""
    found = forecasting.evaluate(weekly(spark, d), KEYS, "weekly", HORIZON, (forecasting.NAIVE, forecasting.SEASONAL))["scores"]
    return found.select(*KEYS, "model", "fold", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("smape", 6).alias("smape"))


@query(
    f"""{_WEEKS}, a AS (SELECT k, model, avg(mae) AS mae, avg(rmse) AS rmse, stddev_pop(rmse) AS rmse_std, count(*) AS folds FROM z GROUP BY ALL)
SELECT k AS o_orderpriority, model, CAST(row_number() OVER (PARTITION BY k ORDER BY rmse, mae, model) AS INTEGER) AS rank, round(rmse, 2) AS rmse, round(rmse_std, 2) AS rmse_std, folds,
  round(100 * (max(rmse) FILTER (model = 'Naive Forecast') OVER (PARTITION BY k) - rmse) / max(rmse) FILTER (model = 'Naive Forecast') OVER (PARTITION BY k), 6) AS improvement_vs_naive FROM a"""
)
def ts15_naive_ranking(spark, d):
    ranking = forecasting.evaluate(weekly(spark, d), KEYS, "weekly", HORIZON, (forecasting.NAIVE, forecasting.SEASONAL))["ranking"]
    return ranking.select(*KEYS, "model", "rank", F.round("rmse", 2).alias("rmse"), F.round("rmse_std", 2).alias("rmse_std"), "folds", F.round("improvement_vs_naive", 6).alias("improvement_vs_naive"))


@query()
def ts15_model_ranking(spark, d):
    """All seven models of each series in one ranking by their folds."""
    ranking = forecasting.evaluate(weekly(spark, d), KEYS, "weekly", HORIZON)["ranking"]
    return ranking.select(*KEYS, "model", "rank", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "smape", "rmse_std", "improvement_vs_naive")], "folds", "weak_gain")


@query()
def ts12_ensemble_forecasts(spark, d):
    """Recursive forecasts of each series by forest, boosting and leaf-wise boosting."""
    series = weekly(spark, d)
    cuts = forecasting.evaluation_cuts(series, KEYS, HORIZON)
    status = forecasting.model_status(cuts, KEYS, "weekly", tuple(m for m, (kind, _) in forecasting.FITTED.items() if kind != "linear"))
    wanted = cuts.filter("kind = 'future'").join(status.filter("status = 'READY'"), KEYS)
    return forecasting.predictions(series, wanted, KEYS, "weekly").select(*KEYS, "model", "step", F.round("prediction", 4).alias("prediction"))


@query()
def ts15_best_forecasts(spark, d):
    """The best model of each series, refitted, with intervals."""
    return forecasting.forecast(weekly(spark, d), "weekly", HORIZON, KEYS, floor_at_zero=True)["forecast"]
