"""Forecasts of many series by seven models, chosen by rolling-origin evaluation.

A series' cuts (validation folds, holdout, future) are rows; each (series, model,
cut) is fitted by a task of its own, and predictions come back as rows (series,
model, cut, step). Errors, ranking, holdout scores and intervals are aggregates of
that table, so that any number of series, models and folds is one job. Models are
ranked by their folds alone; holdout rows never reach the ranking.

A series is a bounded group: one row per period. Fitted models see lags, rolling
means and deviations and the calendar, all of periods before the one predicted; over
several steps their own predictions take the place of the periods to come.

Defined results: a series of fewer than 12 periods is forecast by its last value and
not ranked; models without enough history are listed as such; a model that gives
a prediction that is not finite or beyond 1e15 in any fold is not ranked, and if
the last fit of the chosen one does, the last value takes its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import sampling, timeseries
from millrace.operators.metrics import regression_scores
from millrace.storage import written

NAIVE, SEASONAL = "Naive Forecast", "Seasonal Naive"
#: Sizes and penalties of the fitted models.
FITTED = {
    "Linear Regression": ("linear", {"penalty": 0.0}),
    "Ridge Regression": ("linear", {"penalty": 10.0}),
    "Random Forest": ("forest", {"trees": 32, "depth": 9, "min_leaf": 3}),
    "Gradient Boosting": ("boosting", {"rounds": 45, "depth": 2, "min_leaf": 3}),
    "Hist Gradient Boosting": ("boosting", {"rounds": 50, "leaves": 15, "min_leaf": 20}),
}
MODELS = (NAIVE, SEASONAL, *FITTED)
#: Rows that a fitted model needs behind its lags, and the largest prediction taken seriously.
LEAST_ROWS, LARGEST = 8, 1e15
SERIES = "_series"
METRICS = ("mae", "rmse", "smape", "mape", "r2")


def _keyed(series: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (series, keys) if keys else (series.withColumn(SERIES, F.lit(0)), [SERIES])


def evaluation_cuts(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """(keys, n, mode, smallest, validated, kind, fold, train_end, steps): every cut of every series.

    ``smallest`` is the shortest training part, by which lags are chosen; ``validated``
    the steps of a fold.
    """
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    mode, blocks = F.lit("exploratory_no_validation"), F.lit(0)
    for least, name, count in reversed(sampling.BACKTEST_TIERS):
        mode, blocks = F.when(n >= least, name).otherwise(mode), F.when(n >= least, count).otherwise(blocks)
    shortest, longest = sampling.HOLDOUT_BOUNDS
    held = F.greatest(F.lit(shortest), F.least(F.floor(n / 5), F.lit(longest)))
    # each step as a table of its own: inlined into one another these expressions would be copied many times over
    plans = sizes.select(*keys, "n", F.inline(F.array(F.struct(mode.alias("mode"), blocks.alias("blocks"), (n - held).alias("held_from")))))
    end = F.when(F.col("blocks") > 0, F.col("held_from")).otherwise(n)
    width = F.least(F.lit(horizon), F.greatest(F.lit(1), F.floor(F.col("held_from") / (F.col("blocks") + 3))), F.lit(sampling.LONGEST_BLOCK))
    plans = plans.select(*keys, "n", "mode", "blocks", F.inline(F.array(F.struct(end.alias("end"), F.when(F.col("blocks") > 0, width).otherwise(1).cast("int").alias("validated")))))
    plans = plans.withColumn("smallest", F.col("end") - F.col("blocks") * F.col("validated"))
    cut = lambda kind, fold, end, steps: F.struct(F.lit(kind).alias("kind"), fold.cast("int").alias("fold"), end.cast("long").alias("train_end"), steps.cast("int").alias("steps"))
    folds = F.transform(F.sequence(F.lit(1), F.col("blocks")), lambda i: cut("fold", i, F.col("smallest") + (i - 1) * F.col("validated"), F.col("validated")))
    others = F.array(cut("holdout", F.lit(0), F.col("end"), n - F.col("end")), cut("future", F.lit(0), n, F.lit(horizon)))
    every = F.concat(F.when(F.col("blocks") > 0, folds).otherwise(F.array().cast("array<struct<kind:string,fold:int,train_end:bigint,steps:int>>")), others)
    return plans.select(*keys, "n", "mode", "smallest", "validated", F.explode(every).alias("c")).select("*", "c.*").drop("c").filter("steps > 0")


def _warmup(frequency: str, smallest: Column) -> Column:
    most = F.greatest(F.lit(3), F.floor(smallest / 3))
    steps = sorted({1, 2, 3, 7, 12, *timeseries.FEATURE_LAGS[frequency]})
    return F.greatest(F.lit(3), *[F.when(F.lit(k) <= most, k).otherwise(0) for k in steps])


def model_status(cuts: DataFrame, keys: list[str], frequency: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """(keys, model, status): which models have enough history in each series."""
    smallest, ranked = F.col("smallest"), F.col("mode") != "exploratory_no_validation"
    enough = {m: ranked & (smallest - _warmup(frequency, smallest) >= LEAST_ROWS) for m in FITTED} | {NAIVE: F.lit(True), SEASONAL: ranked & (smallest >= 2 * timeseries.PERIOD[frequency])}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.when(enough[m], "READY").otherwise("SKIPPED_INSUFFICIENT_HISTORY").alias("status")) for m in models])).alias("m")
    return cuts.filter("kind = 'future'").select(*keys, pairs).select(*keys, "m.*")


def _naive(series: DataFrame, wanted: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Last value, and the value one season back: a join on the period to repeat."""
    step = F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("step")
    rows = wanted.filter(F.col("model").isin(NAIVE, SEASONAL)).select("*", step)
    back = F.when(F.col("model") == NAIVE, 1).otherwise(period - F.pmod(F.col("step") - 1, F.lit(period)))
    past = series.select(*keys, F.col("t").alias("at"), F.col("y").cast("double").alias("prediction"))
    return rows.withColumn("at", F.col("train_end") - back).join(past, [*keys, "at"]).drop("at")


def _fitter(keys: list[str], frequency: str, named: dict[str, tuple[str, dict]]):
    """Grouped function: fit one model on one series up to one cut, and predict the steps behind it."""
    import numpy as np
    import pandas as pd

    from millrace.operators import trees

    class Line:
        def __init__(self, x, y, penalty):
            self.mean, self.scale = x.mean(0), x.std(0)
            self.scale[self.scale < 1e-12] = 1
            z = (x - self.mean) / self.scale
            self.base = y.mean()
            # the smallest solution where features depend on each other
            self.weights = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - self.base)) if penalty else np.linalg.lstsq(z, y - self.base, rcond=None)[0]
            self.importance = np.abs(self.weights)

        def predict(self, row):
            return float(self.base + (row - self.mean) / self.scale @ self.weights)

    def features(y, when, t, schema):
        out = [t, when.year, when.month, when.quarter, when.day, when.dayofweek, when.isocalendar().week, int(when.dayofweek >= 5), when.hour]
        out += [y[t - k] for k in schema["lags"]]
        out += [float(np.mean(y[t - w : t])) for w in schema["means"]]
        return out + [float(np.std(y[t - w : t])) for w in schema["stds"]]

    def fit(pdf):
        pdf = pdf.sort_values("t")
        head, y, when = pdf.iloc[0], pdf["y"].astype(float).tolist(), list(pdf["period"])
        schema = timeseries.feature_schema(frequency, int(head["smallest"]))
        start, steps = schema["warmup"], int(head["steps"])
        x = np.array([features(y, when[t], t, schema) for t in range(start, len(y))], float)
        target = np.array(y[start:])
        kind, options = named[head["model"]]
        model = Line(x, target, **options) if kind == "linear" else getattr(trees, kind)(x, target, **options)
        names = ["time_index", "year", "month", "quarter", "day", "day_of_week", "week_of_year", "is_weekend", "hour"]
        names += [f"lag_{k}" for k in schema["lags"]] + [f"rolling_mean_{w}" for w in schema["means"]] + [f"rolling_std_{w}" for w in schema["stds"]]
        out, moment = [], when[-1]
        for _ in range(steps):
            moment = moment + timeseries.calendar_step(frequency)
            value = model.predict(np.array(features(y, moment, len(y), schema), float))
            if not math.isfinite(value) or abs(value) > LARGEST:
                break
            out.append(value)
            y.append(value)
        found = pd.DataFrame({"step": np.arange(1, steps + 1, dtype=np.int32), "prediction": out + [None] * (steps - len(out))})
        found["prediction"] = found["prediction"].astype("Float64")
        found["importance"] = [[{"feature": n, "value": float(v)} for n, v in zip(names, model.importance)] if i == 0 else None for i in range(steps)]
        for c in [*keys, "model", "kind", "fold", "train_end", "steps"]:
            found[c] = head[c]
        return found

    return fit


def predictions(series: DataFrame, wanted: DataFrame, keys: list[str], frequency: str, named: dict | None = None) -> DataFrame:
    """(keys, model, kind, fold, train_end, steps, step, t, prediction, importance) of the wanted (keys, model, cut) rows.

    A prediction is null from the step on at which a model ran out of bounds.
    ``named`` may hold other sizes of the fitted models.
    """
    named = named or FITTED
    types = dict(series.dtypes) | {"kind": "string"}
    layout = [*keys, "model", "kind", "fold", "train_end", "steps", "step", "prediction", "importance"]
    none = F.lit(None).cast("array<struct<feature:string,value:double>>")
    plain = _naive(series, wanted, keys, timeseries.PERIOD[frequency]).withColumn("importance", none).select(*layout)
    fits = wanted.filter(F.col("model").isin(*named))
    rows = series.select(*keys, "t", "period", "y").join(fits.select(*keys, "model", "kind", "fold", "train_end", "steps", "smallest"), keys).filter("t < train_end")
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", model string, kind string, fold int, train_end bigint, steps int, step int, prediction double, importance array<struct<feature:string,value:double>>"
    # a fit is much work on few bytes, so that adaptive execution must not gather many in one task
    cores = max(series.sparkSession.sparkContext.defaultParallelism, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(4 * cores, *keys, "model", "kind", "fold")
    fitted = dealt.groupBy(*keys, "model", "kind", "fold").applyInPandas(_ordered(_fitter(keys, frequency, named), layout), schema)
    return plain.unionByName(fitted).withColumn("t", F.col("train_end") + F.col("step") - 1)


def _ordered(f, layout):
    return lambda pdf: f(pdf)[layout]


def fold_scores(found: DataFrame, series: DataFrame, keys: list[str], kind: str = "fold") -> DataFrame:
    """(keys, model, fold, mae, rmse, smape, mape, r2) of the cuts of a kind whose predictions are all there."""
    rows = found.filter(F.col("kind") == kind).join(series.select(*keys, "t", F.col("y").cast("double").alias("actual")), [*keys, "t"])
    whole = rows.groupBy(*keys, "model").agg(F.bool_and(F.col("prediction").isNotNull()).alias("whole")).filter("whole").drop("whole")
    kept = rows.join(whole, [*keys, "model"])
    return regression_scores(kept, "actual", "prediction", [*keys, "model", "fold"], digits=None).select(*keys, "model", "fold", *METRICS)


def rank(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Models of each series by mean RMSE of their folds, then MAE, then as listed, with the gain over the last value in percent.

    A mean is null if any fold has none; a gain below 5 is flagged.
    """
    mean = lambda m: F.when(F.count(m) == F.count(F.lit(1)), F.avg(m)).alias(m)
    means = scores.groupBy(*keys, "model").agg(*map(mean, METRICS), F.stddev_pop("rmse").alias("rmse_std"), F.count(F.lit(1)).alias("folds"))
    listed = F.array_position(F.array(*map(F.lit, MODELS)), F.col("model"))
    here = Window.partitionBy(*keys)  # as many rows as there are models
    base = F.max(F.when(F.col("model") == NAIVE, F.col("rmse"))).over(here)
    gain = F.when(base > 1e-9, 100 * (base - F.col("rmse")) / base)
    ranked = means.withColumns({"rank": F.row_number().over(here.orderBy("rmse", "mae", listed)), "improvement_vs_naive": gain})
    return ranked.withColumn("weak_gain", F.coalesce(F.col("improvement_vs_naive"), F.lit(0.0)) < 5)


def evaluate(series: DataFrame, keys: list[str], frequency: str, horizon: int, models: tuple[str, ...] = MODELS) -> dict[str, DataFrame]:
    """``cuts``, ``status`` of every model, ``predictions`` of folds and holdout, ``scores`` by fold and ``ranking``.

    Predictions are written once and read by all that follows.
    """
    cuts = written(evaluation_cuts(series, keys, horizon), "cuts")
    status = model_status(cuts, keys, frequency, models)
    wanted = cuts.filter("kind <> 'future'").join(status.filter("status = 'READY'").drop("status"), keys)
    found = written(predictions(series, wanted, keys, frequency), "predictions")
    scores = fold_scores(found, series, keys)
    ranking = rank(scores, keys)
    failed = status.join(ranking.select(*keys, "model", "rank"), [*keys, "model"], "left").join(cuts.filter("kind = 'future'").select(*keys, "mode"), keys)
    verdict = F.when(F.col("status") != "READY", F.col("status")).when(F.col("rank").isNotNull() | (F.col("mode") == "exploratory_no_validation"), "SUCCESS").otherwise("FAILED_SAFE")
    return {"cuts": cuts, "status": failed.select(*keys, "model", verdict.alias("status"), "rank"), "predictions": found, "scores": scores, "ranking": ranking}


def reliability(n: Column, relative_rmse: Column, stability: Column, horizon: int) -> Column:
    """High, Medium or Low from the length, the RMSE against the mean size, its spread over folds and the horizon's share."""
    share = F.lit(float(horizon)) / n
    fits = lambda least, a, b, c: (n >= least) & (relative_rmse < a) & (stability < b) & (share <= c)
    return F.when(fits(120, 0.15, 0.3, 0.15), "High").when(fits(60, 0.4, 0.7, 0.3), "Medium").otherwise("Low")


def forecast(series: DataFrame, frequency: str, horizon: int, keys: list[str] | None = None, models: tuple[str, ...] = MODELS, floor_at_zero: bool = False) -> dict[str, DataFrame]:
    """The best model of each series, refitted on all of it, with intervals; and all of ``evaluate``'s tables.

    ``forecast``: (keys, model, step, period, prediction, lower_80, upper_80, lower_95, upper_95); the bands are null for
    series that have no fold. ``best``: one row per series with holdout scores and reliability. ``importance``: the ten
    weightiest features of the chosen model.
    """
    keyed, keys = _keyed(series, list(keys or []))
    keyed = written(keyed.select(*keys, "t", "period", F.col("y").cast("double").alias("y")), "series")
    out = evaluate(keyed, keys, frequency, horizon, models)
    future = out["cuts"].filter("kind = 'future'")
    chosen = out["ranking"].filter("rank = 1").select(*keys, "model", "rmse", "rmse_std", "improvement_vs_naive", "weak_gain")
    chosen = written(future.join(chosen, keys, "left").withColumn("model", F.coalesce("model", F.lit(NAIVE))), "chosen")
    wanted = chosen.select(*keys, "model", "kind", "fold", "train_end", "steps", "smallest")
    last = written(predictions(keyed, wanted, keys, frequency), "forecasts")
    broken = last.filter("prediction IS NULL").select(*keys).distinct()
    safe = _naive(keyed, wanted.withColumn("model", F.lit(NAIVE)), keys, 1).select(*keys, "step", F.col("prediction").alias("safe"))
    rows = last.join(safe, [*keys, "step"]).join(broken.withColumn("broken", F.lit(True)), keys, "left")
    p = F.when(F.col("broken"), F.col("safe")).otherwise(F.col("prediction"))
    model = F.when(F.col("broken"), NAIVE).otherwise(F.col("model"))
    lowest = keyed.groupBy(*keys).agg(F.min("y").alias("lowest"), F.max("period").alias("last_period"))
    rows = rows.select(*keys, model.alias("model"), "step", p.alias("prediction")).join(lowest, keys)
    if floor_at_zero:
        rows = rows.withColumn("prediction", F.when(F.col("lowest") >= 0, timeseries.nonnegative(F.col("prediction"))).otherwise(F.col("prediction")))
    residuals = out["predictions"].filter("kind = 'fold'").join(keyed.select(*keys, "t", "y"), [*keys, "t"]).groupBy(*keys, "model")
    spread = residuals.agg(F.percentile(F.abs(F.col("y") - F.col("prediction")), [0.8, 0.95]).alias("q"))  # at most five folds of sixty steps
    grow = F.sqrt(F.greatest(F.lit(1.0), F.col("step") / F.greatest(F.lit(1), F.col("validated")).cast("double")))
    banded = rows.join(spread, [*keys, "model"], "left").join(future.select(*keys, "validated"), keys)
    band = lambda sign, i: F.col("prediction") + sign * F.col("q")[i] * grow
    period = F.col("last_period") + F.expr(timeseries.STEPS[frequency]) * F.col("step")
    visible = [k for k in keys if k != SERIES]
    out["forecast"] = banded.select(
        *visible, "model", "step", period.alias("period"), "prediction", band(-1, 0).alias("lower_80"), band(1, 0).alias("upper_80"), band(-1, 1).alias("lower_95"), band(1, 1).alias("upper_95")
    )
    held = fold_scores(out["predictions"], keyed, keys, "holdout").select(*keys, "model", *[F.col(m).alias(f"holdout_{m}") for m in METRICS])
    ends = out["cuts"].filter("kind = 'holdout'").select(*keys, "train_end")
    size = keyed.join(ends, keys).filter("t < train_end").groupBy(*keys).agg(F.avg(F.abs("y")).alias("size"))
    best = chosen.select(*keys, "n", "mode", "model", "rmse", "rmse_std", "improvement_vs_naive", "weak_gain").join(held, [*keys, "model"], "left").join(size, keys, "left")
    trust = reliability(F.col("n"), F.col("rmse") / F.greatest(F.col("size"), F.lit(1e-9)), F.col("rmse_std") / F.greatest(F.col("rmse"), F.lit(1e-9)), horizon)
    out["best"] = best.withColumn("reliability", F.when(F.col("rmse").isNull(), "Low").otherwise(trust)).drop("size", *([SERIES] if not visible else []))
    weights = last.filter("step = 1 AND importance IS NOT NULL").select(*visible, "model", F.explode("importance").alias("w")).select(*visible, "model", "w.*")
    order = Window.partitionBy(*visible, "model").orderBy(F.desc("value"), "feature")
    out["importance"] = weights.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")
    return out
