"""Calendar series: frequency, buckets, dense grids, trend, season, spikes, features, backtests, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import regression_scores
from millrace.operators.sampling import walk_forward_plan
from millrace.operators.windows import time_deltas

#: Unit of each frequency, its season, the lags at which seasons are looked for, and feature lags.
UNITS = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH", "quarterly": "QUARTER"}
STEPS = {"hourly": "INTERVAL 1 HOUR", "daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH", "quarterly": "INTERVAL 3 MONTH"}
PERIOD = {"hourly": 24, "daily": 7, "weekly": 52, "monthly": 12, "quarterly": 4}
SEASON_LAGS = {"hourly": (24, 168), "daily": (7, 14, 30), "weekly": (4, 13, 52), "monthly": (3, 6, 12), "quarterly": (4,)}
FEATURE_LAGS = {"hourly": (24, 48), "daily": (7, 14, 30), "weekly": (4, 13, 52), "monthly": (12, 24), "quarterly": (4,)}


def infer_frequency(df: DataFrame, time: str) -> dict:
    """Frequency, modal step in days and confidence; only the counts of distinct gaps reach the driver's decision."""
    aligned = df.agg(F.bool_and((F.dayofmonth(time) == 1) & (F.date_trunc("day", time) == F.col(time))).alias("m"), F.count_distinct(time).alias("n")).first()
    if aligned["m"] and aligned["n"] > 1:
        months = F.months_between(time, F.lag(time).over(Window.orderBy(time)))
        gaps = df.select(time).distinct().select(time, months.alias("g")).filter("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("f"))
        best = gaps.orderBy(F.desc("n"), "f").limit(1).first()
        share = best["n"] / (aligned["n"] - 1)
        return {"frequency": "quarterly" if best["g"] >= 3 else "monthly", "step_days": None, "confidence": share, "irregular": share < 0.8}
    gaps = time_deltas(df, time)
    best = gaps.orderBy(F.desc("n"), "first_seen").limit(1).first()
    if best is None:
        return {"frequency": "daily", "step_days": None, "confidence": 0.0, "irregular": True}
    days = best["delta"] / 86400
    share = best["n"] / (aligned["n"] - 1)
    name = "hourly" if days < 0.75 else "weekly" if days >= 6 else "daily"
    return {"frequency": name, "step_days": days, "confidence": share, "irregular": share < 0.8}


def bucket(c: Column, frequency: str) -> Column:
    return F.date_trunc(UNITS[frequency], c)


def period_sums(df: DataFrame, time: str, value: str, frequency: str, series: list[str] | None = None) -> DataFrame:
    return df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*(series or []), bucket(F.col(time), frequency).alias("period")).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n_rows"))


def densify(sums: DataFrame, frequency: str, series: list[str] | None = None) -> DataFrame:
    """Every period between a series' ends, 0 where it has none, with ``t`` from 0."""
    keys = series or []
    ends = sums.groupBy(*keys).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = ends.select(*keys, F.posexplode(F.sequence("a", "b", F.expr(STEPS[frequency]))).alias("t", "period"))
    out = grid.join(sums, [*keys, "period"], "left")
    return out.select(*keys, F.col("t").cast("long").alias("t"), "period", F.coalesce("y", F.lit(0.0)).alias("y"), F.col("y").isNull().alias("is_missing"))


def trend(series: DataFrame) -> DataFrame:
    """Least-squares line of y over t; the direction needs a change of 5 % of mean |y|."""
    s = series.agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"), F.count(F.lit(1)).alias("n"), F.greatest(F.avg(F.abs("y")), F.lit(1e-9)).alias("scale"))
    change = F.col("slope") * (F.col("n") - 1)
    direction = F.when(change > 0.05 * F.col("scale"), "Increasing").when(change < -0.05 * F.col("scale"), "Decreasing").otherwise("Stable")
    return s.select("slope", "intercept", "n", direction.alias("direction"), F.when(F.abs("intercept") > 1e-9, 100 * change / F.abs("intercept")).alias("overall_percent"))


def detrend(series: DataFrame) -> DataFrame:
    line = series.agg(F.regr_slope("y", "t").alias("_s"), F.regr_intercept("y", "t").alias("_i"))
    return series.crossJoin(F.broadcast(line)).withColumn("e", F.col("y") - (F.col("_i") + F.col("_s") * F.col("t"))).drop("_s", "_i")  # one row


def season_correlations(series: DataFrame, frequency: str) -> DataFrame:
    """Correlation of the detrended series with itself at each candidate lag that fits three times, and whether any reaches 0.5."""
    e = detrend(series).select("t", "e")
    pairs = e.select("t", "e", F.explode(F.array(*[F.lit(k) for k in SEASON_LAGS[frequency]])).alias("lag"))
    moved = e.select((F.col("t")).alias("t0"), F.col("e").alias("e0"))
    joined = pairs.join(moved, F.col("t") - F.col("lag") == F.col("t0"))
    spread = F.stddev_pop("e") * F.stddev_pop("e0")
    out = joined.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("e", "e0"), F.when((F.stddev_pop("e") > 1e-9) & (F.stddev_pop("e0") > 1e-9), spread)).alias("correlation"))
    return out.filter("n >= 2 * lag AND correlation IS NOT NULL").select("lag", F.round("correlation", 6).alias("correlation"), (F.col("correlation") >= 0.5).alias("detected"))


def spikes(series: DataFrame) -> DataFrame:
    """Periods further from the median of the detrended series than 3.5 scaled median deviations."""
    e = detrend(series)
    median = e.agg(F.percentile("e", 0.5).alias("_m"))
    d = e.crossJoin(F.broadcast(median)).withColumn("_d", F.abs(F.col("e") - F.col("_m")))  # one row
    mad = d.agg(F.percentile("_d", 0.5).alias("_mad"))
    limit = F.greatest(3.5 * 1.4826 * F.col("_mad"), F.lit(1e-9))
    return d.crossJoin(F.broadcast(mad)).filter((F.col("_mad") > 0) & (F.col("_d") > limit)).select("t", "period", "y", "e")  # one row


def quality(series: DataFrame) -> DataFrame:
    """One row of figures and the warnings they call for."""
    s = series.agg(
        F.count(F.lit(1)).alias("observations"), F.min("period").alias("start"), F.max("period").alias("end"), F.count_if("is_missing").alias("missing_periods"), F.avg("y").alias("mean"), F.percentile("y", 0.5).alias("median"), F.stddev_pop("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max"),
        F.avg((F.col("y") == 0).cast("double")).alias("zero_share"), F.greatest(F.avg(F.abs("y")), F.lit(1e-9)).alias("scale"),
    )
    texts = F.array_compact(
        F.array(F.when(F.col("missing_periods") > 0, "missing periods count as 0"), F.when(F.col("observations") < 60, "short history"), F.when(F.col("std") / F.col("scale") > 1, "strong variation"), F.when(F.col("zero_share") > 0.2, "more than 20 % zeros"))
    )
    status = F.when(F.col("observations") < 12, "Insufficient").when(F.size("warnings") > 0, "Warning").otherwise("Good")
    return s.withColumn("warnings", texts).withColumn("status", status).drop("zero_share", "scale")


def calendar_features(df: DataFrame, time: str = "period") -> DataFrame:
    c = F.col(time)
    return df.withColumns(
        {
            "time_index": F.col("t"), "year": F.year(c), "month": F.month(c), "quarter": F.quarter(c), "day": F.dayofmonth(c), "day_of_week": F.weekday(c), "week_of_year": F.weekofyear(c), "is_weekend": (F.weekday(c) >= 5).cast("int"), "hour": F.hour(c),
        }
    )


def feature_schema(frequency: str, train_size: int) -> dict:
    """Lags and windows that a training series of this size supports."""
    most = max(3, train_size // 3)
    lags = [k for k in sorted({1, 2, 3, *FEATURE_LAGS[frequency]}) if k <= most]
    windows = [w for w in (3, 7, 12) if w <= most]
    return {"lags": lags, "means": windows, "stds": [w for w in windows if w != 12], "warmup": max(lags + windows)}


def future_calendar(spark, last, frequency: str, horizon: int) -> DataFrame:
    ends = spark.createDataFrame([(last,)], "a timestamp")
    steps = F.expr(f"sequence(a, a + {horizon} * {STEPS[frequency]}, {STEPS[frequency]})")
    return ends.select(F.posexplode(steps).alias("step", "period")).filter("step > 0")


def naive(series: DataFrame, future: DataFrame, period: int | None = None, cutoff: int | None = None) -> DataFrame:
    """Last value, or the value one season back, for steps 1.. of ``future``, from the periods before ``cutoff``."""
    past = series if cutoff is None else series.filter(F.col("t") < cutoff)
    end = past.agg(F.max("t").alias("_n"))
    rows = future.crossJoin(F.broadcast(end))  # one row
    back = F.lit(0) if period is None else period - 1 - F.pmod(F.col("step") - 1, F.lit(period))
    at = rows.withColumn("_at", F.col("_n") - back)
    return at.join(past.select(F.col("t").alias("_at"), F.col("y").alias("prediction")), "_at", "left").drop("_at", "_n")


def backtest(series: DataFrame, plan: dict, period: int) -> DataFrame:
    """Naive and seasonal-naive errors on every fold of a plan; all folds are one job."""
    spark = series.sparkSession
    folds = spark.createDataFrame([(i, f["train_end"], f["validation_end"]) for i, f in enumerate(plan["folds"])] or [], "fold int, a long, b long")
    rows = series.select("t", "y").crossJoin(F.broadcast(folds)).filter("t >= a AND t < b")  # at most five folds
    models = F.explode(F.array(F.struct(F.lit("Naive Forecast").alias("model"), (F.col("a") - 1).alias("at")), F.struct(F.lit("Seasonal Naive").alias("model"), (F.col("a") - period + F.pmod(F.col("t") - F.col("a"), F.lit(period))).alias("at"))))
    wanted = rows.select("fold", "t", "y", models.alias("m")).select("fold", "t", "y", "m.*")
    scored = wanted.join(series.select(F.col("t").alias("at"), F.col("y").alias("prediction")), "at")
    per = regression_scores(scored, "y", "prediction", ["model", "fold"])
    return per.groupBy("model").agg(F.round(F.avg("mae"), 6).alias("mae"), F.round(F.avg("rmse"), 6).alias("rmse"), F.round(F.avg("smape"), 6).alias("smape"), F.round(F.stddev_pop("rmse"), 6).alias("rmse_std"), F.count(F.lit(1)).alias("folds"))


def rank_models(scores: DataFrame) -> DataFrame:
    """Models by RMSE, then MAE, with the gain over the naive one in percent; a gain below 5 is flagged."""
    base = scores.filter("model = 'Naive Forecast'").select(F.col("rmse").alias("_base"))
    out = scores.crossJoin(F.broadcast(base))  # one row
    gain = F.when(F.col("_base") > 1e-9, 100 * (F.col("_base") - F.col("rmse")) / F.col("_base"))
    return out.select("model", "rmse", "mae", F.row_number().over(Window.orderBy("rmse", "mae", "model")).alias("rank"), F.round(gain, 6).alias("improvement_vs_naive"), (F.coalesce(gain, F.lit(0.0)) < 5).alias("weak_gain"))


def intervals(forecast: DataFrame, residuals: DataFrame, validated_steps: int) -> DataFrame:
    """80 and 95 % bands from absolute residuals, widening with the square root beyond the validated steps."""
    q = residuals.agg(F.percentile(F.abs("residual"), [0.8, 0.95]).alias("_q"))
    grow = F.sqrt(F.greatest(F.lit(1.0), F.col("step") / F.lit(float(max(1, validated_steps)))))
    p = F.col("prediction")
    return forecast.crossJoin(F.broadcast(q)).select(  # one row
        "*", (p - F.col("_q")[0] * grow).alias("lower_80"), (p + F.col("_q")[0] * grow).alias("upper_80"), (p - F.col("_q")[1] * grow).alias("lower_95"), (p + F.col("_q")[1] * grow).alias("upper_95")
    ).drop("_q")


def nonnegative(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def forecast_summary(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """Total, mean and range of the forecast, and its change against as many periods before."""
    steps = forecast.agg(F.sum("prediction").alias("total"), F.avg("prediction").alias("average"), F.max("prediction").alias("highest"), F.min("prediction").alias("lowest"), F.count(F.lit(1)).alias("_k"))
    end = series.agg((F.max("t") + 1).alias("_n"))
    tail = series.crossJoin(F.broadcast(steps.crossJoin(F.broadcast(end)))).filter("t >= _n - _k").agg(F.sum("y").alias("previous"))  # one row
    return steps.crossJoin(F.broadcast(tail)).select("total", "average", "highest", "lowest", "previous", F.when(F.abs("previous") > 1e-9, 100 * (F.col("total") - F.col("previous")) / F.abs("previous")).alias("change_percent")).drop("_k")  # one row


FORECAST = "period timestamp, step int, prediction double"


def calendar_step(frequency: str):
    """The way from one period to the next, for pandas timestamps."""
    import pandas as pd

    unit, n = {"hourly": ("hours", 1), "daily": ("days", 1), "weekly": ("weeks", 1), "monthly": ("months", 1), "quarterly": ("months", 3)}[frequency]
    return pd.DateOffset(**{unit: n})


def forecast_linear(series: DataFrame, keys: list[str], frequency: str, horizon: int, ridge: float = 0.0) -> DataFrame:
    """Recursive forecasts by (ridge) regression on lags, rolling statistics and the calendar, one series per group.

    A series is a bounded group (one row per period), so each is fitted whole in
    one task, and many series spread over the cluster.
    """
    import numpy as np
    import pandas as pd

    step = {"hourly": pd.DateOffset(hours=1), "daily": pd.DateOffset(days=1), "weekly": pd.DateOffset(weeks=1), "monthly": pd.DateOffset(months=1), "quarterly": pd.DateOffset(months=3)}[frequency]

    def features(y: list[float], when, t: int, schema: dict) -> list[float]:
        out = [t, when.year, when.month, when.quarter, when.day, when.dayofweek, when.isocalendar().week, int(when.dayofweek >= 5), when.hour]
        out += [y[t - k] for k in schema["lags"]]
        out += [float(np.mean(y[t - w : t])) for w in schema["means"]]
        return out + [float(np.std(y[t - w : t])) for w in schema["stds"]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, when = pdf["y"].astype(float).tolist(), list(pdf["period"])
        schema = feature_schema(frequency, len(y))
        names = {k: pdf[k].iloc[0] for k in keys}
        future = [when[-1] + step * (i + 1) for i in range(horizon)]
        model = None
        if len(y) - schema["warmup"] >= 8:
            x = np.array([features(y, when[t], t, schema) for t in range(schema["warmup"], len(y))])
            mean, scale = x.mean(0), x.std(0)
            scale[scale < 1e-12] = 1
            z = np.c_[np.ones(len(x)), (x - mean) / scale]
            penalty = np.eye(z.shape[1]) * max(ridge, 1e-8)
            penalty[0, 0] = 0
            model = np.linalg.solve(z.T @ z + penalty, z.T @ np.array(y[schema["warmup"] :]))
        out = []
        for moment in future:
            value = y[-1] if model is None else float(np.r_[1, (np.array(features(y, moment, len(y), schema)) - mean) / scale] @ model)
            value = value if math.isfinite(value) and abs(value) <= 1e15 else y[-1]
            out.append(value)
            y.append(value)
        return pd.DataFrame({**names, "period": future, "step": range(1, horizon + 1), "prediction": out})

    types = dict(series.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [FORECAST])
    source = series if keys else series.withColumn("_all", F.lit(1))
    return source.groupBy(*(keys or ["_all"])).applyInPandas(fit, schema)


def plan_for(series: DataFrame, horizon: int) -> dict:
    return walk_forward_plan(series.count(), horizon)
