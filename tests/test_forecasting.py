"""Trees, rolling-origin cuts, predictions, ranking and forecasts against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import forecasting, sampling, timeseries, trees

# ---- trees


def brute_split(x, y, min_leaf):
    """Least squared error over every feature and every cut between two values."""
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= min_leaf:
                error = sum(((y[s] - y[s].mean()) ** 2).sum() for s in (low, ~low))
                if best is None or error < best[0] - 1e-9:
                    best = (error, f, cut)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_root_split_is_the_best_one(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 9, (40, 4)).astype(float), rng.normal(size=40)
    bins = trees.Bins(x)
    tree, fitted, gains = trees.grow(bins, bins.codes(x), y, min_leaf=3, depth=1)
    error, _, _ = brute_split(x, y, 3)
    assert math.isclose(((y - fitted) ** 2).sum(), error, rel_tol=1e-9)
    assert math.isclose(gains.sum(), ((y - y.mean()) ** 2).sum() - error, rel_tol=1e-9)


def test_trees_keep_their_limits_and_predict_their_fit():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 5)), rng.normal(size=300)
    bins = trees.Bins(x)
    for depth, leaves, min_leaf in ((3, None, 5), (None, 7, 20), (2, 3, 1), (None, None, 150), (9, None, 3)):
        tree, fitted, _ = trees.grow(bins, bins.codes(x), y, min_leaf, depth, leaves)
        n_leaves = sum(f < 0 for f in tree.feature)
        assert n_leaves <= min(leaves or 300, 2**depth if depth else 300)
        assert [tree.predict(r) for r in x] == fitted.tolist()
        assert min(np.unique(fitted, return_counts=True)[1]) >= min_leaf
    whole, fitted, _ = trees.grow(bins, bins.codes(x), y, 1)
    assert np.allclose(fitted, y)  # to the last row where nothing holds it back


def test_constant_features_and_targets_make_leaves():
    x, y = np.ones((20, 2)), np.arange(20.0)
    assert trees.forest(x, y, 4, 9, 3).importance.tolist() == [0, 0]
    assert trees.boosting(np.arange(40.0).reshape(20, 2), np.full(20, 7.0), 5, 3, depth=2).predict(np.array([3.0, 4.0])) == 7.0


def test_ensembles_learn_and_repeat():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = np.where(x[:, 0] > 0, 5.0, -5.0) + x[:, 1] ** 2
    for make in (lambda: trees.forest(x, y, 32, 9, 3), lambda: trees.boosting(x, y, 45, 3, depth=2), lambda: trees.boosting(x, y, 50, 20, leaves=15)):
        a, b = make(), make()
        p = np.array([a.predict(r) for r in x])
        assert ((p - y) ** 2).mean() < 0.1 * y.var() and a.importance.argmax() == 0 and math.isclose(a.importance.sum(), 1)
        assert [b.predict(r) for r in x[:20]] == p[:20].tolist()


def test_many_values_are_binned_by_quantiles():
    x = np.exp(np.random.default_rng(3).normal(size=(5000, 1)))
    bins = trees.Bins(x)
    assert len(bins.cuts[0]) <= trees.MOST_BINS and np.bincount(bins.codes(x)[:, 0]).max() < 60


# ---- cuts and predictions


def series_of(spark, lengths, value, start=dt.datetime(2021, 1, 4), step=dt.timedelta(days=1)):
    rows = [(k, t, start + step * t, float(value(k, t))) for k, n in lengths.items() for t in range(n)]
    return spark.createDataFrame(rows, "k string, t long, period timestamp, y double")


def wave(k, t):
    return 100 + len(k) * 7 + 20 * math.sin(t / 7 * 2 * math.pi) + (t * 37 % 11)


def test_cuts_equal_the_plan_of_each_size(spark):
    lengths = {f"s{n}": n for n in (1, 11, 12, 13, 23, 24, 40, 59, 60, 123, 299, 300, 460)}
    for horizon in (1, 7, 90):
        rows = forecasting.evaluation_cuts(series_of(spark, lengths, wave), ["k"], horizon).collect()
        for k, n in lengths.items():
            plan = sampling.walk_forward_plan(n, horizon)
            mine = [r for r in rows if r["k"] == k]
            folds = [(r["train_end"], r["train_end"] + r["steps"]) for r in sorted(mine, key=lambda r: r["fold"]) if r["kind"] == "fold"]
            assert folds == [(f["train_end"], f["validation_end"]) for f in plan["folds"]]
            assert {r["mode"] for r in mine} == {plan["mode"]} and {r["smallest"] for r in mine} == {plan["folds"][0]["train_end"] if folds else n}
            assert [(r["train_end"], r["steps"]) for r in mine if r["kind"] == "holdout"] == ([(plan["holdout_start"], n - plan["holdout_start"])] if folds else [])
            assert [(r["train_end"], r["steps"]) for r in mine if r["kind"] == "future"] == [(n, horizon)]


@pytest.fixture(scope="module")
def evaluated(spark):
    series = series_of(spark, {"a": 90, "bb": 130, "short": 10, "tiny": 30}, wave)
    return series, forecasting.evaluate(series, ["k"], "daily", 10)


def test_statuses(evaluated):
    status = {(r["k"], r["model"]): r["status"] for r in evaluated[1]["status"].collect()}
    assert all(status["a", m] == status["bb", m] == "SUCCESS" for m in forecasting.MODELS)
    skipped = "SKIPPED_INSUFFICIENT_HISTORY"
    assert status["short", forecasting.NAIVE] == "SUCCESS" and status["short", forecasting.SEASONAL] == skipped
    assert {status["short", m] for m in forecasting.FITTED} == {skipped} and status["tiny", forecasting.SEASONAL] == "SUCCESS"
    # tiny: 24 periods before the holdout, two folds of 4
    smallest = 30 - 6 - 2 * 4
    assert status["tiny", "Random Forest"] == ("SUCCESS" if smallest - timeseries.feature_schema("daily", smallest)["warmup"] >= 8 else skipped)


def test_scores_and_ranking_equal_a_plain_version(evaluated):
    series, out = evaluated
    y = {(r["k"], r["t"]): r["y"] for r in series.collect()}
    errors = {}
    for r in out["predictions"].filter("kind = 'fold'").collect():
        errors.setdefault((r["k"], r["model"], r["fold"]), []).append((y[r["k"], r["t"]], r["prediction"]))
        if r["model"] == forecasting.NAIVE:
            assert r["prediction"] == y[r["k"], r["train_end"] - 1]
        if r["model"] == forecasting.SEASONAL:
            assert r["prediction"] == y[r["k"], r["train_end"] - 7 + (r["step"] - 1) % 7]
    folds = {}
    for r in out["scores"].collect():
        pairs = errors.pop((r["k"], r["model"], r["fold"]))
        assert math.isclose(r["rmse"], math.sqrt(np.mean([(a - p) ** 2 for a, p in pairs])), rel_tol=1e-9)
        assert math.isclose(r["mae"], np.mean([abs(a - p) for a, p in pairs]), rel_tol=1e-9)
        folds.setdefault((r["k"], r["model"]), []).append(r["rmse"])
    assert not errors
    for k in ("a", "bb", "tiny"):
        ranked = sorted((r for r in out["ranking"].collect() if r["k"] == k), key=lambda r: r["rank"])
        assert [r["model"] for r in ranked] == sorted((m for s, m in folds if s == k), key=lambda m: np.mean(folds[k, m]))
        base = np.mean(folds[k, forecasting.NAIVE])
        for r in ranked:
            assert math.isclose(r["improvement_vs_naive"], 100 * (base - r["rmse"]) / base, abs_tol=1e-6) and math.isclose(r["rmse_std"], np.std(folds[k, r["model"]]), abs_tol=1e-9)
    assert ranked[0]["folds"] == 2


def test_holdout_never_reaches_the_ranking(spark, evaluated):
    series, out = evaluated
    ends = {r["k"]: r["train_end"] for r in out["cuts"].filter("kind = 'holdout'").collect()}
    shaken = series.filter("k = 'a'").withColumn("y", F.when(F.col("t") >= ends["a"], 9e5).otherwise(F.col("y")))
    again = forecasting.evaluate(shaken, ["k"], "daily", 10)
    pick = lambda o: [tuple(r) for r in o["ranking"].filter("k = 'a'").orderBy("rank").collect()]
    assert pick(again) == pick(out)


def test_same_predictions_on_any_partitioning(spark, evaluated):
    series, out = evaluated
    again = forecasting.evaluate(series.orderBy(F.rand(1)).repartition(7), ["k"], "daily", 10)
    rows = lambda o: sorted((r["k"], r["model"], r["kind"], r["fold"], r["step"], r["prediction"]) for r in o["predictions"].collect())
    assert rows(again) == rows(out)


def test_fitted_models_follow_a_plain_recursion(spark):
    """Each step rebuilds lags from the predictions before it."""
    n, steps = 60, 6
    y = [wave("q", t) for t in range(n)]
    series = series_of(spark, {"q": n}, wave)
    schema = timeseries.feature_schema("daily", n)
    start = dt.datetime(2021, 1, 4)

    def features(past, t):
        when = start + dt.timedelta(days=t)
        out = [t, when.year, when.month, (when.month + 2) // 3, when.day, when.weekday(), when.isocalendar()[1], int(when.weekday() >= 5), when.hour]
        return np.array(out + [past[t - k] for k in schema["lags"]] + [np.mean(past[t - w : t]) for w in schema["means"]] + [np.std(past[t - w : t]) for w in schema["stds"]], float)

    x, target = np.array([features(y, t) for t in range(schema["warmup"], n)]), np.array(y[schema["warmup"] :])
    wanted = spark.createDataFrame([("q", m, "future", 0, n, steps, n) for m in forecasting.FITTED], "k string, model string, kind string, fold int, train_end long, steps int, smallest long")
    got = {}
    for r in forecasting.predictions(series, wanted, ["k"], "daily").orderBy("step").collect():
        got.setdefault(r["model"], []).append(r["prediction"])
    models = {"Random Forest": trees.forest(x, target, 32, 9, 3), "Gradient Boosting": trees.boosting(x, target, 45, 3, depth=2), "Hist Gradient Boosting": trees.boosting(x, target, 50, 20, leaves=15)}
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0))
    ridge = np.linalg.solve(z.T @ z + 10 * np.eye(z.shape[1]), z.T @ (target - target.mean()))
    for name, model in models.items():
        past = list(y)
        for _ in range(steps):
            past.append(model.predict(features(past, len(past))))
        assert np.allclose(got[name], past[n:], rtol=1e-12)
    past = list(y)
    for _ in range(steps):
        past.append(float(target.mean() + (features(past, len(past)) - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0)) @ ridge))
    assert np.allclose(got["Ridge Regression"], past[n:], rtol=1e-9)


# ---- forecasts


def test_forecast_of_several_series(spark):
    series = series_of(spark, {"a": 140, "short": 5}, wave)
    out = forecasting.forecast(series, "daily", 12, ["k"])
    rows = out["forecast"].orderBy("k", "step").collect()
    assert [r["step"] for r in rows] == [*range(1, 13)] * 2
    a, short = rows[:12], rows[12:]
    assert a[0]["period"] == dt.datetime(2021, 1, 4) + dt.timedelta(days=140) and all(r["lower_95"] <= r["lower_80"] <= r["prediction"] <= r["upper_80"] <= r["upper_95"] for r in a)
    assert {r["prediction"] for r in short} == {wave("short", 4)} and all(r["lower_80"] is None and r["model"] == forecasting.NAIVE for r in short)
    best = {r["k"]: r for r in out["best"].collect()}
    assert best["a"]["holdout_rmse"] > 0 and best["a"]["improvement_vs_naive"] > 5 and not best["a"]["weak_gain"]
    assert best["short"]["reliability"] == "Low" and best["short"]["holdout_rmse"] is None and best["a"]["reliability"] in ("High", "Medium")
    # the wave's residuals widen with the square root beyond the validated steps
    width = [r["upper_80"] - r["prediction"] for r in a]
    steps = out["cuts"].filter("k = 'a' AND kind = 'fold'").first()["steps"]
    assert all(math.isclose(w, width[0] * math.sqrt(max(1, (i + 1) / steps)), rel_tol=1e-9) for i, w in enumerate(width))


def test_forecast_of_one_series_without_keys_by_month(spark):
    rows = [(t, dt.datetime(2015 + t // 12, t % 12 + 1, 1), float(50 * (t % 12))) for t in range(72)]
    out = forecasting.forecast(spark.createDataFrame(rows, "t long, period timestamp, y double"), "monthly", 5, models=(forecasting.NAIVE, forecasting.SEASONAL, "Ridge Regression"), floor_at_zero=True)
    found = out["forecast"].orderBy("step").collect()
    assert [r["period"] for r in found] == [dt.datetime(2021, m, 1) for m in range(1, 6)] and found[0]["model"] == forecasting.SEASONAL
    assert [r["prediction"] for r in found] == [0.0, 50.0, 100.0, 150.0, 200.0] and "_series" not in out["forecast"].columns


def test_a_model_out_of_bounds_is_not_ranked_and_replaced(spark):
    series = series_of(spark, {"a": 80}, lambda k, t: 1e14 * (1 + t % 3) if t < 70 else 4e15)
    out = forecasting.evaluate(series, ["k"], "daily", 5, (forecasting.NAIVE, "Gradient Boosting"))
    assert {r["model"] for r in out["ranking"].collect()} == {forecasting.NAIVE, "Gradient Boosting"}
    huge = series_of(spark, {"a": 80}, lambda k, t: 4e15 + t)
    out = forecasting.forecast(huge, "daily", 5, ["k"], models=(forecasting.NAIVE, "Gradient Boosting"))
    assert {r["model"]: r["status"] for r in out["status"].collect()} == {forecasting.NAIVE: "SUCCESS", "Gradient Boosting": "FAILED_SAFE"}
    assert {r["prediction"] for r in out["forecast"].collect()} == {4e15 + 79}


def test_importance_names_the_ten_weightiest_features(spark):
    series = series_of(spark, {"a": 100}, lambda k, t: t % 7 * 10.0)
    out = forecasting.forecast(series, "daily", 3, ["k"], models=("Random Forest", forecasting.NAIVE))
    rows = out["importance"].orderBy("rank").collect()
    assert len(rows) == 10 and [r["value"] for r in rows] == sorted((r["value"] for r in rows), reverse=True)
    assert {rows[0]["feature"], rows[1]["feature"]} & {"lag_7", "day_of_week"}
