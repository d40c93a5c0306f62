"""Exact quantiles by selection against numpy and Spark's own percentile."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles

POINTS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def groups():
    rng = random.Random(4)
    out = []
    for g, n, draw in (
        ("even", 3000, lambda: rng.random()), ("skewed", 2500, lambda: math.exp(rng.gauss(0, 12))), ("ties", 2600, lambda: float(rng.choice([1, 1, 1, 2, 5]))), ("same", 2100, lambda: 7.0),
        (None, 2300, lambda: rng.gauss(-5, 1)), ("small", 40, lambda: rng.random()), ("one", 1, lambda: 3.5), ("odd", 2200, lambda: rng.choice([float("inf"), float("-inf"), -0.0, 0.0, rng.random()])),
    ):
        out += [(g, i % 2, draw()) for i in range(n)]
    out += [("even", 0, None), ("blank", 0, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(groups(), "g string, h int, v double").repartition(5).cache()


def rows(df):
    return sorted((repr(r[0]), r["n"], [repr(x) for x in r["q"]]) for r in df.collect())


@pytest.mark.parametrize("limit", [12, 2400, 10**6])
def test_selection_equals_percentile(table, limit):
    got = quantiles.exact_quantiles(table, ["g"], "v", POINTS, limit=limit)
    want = table.filter("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", POINTS).alias("q"))
    clean = lambda rs: [(g, n, [x.replace("-0.0", "0.0") if x == "-0.0" else x for x in q]) for g, n, q in rs]
    assert clean(rows(got)) == clean(rows(want))


def test_two_keys_and_no_keys(table):
    got = {(r["g"], r["h"]): r["q"] for r in quantiles.exact_quantiles(table, ["g", "h"], "v", [0.3], limit=500).collect()}
    data = [r for r in groups() if r[2] is not None and r[0] not in ("odd",)]
    for g, h in {(r[0], r[1]) for r in data}:
        assert math.isclose(got[g, h][0], np.quantile([r[2] for r in data if r[:2] == (g, h)], 0.3), rel_tol=1e-12)
    plain = table.filter("g <> 'odd'")
    (one,) = quantiles.exact_quantiles(plain, [], "v", [0.5, 0.99], limit=500).collect()
    values = [r[2] for r in data if r[0] is not None]
    assert one["n"] == len(values) and np.allclose(one["q"], np.quantile(values, [0.5, 0.99]), rtol=1e-12)


def test_sketches_that_miss_cost_rounds_and_no_values(table, monkeypatch):
    """A bracket far off its ranks is opened and searched again."""
    calls, real = [], quantiles._around

    def far_off_at_first(grid, first, last):
        calls.append(1)
        return (F.element_at(grid, 1), F.element_at(grid, 2)) if len(calls) == 1 else real(grid, first, last)

    monkeypatch.setattr(quantiles, "_around", far_off_at_first)
    got = quantiles.exact_quantiles(table.filter("g = 'even'"), ["g"], "v", [0.25, 0.75], limit=100).collect()[0]["q"]
    values = [r[2] for r in groups() if r[0] == "even" and r[2] is not None]
    assert len(calls) > 1 and np.allclose(got, np.quantile(values, [0.25, 0.75]), rtol=1e-12)


def test_rounds_that_never_hit_still_give_the_values(table, monkeypatch):
    monkeypatch.setattr(quantiles, "ROUNDS", 1)
    monkeypatch.setattr(quantiles, "_around", lambda grid, first, last: (F.element_at(grid, 1), F.element_at(grid, 1)))
    got = quantiles.exact_quantiles(table.filter("g = 'even'"), ["g"], "v", [0.25, 0.75], limit=100).collect()[0]["q"]
    values = [r[2] for r in groups() if r[0] == "even" and r[2] is not None]
    assert np.allclose(got, np.quantile(values, [0.25, 0.75]), rtol=1e-12)


def test_sketches_that_differ_from_run_to_run_give_the_same_values(table, monkeypatch):
    """Merged in another order, a sketch has other values; what was counted must be the bracket that is kept."""
    shaken, real = F.udf(lambda v, down: v + down * random.Random().random() * 0.02, "double").asNondeterministic(), quantiles._around

    def around(grid, first, last):
        low, high = real(grid, first, last)
        return shaken(low, F.lit(-1.0)), shaken(high, F.lit(1.0))

    monkeypatch.setattr(quantiles, "_around", around)
    values = [r[2] for r in groups() if r[0] == "even" and r[2] is not None]
    for limit in (200, 2000):  # narrowed once more, and not
        got = quantiles.exact_quantiles(table.filter("g = 'even'"), ["g"], "v", [0.25, 0.5, 0.75], limit=limit).collect()[0]["q"]
        assert np.allclose(got, np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_no_rows(spark, table):
    empty = table.filter("false")
    assert quantiles.exact_quantiles(empty, ["g"], "v", [0.5]).collect() == [] and quantiles.exact_quantiles(empty, [], "v", [0.5]).collect() == []


def test_statistics_with_quantiles_keep_groups_without_values(table):
    stats = table.groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    out = {r["g"]: r["_p"] for r in quantiles.with_quantiles(stats, table, ["g"], "v", [0.5], limit=100).collect()}
    assert out["blank"] is None and out["same"] == [7.0] and len(out) == 9
