"""Evaluation in time order against plain Python on small tables."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare


def expected(rows, classes):
    """(cut, [(rows before, rows judged)]) of (time, class) rows, by sorting them all."""
    rows = sorted(rows)
    n = len(rows)
    cut = n * 3 // 4
    while 0 < cut < n and rows[cut - 1][0] == rows[cut][0]:
        cut -= 1
    train, test = rows, []
    if n >= 30 and cut >= 10 and n - cut >= 2:
        before, after = rows[:cut], rows[cut:]
        sizes = [sum(y == c for _, y in before) for c in {y for _, y in before}]
        if not classes or (min(sizes) >= 2 and {y for _, y in after} <= {y for _, y in before}):
            train, test = before, after
    times = sorted({t for t, _ in train})
    k = min(5 if n >= 100 else 3, len(times) - 1)
    splits = []
    if k >= 2:
        size = len(times) // (k + 1)
        for i in range(k):
            start = len(times) - (k - i) * size
            known, judged = set(times[:start]), set(times[start : start + size])
            a, b = [r for r in train if r[0] in known], [r for r in train if r[0] in judged]
            if not classes or (len({y for _, y in a}) >= 2 and {y for _, y in b} <= {y for _, y in a}):
                splits.append((a, b))
    return ([], []) if len(splits) < 2 else (test, splits)


@pytest.mark.parametrize("seed", range(8))
def test_temporal_plan(spark, seed):
    r = random.Random(seed)
    days, n = r.choice([(3, 40), (40, 25), (200, 60), (30, 250), (2, 12), (15, 130)]) if seed else (1, 50)
    rows = [(date(2024, 1, 1) + timedelta(days=int(r.triangular(0, days, days / 3))), r.choice("aaab" if seed % 2 else "abc")) for _ in range(n)]
    df = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], "t date, y string, id int").repartition(3)
    for classes in (False, True):
        plan = compare.temporal_plan(df, "t", "y" if classes else None)
        test, splits = expected(rows, classes)
        assert plan["folds"] == len(splits) and plan["has_holdout"] == bool(test)
        assert plan["mode"] == ("exploratory" if not splits else "holdout_cv" if test else "cv_only")
        dealt = compare.deal_by_time(df, "t", plan).collect()
        assert sorted((x["t"], x["y"]) for x in dealt if x["is_test"]) == sorted(test)
        for i, (before, judged) in enumerate(splits):
            assert sorted((x["t"], x["y"]) for x in dealt if x["fold"] == i) == sorted(judged)
            assert sorted((x["t"], x["y"]) for x in dealt if x["t"] < plan["splits"][i][0]) == sorted(before)
        parts = {x["part"]: (x["n_train"], x["n_rows"]) for x in compare.temporal_parts(df, "t", plan).collect()}
        assert [parts[f"fold {i}"] for i in range(len(splits))] == [(len(a), len(b)) for a, b in splits]


def test_temporal_plan_needs_every_time(spark):
    df = spark.createDataFrame([(None, 1), (date(2024, 1, 1), 2)], "t date, y int")
    with pytest.raises(ValueError, match="time"):
        compare.temporal_plan(df, "t")
    assert compare.temporal_plan(df.limit(0), "t")["mode"] == "exploratory"


def test_comparison_in_time_order(spark):
    """The rule turns around with time: only an evaluation in time order sees that the model does not carry over."""
    rows = spark.range(400).select(F.col("id").cast("int").alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("t"), F.pmod(F.col("id") * 37, F.lit(100)).cast("double").alias("x"))
    rows = rows.withColumn("y", ((F.col("x") > 50) != (F.col("id") >= 300)).cast("int"))
    late = compare.compare_models(rows, "y", ["x"], [], "id", names=["Decision Tree"], time_column="t")[0]
    mixed = compare.compare_models(rows, "y", ["x"], [], "id", names=["Decision Tree"])[0]
    assert late["cv_score"] > 0.95 and late["test_score"] < 0.1 < mixed["test_score"]
