"""Running totals over ranges and ranking scores against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, running


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_totals_equal_a_loop(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), v, rng.randrange(9)) for v in rng.sample(range(1000), 200)]
    got = running.running_totals(spark.createDataFrame(rows, "k string, v int, x int"), ["k"], [F.desc("v")], {"upto": "x"}, ranges).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["upto"] == sum(x for k, v, x in rows if k == r["k"] and v >= r["v"])
    flat = running.running_totals(spark.createDataFrame(rows, "k string, v int, x int"), [], [F.asc("v")], {"upto": "x"}, ranges).collect()
    assert all(r["upto"] == sum(x for _, v, x in rows if v <= r["v"]) for r in flat)


def test_no_task_sees_all_scores(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000 / 5000).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    plan = metrics.score_curve(rows, "y", "p")._jdf.queryExecution().executedPlan().toString()
    singles = plan.split("Exchange SinglePartition")[1:]
    assert all("keys=[_range" in below.splitlines()[1] for below in singles)  # a row per range, never per score


def test_scores_by_class_equal_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.randrange(12) / 10, rng.random(), rng.random()) for _ in range(150)]
    df = spark.createDataFrame(rows, "y string, x double, yy double, z double")
    got = {r["class"]: r for r in metrics.one_vs_rest(df, "y", {"x": "x", "y": "yy", "z": "z"}, None).collect()}
    want = {c: auc([(r[i], r[0] == c) for r in rows]) for i, c in enumerate("xyz", 1)}
    assert all(abs(got[c]["roc_auc"] - want[c]) < 1e-12 and got[c]["n"] == sum(r[0] == c for r in rows) for c in "xyz")
    macro = metrics.macro_ranking_scores(df, "y", {"x": "x", "y": "yy", "z": "z"}, None).first()
    assert abs(macro["roc_auc_ovr"] - sum(want.values()) / 3) < 1e-12


def test_macro_is_null_unless_the_classes_agree(spark):
    df = spark.createDataFrame([("x", 0.1, 0.9), ("y", 0.2, 0.8), ("x", 0.4, 0.6)], "y string, a double, b double")
    assert metrics.macro_ranking_scores(df, "y", {"x": "a", "y": "b"}).first()["roc_auc_ovr"] is not None
    assert metrics.macro_ranking_scores(df, "y", {"x": "a", "y": "b", "never": "a"}).first()["roc_auc_ovr"] is None
    assert metrics.macro_ranking_scores(df, "y", {"x": "a"}).first()["roc_auc_ovr"] is None
    only = metrics.ranking_scores(df.withColumn("one", F.lit(1)), "one", "a").first()
    assert only["roc_auc"] is None and only["average_precision"] == 1.0
