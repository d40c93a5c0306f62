"""Kernel machines against an exact solver on small tables, and models in the comparison."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from millrace.operators import compare, kernels


def table(spark, x, y):
    return spark.createDataFrame([(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist()))], ["row_key", "label", "features"]).repartition(3)


def exact(x, y, loss, weights, gamma, steps=400):
    """The kernel machine itself by the same losses: fits alpha and a constant on the whole kernel matrix."""
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    root = np.linalg.cholesky(kernel + 1e-8 * np.eye(len(x)))
    z = np.c_[root, np.ones(len(x))]
    ridge, w = np.append(np.ones(len(x)), 1e-9), np.zeros(len(x) + 1)
    for _ in range(steps):
        _, a, b = loss(y, z @ w)
        w = np.linalg.solve((z * (weights * a)[:, None]).T @ z + np.diag(ridge), z.T @ (weights * b))
    return z @ w


def moons(n, seed=0):
    rng = np.random.default_rng(seed)
    t, side = rng.uniform(0, np.pi, n), rng.integers(0, 2, n)
    x = np.c_[np.cos(t) * (1 - 2 * side) + side, np.sin(t) * (1 - 2 * side) + side / 2] + rng.normal(0, 0.1, (n, 2))
    return x, side


def test_classes_are_close_to_the_exact_machine(spark):
    x, side = moons(160)
    machine = kernels.KernelMachine("classification", width=500).fit(table(spark, x, side))
    y = np.where(side == 1, 1.0, -1.0)
    c = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    want, got = exact(x, y, kernels.hinge, c, 1 / (2 * x.var())), machine.decide(x)[:, 0]
    assert np.abs(got - want).mean() < 0.15 and (np.sign(got) == np.sign(want)).mean() > 0.96
    assert all(b <= a + 1e-9 for a, b in zip(machine.losses, machine.losses[1:]))  # no step raises the loss
    said = {r["row_key"]: r["prediction"] for r in machine.transform(table(spark, x, side)).collect()}
    assert np.mean([said[i] == side[i] for i in range(len(side))]) > 0.93  # where a line gets 0.85


def test_numbers_are_close_to_the_exact_machine(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, (150, 1))
    y = np.sin(2 * x[:, 0]) + rng.normal(0, 0.1, 150)
    machine = kernels.KernelMachine("regression", width=400).fit(table(spark, x, y))
    want = exact(x, y, kernels.tube(0.1), np.ones(150), 1 / x.var())
    assert np.abs(machine.decide(x)[:, 0] - want).mean() < 0.05


def test_three_classes_and_any_partitioning(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 150)
    x = np.c_[np.cos(y * 2.1), np.sin(y * 2.1)] + rng.normal(0, 0.3, (150, 2))
    rows = table(spark, x, y)
    a, b = (kernels.KernelMachine("classification", width=60).fit(r) for r in (rows, rows.repartition(1)))
    assert np.abs(a.decide(x) - b.decide(x)).max() < 1e-6
    said = {r["row_key"]: r["prediction"] for r in a.transform(rows).collect()}
    assert np.mean([said[i] == y[i] for i in range(150)]) > 0.9


def test_one_class_raises(spark):
    with pytest.raises(ValueError):
        kernels.KernelMachine("classification").fit(table(spark, np.ones((4, 1)), np.zeros(4)))


def test_neighbours_and_kernels_are_compared_with_the_others(spark):
    rng = np.random.default_rng(3)
    side, turn = np.arange(90) % 2, rng.uniform(0, 2 * np.pi, 90)
    x = (np.c_[np.cos(turn), np.sin(turn)].T * (1 + 1.5 * side)).T + rng.normal(0, 0.15, (90, 2))  # a ring around a ring
    df = spark.createDataFrame([(i, float(a), float(b), "k" + str(i % 3), str(s)) for i, ((a, b), s) in enumerate(zip(x, side))], "id long, a double, b double, c string, y string")
    df = df.withColumn("y", F.col("y").cast("int"))
    names = ["K-Nearest Neighbors", "Support Vector Machine", "Logistic Regression"]
    out = compare.compare_models(df, "y", ["a", "b"], [], "id", names=names)
    assert sorted(r["model"] for r in out) == sorted(names) and out[-1]["model"] == "Logistic Regression"
    assert all(r["cv_score"] > 0.9 and r["test_score"] > 0.85 for r in out[:2]) and out[0]["cv_score"] > out[-1]["cv_score"] + 0.05


def test_wide_tables_are_refused(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(40)], "id long, a double, y int")
    with pytest.raises(ValueError, match="encoded"):
        compare.compare_models(df, "y", ["a"], [], "id", names=[], most_features=0)
