"""Kernel machines with a Gaussian kernel, fitted by sums that merge over partitions.

Random Fourier features (Rahimi and Recht, 2007) turn the kernel into inner products
of ``width`` cosines, drawn once from a seed. The hinge and the epsilon-insensitive
loss are lowered by iterated reweighted least squares: both are sums of absolute
values, each of which lies below a parabola that touches it at the present fit, so
that every step solves one small linear system and never raises the loss. A step is
one scan; a task sends the sums of its rows, and the driver holds ``width`` squared
numbers per class, however many rows there are.

The kernel is approximated: its error falls as one over the root of ``width``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least distance from a kink at which a parabola is put, and the relative change of the loss at which steps end.
NEAR, SETTLED = 1e-3, 2e-3
SUMS = "part int, sums array<double>"
#: Sums that reach the driver in a step; those of more partitions are added up by tasks before.
PARTS = 16


class Features:
    """Cosines that stand for a Gaussian kernel of the given gamma, and a constant last."""

    def __init__(self, inputs: int, width: int, gamma: float, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(0, np.sqrt(2 * gamma), (width, inputs))
        self.shifts = rng.uniform(0, 2 * np.pi, width)
        self.width = width + 1

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.directions.T + self.shifts)
        return np.c_[z, np.ones(len(x))]


def hinge(y: np.ndarray, f: np.ndarray):
    """Loss, and weight and target-weighted sum of the touching parabola, for labels of -1 and 1."""
    u = 1 - y * f
    near = np.maximum(np.abs(u), NEAR)
    return np.maximum(u, 0), 0.5 / near, 0.5 / near * y + 0.5 * y


def tube(epsilon: float):
    """The epsilon-insensitive loss, as half the distances to both edges of the tube."""

    def loss(y: np.ndarray, f: np.ndarray):
        r = y - f
        low, high = 0.5 / np.maximum(np.abs(r - epsilon), NEAR), 0.5 / np.maximum(np.abs(r + epsilon), NEAR)
        return np.maximum(np.abs(r) - epsilon, 0), low + high, low * (y - epsilon) + high * (y + epsilon)

    return loss


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))


def _step_sums(features: Features, fits: np.ndarray, targets: list, loss, weights: dict):
    """Task function: for each machine the loss and the sums of its least-squares system."""
    upper = np.triu_indices(features.width)

    def run(frames):
        n = features.width
        left, right, lost = np.zeros((len(targets), n, n)), np.zeros((len(targets), n)), np.zeros(len(targets))
        for pdf in frames:
            if not len(pdf):
                continue
            z, label = features.of(np.array(pdf["x"].tolist(), float)), pdf["label"].to_numpy(float)
            for k, target in enumerate(targets):
                y = label if target is None else np.where(label == target, 1.0, -1.0)
                c = np.ones(len(y)) if target is None else np.where(y > 0, *weights[target])
                value, a, b = loss(y, z @ fits[k])
                lost[k] += c @ value
                left[k] += (z * (c * a)[:, None]).T @ z
                right[k] += z.T @ (c * b)
        every = np.concatenate([np.concatenate([left[k][upper], right[k], lost[k : k + 1]]) for k in range(len(targets))])
        yield pd.DataFrame({"part": [np.int32(TaskContext.get().partitionId() % PARTS)], "sums": [every]})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [np.sum(pdf["sums"].tolist(), axis=0)]})


def _total(sums: DataFrame, n_partitions: int) -> np.ndarray:
    """All sums added up, in the order of parts."""
    if n_partitions > PARTS:
        sums = sums.groupBy("part").applyInPandas(_added, SUMS)
    return np.sum([r["sums"] for r in sums.orderBy("part").collect()], axis=0)


class Machine:
    """One fit per target (None: a regression); ``transform`` adds ``prediction``."""

    def __init__(self, features: Features, fits: np.ndarray, targets: list, losses: list[float]):
        self.features, self.fits, self.targets, self.losses = features, fits, targets, losses

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.features.of(x) @ self.fits.T

    def transform(self, rows: DataFrame) -> DataFrame:
        features, fits, targets = self.features, self.fits, self.targets

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            f = features.of(np.array(x.tolist(), float).reshape(len(x), -1)) @ fits.T
            if targets == [None]:
                return pd.Series(f[:, 0])
            # one machine tells two classes apart; of more the first of the highest
            return pd.Series(np.where(f[:, 0] > 0, targets[0][0], targets[0][1]) if len(f.T) == 1 else np.array([t[0] for t in targets])[f.argmax(1)])

        return rows.withColumn("prediction", predict(vector_to_array("features")))


class KernelMachine:
    """Estimator over (label, features): classes by ``hinge`` with balanced weights, numbers by ``tube``."""

    def __init__(self, task: str, penalty: float = 1.0, width: int = 256, epsilon: float = 0.1, steps: int = 30, seed: int = 42):
        self.task, self.penalty, self.width, self.epsilon, self.steps, self.seed = task, penalty, width, epsilon, steps, seed

    def fit(self, rows: DataFrame) -> Machine:
        data = _arrays(rows)
        # the gamma of unit width: one over inputs times the variance of all numbers
        long = data.select(F.size("x").alias("inputs"), F.inline(F.transform("x", lambda v: F.struct(v.alias("v")))))
        shape = long.agg(F.max("inputs"), F.var_pop("v")).first()
        inputs, spread = shape[0] or 0, shape[1] or 0.0
        features = Features(inputs, self.width, 1 / (inputs * spread) if inputs and spread > 0 else 1.0, self.seed)
        targets, weights = [None], {}
        loss = tube(self.epsilon)
        if self.task == "classification":
            counts = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes
            classes, n, loss = sorted(counts), sum(counts.values()), hinge
            if len(classes) < 2:
                raise ValueError("a kernel machine needs two classes")
            balanced = lambda c: n / (2 * c)
            targets = [classes[1]] if len(classes) == 2 else classes
            weights = {c: (balanced(counts[c]), balanced(n - counts[c])) for c in targets}
        upper = np.triu_indices(features.width)
        ridge = np.append(np.ones(self.width), 1e-9)  # the constant is not penalised
        n_partitions = data.rdd.getNumPartitions()
        fits, before, losses = np.zeros((len(targets), features.width)), np.inf, []
        for _ in range(self.steps):
            sums = data.mapInPandas(_step_sums(features, fits, targets, loss, weights), SUMS)
            got = np.split(_total(sums, n_partitions), len(targets))
            now = sum(self.penalty * got[k][-1] + 0.5 * ridge @ fits[k] ** 2 for k in range(len(targets)))
            losses.append(float(now))
            if before - now <= SETTLED * max(1.0, abs(now)):
                break
            before = now
            for k in range(len(targets)):
                left = np.zeros((features.width, features.width))
                left[upper] = got[k][: len(upper[0])]
                left += np.triu(left, 1).T
                fits[k] = np.linalg.solve(self.penalty * left + np.diag(ridge), self.penalty * got[k][len(upper[0]) : -1])
        named = [None] if targets == [None] else [(t, next(c for c in classes if c != t)) for t in targets]
        return Machine(features, fits, named, losses)
