"""Exact neighbours against brute force."""

import math
import random

import pytest

from millrace.operators import neighbours


def brute(train, queries, k):
    out = []
    for q, *x in queries:
        if all(v is not None and math.isfinite(v) for v in x):
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, t[1:-1])), t[0], t[-1]) for t in train if all(v is not None and math.isfinite(v) for v in t[1:-1]))[:k]
            out += [(q, key, round(d, 9), label, i) for i, (d, key, label) in enumerate(near, 1)]
    return sorted(out)


def rows(n, seed, spread=8, labels="abc"):
    rng = random.Random(seed)
    return [(i, rng.randrange(spread) * 1.5, rng.gauss(0, 2), rng.choice(labels)) for i in range(n)]


def found(spark, train, queries, k, **sizes):
    t = spark.createDataFrame(train, "id long, x double, y double, label string").repartition(3)
    q = spark.createDataFrame(queries, "id long, x double, y double").repartition(2)
    return neighbours.nearest(t, q, "id", ["x", "y"], "label", k, **sizes)


@pytest.mark.parametrize("pivots,block", [(1, 1000), (7, 10), (60, 1000)])
def test_neighbours_equal_brute_force(spark, pivots, block):
    train = rows(120, 1) + [(1000 + i, 3.0, 0.0, "hot") for i in range(60)] + [(2000, None, 1.0, "a"), (2001, float("nan"), 1.0, "a")]  # a third of all rows at one point
    queries = [(i, x, y) for i, x, y, _ in rows(40, 2)] + [(900, 3.0, 0.0), (901, 1e6, -1e6), (902, None, 0.0)]
    got = sorted((r["query"], r["key"], round(r["distance"], 9), r["label"], r["rank"]) for r in found(spark, train, queries, 5, pivots=pivots, block=block).collect())
    assert got == brute(train, queries, 5)


@pytest.mark.parametrize("leaf", [2, 9])
def test_boxes_equal_brute_force(spark, leaf):
    """Boxes that are left out hold no neighbour; ties at the same distance go to the smaller key."""
    train = rows(150, 5) + [(500 + i, float(i % 4), 1.0, "grid") for i in range(40)] + [(600, -0.0, 0.0, "zero"), (601, 0.0, -0.0, "zero")]
    queries = [(i, x, y) for i, x, y, _ in rows(50, 6)] + [(700 + i, float(i % 5), 1.0) for i in range(20)] + [(800, -0.0, -0.0), (801, 0.0, 0.0)]
    got = sorted((r["query"], r["key"], round(r["distance"], 9), r["label"], r["rank"]) for r in found(spark, train, queries, 6, pivots=3, leaf=leaf).collect())
    assert got == brute(train, queries, 6)


def test_copies_are_compared_once(spark, monkeypatch):
    """Of equal training rows k go on, and of equal queries one."""
    sent, real = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, label: sent.append((label, real(df, label))) or sent[-1][1])
    train = [(i, float(i % 3), 0.0, "ab"[i % 2]) for i in range(600)]
    queries = [(i, float(i % 4), 0.0) for i in range(400)]
    got = sorted((r["query"], r["key"], round(r["distance"], 9), r["label"], r["rank"]) for r in found(spark, train, queries, 5).collect())
    sizes = {label: df.count() for label, df in sent}
    assert got == brute(train, queries, 5) and sizes["training-rows"] == 15 and sizes["points"] == 4


def test_fewer_rows_than_neighbours_and_none(spark):
    train, queries = rows(3, 4), [(7, 0.0, 0.0)]
    assert sorted((r["key"], r["rank"]) for r in found(spark, train, queries, 5).collect()) == sorted((b[1], b[4]) for b in brute(train, queries, 5))
    assert found(spark, [], queries, 5).collect() == [] and found(spark, train, [], 5).collect() == []


def test_votes_and_means(spark):
    near = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3), (2, "b", 1), (2, "b", 2), (2, "a", 3)], "query long, label string, rank int")
    assert {r["query"]: r["prediction"] for r in neighbours.vote(near).collect()} == {1: "a", 2: "b"}
    number = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 2), (1, 6.0, 3)], "query long, label double, rank int")
    assert neighbours.average(number).first()["prediction"] == 3.0


def test_far_cells_are_not_reached(spark):
    """Queries meet a small share of the training rows when cells lie apart."""
    import numpy as np

    centres = np.array([[100.0 * i, 0.0] for i in range(10)])
    reach = neighbours._reach_of(centres, np.full(10, 50), np.full(10, 3.0), 5)
    import pandas as pd

    (out,) = reach(iter([pd.DataFrame({"key": [1], "x": [[201.0, 1.0]]})]))
    assert out["cells"].tolist() == [[2]]
