"""Exact k nearest neighbours with rows on both sides distributed.

Queries with equal numbers have the same neighbours and are answered once; of training
rows with equal numbers only the k of smallest key can be neighbours, so no others are
compared. Copies therefore cost a grouping and a join. Training rows go to the cell of the nearest of some pivots; a cell is known by its
number of rows and its radius. For a query, the cells in order of (distance to the
pivot + radius) hold k rows by a certain distance, which bounds the k-th neighbour;
by the triangle inequality only cells whose pivot is within that bound plus their
radius can hold a neighbour, and the query is dealt to those alone. Cells with many
training rows or queries are cut into blocks, so that no task holds more than
``block`` rows of either side, whatever the data. Inside a block both sides are halved
into boxes of up to ``LEAF`` rows, and a box of queries meets those boxes alone that can
hold a neighbour. Each block gives its k nearest rows of each of its queries, and the k
nearest of those are the answer.

Distances are Euclidean; equal ones go to the smaller key. Rows with a null or a
number that is not finite in any column are left out on both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import written

#: At most so many pivots, one of about so many different rows; rows of either side in a block.
PIVOTS, PER_PIVOT, BLOCK, LEAF = 256, 64, 4096, 64
#: Numbers that one block of differences may hold.
ROOM = 1 << 22


def _usable(df: DataFrame, key: str, columns: list[str], more: list) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])  # -0.0 becomes 0.0
    rows = df.select(F.col(key).alias("key"), x.alias("x"), *more)
    return rows.filter(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    step = max(1, ROOM // max(1, pivots.size))
    return np.concatenate([np.sqrt(((x[i : i + step, None] - pivots[None]) ** 2).sum(2)) for i in range(0, len(x), step)]) if len(x) else np.zeros((0, len(pivots)))


def _matrix(column, width: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), width)


def _cells_of(pivots: np.ndarray):
    def run(frames):
        for pdf in frames:
            d = _to_pivots(_matrix(pdf["x"], pivots.shape[1]), pivots)
            yield pdf.assign(cell=d.argmin(1).astype(np.int32), far=d.min(1)) if len(pdf) else pdf.assign(cell=np.int32(0), far=0.0)

    return run


def _reach_of(pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int):
    """For each query the cells that can hold one of its k neighbours."""

    def run(frames):
        for pdf in frames:
            d = _to_pivots(_matrix(pdf["x"], pivots.shape[1]), pivots)
            reach = d + radii
            bound = reach.min(1) if len(pdf) else np.zeros(0)
            more = np.flatnonzero(sizes[reach.argmin(1)] < k) if len(pdf) else np.zeros(0, int)  # the first cell is not enough
            order = np.argsort(reach[more], axis=1)
            enough = (np.cumsum(sizes[order], axis=1) >= k).argmax(1) if len(more) else np.zeros(0, int)
            bound[more] = np.take_along_axis(reach[more], order, 1)[np.arange(len(more)), enough] if sizes.sum() >= k else math.inf
            near = d - radii <= (bound * (1 + 1e-9) + 1e-9)[:, None]
            yield pdf.assign(cells=[np.flatnonzero(r & (sizes > 0)).astype(np.int32).tolist() for r in near])

    return run


def _leaves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The rows of ``x`` in boxes of up to ``leaf`` rows, or of equal ones: halved along the widest side."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        wide = x[at].max(0) - x[at].min(0)
        if len(at) <= leaf or not wide.any():
            out.append(at)
        else:
            half = len(at) // 2
            at = at[np.argpartition(x[at, wide.argmax()], half)]
            todo += [at[:half], at[half:]]
    return out


def _first(d: np.ndarray, k: int) -> np.ndarray:
    """The k columns of least number in each row, in order; of equal ones the first."""
    rows, at = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    at = at[np.lexsort((at, d[rows, at], rows))]
    starts = np.searchsorted(rows, np.arange(len(d)))
    return at[starts[:, None] + np.arange(k)]


def _nearest_in_block(k: int, width: int, leaf: int):
    def run(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(train):
            return pd.DataFrame({"query": queries["key"][:0], "key": train["key"][:0], "distance": np.zeros(0), "label": train["label"][:0]})
        train = train.sort_values("key", kind="stable")
        x, points = _matrix(queries["x"], width), _matrix(train["x"], width)
        n = min(k, len(points))
        boxes = _leaves(points, leaf)
        low, high, sizes = np.array([points[b].min(0) for b in boxes]), np.array([points[b].max(0) for b in boxes]), np.array([len(b) for b in boxes])
        near = np.zeros((len(x), n), int)
        for some in _leaves(x, leaf):
            a, b = x[some].min(0), x[some].max(0)
            least = (np.maximum(0, np.maximum(low - b, a - high)) ** 2).sum(1)
            most = (np.maximum(high - a, b - low) ** 2).sum(1)
            order = np.argsort(most)
            bound = most[order[np.searchsorted(np.cumsum(sizes[order]), n)]]  # n rows are at least so near
            met = np.sort(np.concatenate([boxes[i] for i in np.flatnonzero(least <= bound * (1 + 1e-9))]))  # in the order of keys
            step = max(1, ROOM // (len(met) * width))
            for i in range(0, len(some), step):
                q = some[i : i + step]
                near[q] = met[_first(((x[q, None] - points[None, met]) ** 2).sum(2), n)]
        at = near.ravel()
        gap = ((np.repeat(x, n, axis=0) - points[at]) ** 2).sum(1)
        return pd.DataFrame({"query": np.repeat(queries["key"].to_numpy(), n), "key": train["key"].to_numpy()[at], "distance": gap, "label": train["label"].to_numpy()[at]})

    return run


def _nearest(train: DataFrame, points: DataFrame, key: str, columns: list[str], label: str, k: int, pivots: int, block: int, leaf: int) -> DataFrame:
    """(query, key, distance, label, rank) of the points (key, x), whose keys are longs."""
    types = dict(train.dtypes)
    same = Window.partitionBy("x").orderBy("key")
    train_rows = _usable(train, key, columns, [F.col(label).alias("label")])
    train_rows = written(train_rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k).drop("copy"), "training-rows")
    spare = F.pmod(F.xxhash64("x", F.lit(7)), F.lit(PER_PIVOT)) != 0
    picked = train_rows.select("x", F.xxhash64("x").alias("h"), spare.alias("spare")).distinct().orderBy("spare", "h", "x").limit(pivots).collect()
    picked = [r for i, r in enumerate(picked) if not r["spare"] or not i]
    schema = f"query long, key {types[key]}, distance double, label {types[label]}"
    if not picked:
        return train.sparkSession.createDataFrame([], schema + ", rank int")
    at = np.array([r["x"] for r in picked], float).reshape(len(picked), len(columns))
    row = f"key {types[key]}, x array<double>, label {types[label]}"
    cells = written(train_rows.mapInPandas(_cells_of(at), row + ", cell int, far double"), "cells")
    sizes, radii = np.zeros(len(at), np.int64), np.zeros(len(at))
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():  # one row per pivot
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    dealt = written(points.mapInPandas(_reach_of(at, sizes, radii, k), "key long, x array<double>, cells array<int>").select("key", "x", F.explode("cells").alias("cell")), "reached")
    asked = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = lambda n: max(1, -(-int(n) // block))
    plan = [(int(c), parts(sizes[c]), parts(asked[c])) for c in sorted(asked)]
    cuts = F.broadcast(train.sparkSession.createDataFrame(plan or [], "cell int, train_parts int, query_parts int"))  # one row per pivot
    part = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    t = cells.join(cuts, "cell").select("key", "x", "label", "cell", part("train_parts", 1).alias("a"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("b"))
    q = dealt.join(cuts, "cell").select("key", "x", "cell", F.explode(F.sequence(F.lit(0), F.col("train_parts") - 1)).alias("a"), part("query_parts", 2).alias("b"))
    found = q.groupBy("cell", "a", "b").cogroup(t.groupBy("cell", "a", "b")).applyInPandas(_nearest_in_block(k, len(columns), leaf), schema)
    order = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _points(rows: DataFrame) -> DataFrame:
    """(key, x): the different places of the rows (query, x), numbered."""
    return written(rows.select("x").distinct().select(F.monotonically_increasing_id().alias("key"), "x"), "points")


def _of_queries(rows: DataFrame, points: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers (query: the number of a point, and more) of the rows (query, x)."""
    placed = answers.withColumnRenamed("query", "point").join(points.withColumnRenamed("key", "point"), "point").drop("point")
    return rows.join(placed, "x").drop("x")


def nearest(train: DataFrame, queries: DataFrame, key: str, columns: list[str], label: str, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(query, key, distance, label, rank): the k nearest training rows of each query; ``distance`` is squared.

    Keys tell rows apart on either side; queries of fewer than k training rows get all of them.
    """
    rows = _usable(queries, key, columns, []).withColumnRenamed("key", "query")
    points = _points(rows)
    return _of_queries(rows, points, _nearest(train, points, key, columns, label, k, pivots, block, leaf))


def predicted(train: DataFrame, queries: DataFrame, key: str, columns: list[str], label: str, say, k: int = 5) -> DataFrame:
    """(query, prediction): what ``say`` (``vote`` or ``average``) makes of the k nearest training rows, once for queries at the same place."""
    rows = _usable(queries, key, columns, []).withColumnRenamed("key", "query")
    points = _points(rows)
    return _of_queries(rows, points, say(_nearest(train, points, key, columns, label, k, PIVOTS, BLOCK, LEAF)))


def vote(found: DataFrame) -> DataFrame:
    """(query, prediction): the commonest label; of equally common ones the smaller."""
    counts = found.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("query").orderBy(F.desc("n"), "label")  # at most k rows
    return counts.withColumn("r", F.row_number().over(order)).filter("r = 1").select("query", F.col("label").alias("prediction"))


def average(found: DataFrame) -> DataFrame:
    """(query, prediction): the mean label, added up in the order of rank."""
    labels = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("label").cast("double").alias("v")))), lambda s: s["v"])
    return found.groupBy("query").agg(labels.alias("v")).select("query", (F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v")).alias("prediction"))
