"""Scoring with exported models, validation, bands, calibration and policy."""

from __future__ import annotations

import json
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import sigmoid


def load_artifact(path: str, required: tuple[str, ...]) -> dict:
    """A JSON model, with the keys that a scorer needs checked."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    missing = [k for k in required if k not in model]
    if missing:
        raise ValueError(f"the model lacks {', '.join(missing)}")
    return model


def check_tree(tree: dict) -> None:
    """Raise unless child, feature and threshold arrays describe one tree."""
    n = len(tree["left"])
    if any(len(tree[k]) != n for k in ("right", "feature", "threshold", "value")):
        raise ValueError("tree arrays differ in length")
    seen, todo = set(), [0]
    while todo:
        i = todo.pop()
        if not 0 <= i < n or i in seen:
            raise ValueError("tree nodes must form one tree")
        seen.add(i)
        if tree["left"][i] >= 0:
            todo += [tree["left"][i], tree["right"][i]]
    if len(seen) != n:
        raise ValueError("tree has unreachable nodes")


def logistic(model: dict, columns: dict[str, Column] | None = None) -> tuple[Column, dict[str, Column]]:
    """(probability, contribution of each feature) of a logistic model; missing features take their median.

    model: intercept, and for each feature coefficient, mean, scale, median.
    """
    parts, z = {}, F.lit(float(model["intercept"]))
    for name, f in model["features"].items():
        c = (columns or {}).get(name, F.col(name)).cast("double")
        parts[name] = (F.coalesce(c, F.lit(float(f["median"]))) - float(f["mean"])) / float(f["scale"]) * float(f["coefficient"])
        z = z + parts[name]
    return sigmoid(z), parts


def tree_value(tree: dict, features: list[Column], node: int = 0) -> Column:
    """The leaf value of one exported tree as nested conditions; splits compare as 32-bit floats do."""
    if tree["left"][node] < 0:
        return F.lit(float(tree["value"][node]))
    low = features[tree["feature"][node]].cast("float") <= F.lit(float(tree["threshold"][node])).cast("float")
    return F.when(low, tree_value(tree, features, tree["left"][node])).otherwise(tree_value(tree, features, tree["right"][node]))


def boosted(model: dict, columns: list[Column]) -> Column:
    """Probability of a gradient-boosted model: features log-scaled and standardised, then the sum of its trees."""
    scaled = []
    for c, f in zip(columns, model["features"]):
        x = F.log1p(c.cast("double")) if f.get("log") else c.cast("double")
        scaled.append((x - float(f["mean"])) / float(f["scale"]))
    score = F.lit(float(model["init"]))
    for tree in model["trees"]:
        check_tree(tree)
        score = score + float(model["learning_rate"]) * tree_value(tree, scaled)
    a, b = model.get("calibration", (1.0, 0.0))
    return sigmoid(float(a) * score + float(b))


def tree_contributions(tree: dict, features: list[Column], names: list[str], node: int = 0) -> dict[str, Column]:
    """What each feature's splits add to the value on the way to a row's leaf."""
    if tree["left"][node] < 0:
        return {n: F.lit(0.0) for n in names}
    here, who = float(tree["value"][node]), names[tree["feature"][node]]
    low = features[tree["feature"][node]].cast("float") <= F.lit(float(tree["threshold"][node])).cast("float")
    sides = []
    for child in (tree["left"][node], tree["right"][node]):
        below = tree_contributions(tree, features, names, child)
        below[who] = below[who] + (float(tree["value"][child]) - here)
        sides.append(below)
    return {n: F.when(low, sides[0][n]).otherwise(sides[1][n]) for n in names}


def input_reason() -> Column:
    """The first cross-field rule that a customer row breaks; null if none."""
    c = F.col
    rules = [
        ("negative_value", (c("recency_days") < 0) | (c("tenure_days") < 0) | (c("orders_90d") < 0) | (c("monetary_90d") < 0) | (c("products_90d") < 0)),
        ("recency_exceeds_tenure", c("recency_days") > c("tenure_days")),
        ("active_without_recent_order", (c("recency_days") > 90) & (c("orders_90d") > 0)),
        ("recent_without_order", (c("recency_days") <= 90) & (c("orders_90d") == 0)),
        ("zeros_disagree", ((c("orders_90d") == 0) != (c("monetary_90d") == 0)) | ((c("orders_90d") == 0) != (c("products_90d") == 0))),
    ]
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(out)
    return out


def range_warnings(ranges: dict[str, tuple[float, float]], categories: dict[str, list[str]]) -> Column:
    """Texts for values outside the training ranges and for unknown categories."""
    texts = [F.when((F.col(k) < lo) | (F.col(k) > hi), f"{k} is outside the training range") for k, (lo, hi) in ranges.items()]
    texts += [F.when(~F.col(k).isin(v), f"{k} is unknown") for k, v in categories.items()]
    return F.array_compact(F.array(*texts))


def band(p: Column, low: float = 1 / 3, high: float = 2 / 3) -> Column:
    return F.when(p < low, "LOW").when(p < high, "MEDIUM").otherwise("HIGH")


def score_summary(df: DataFrame, p: str, threshold: float = 0.5) -> DataFrame:
    """Counts, shares and mean probability of scored rows, and rows by band."""
    ok = F.col(p).isNotNull()
    n, back = F.count_if(ok), F.count_if(F.col(p) >= threshold)
    bands = [F.count_if(ok & (band(F.col(p)) == b)).alias(f"band_{b.lower()}") for b in ("HIGH", "MEDIUM", "LOW")]
    return df.agg(F.count(F.lit(1)).alias("total"), n.alias("eligible"), (F.count(F.lit(1)) - n).alias("insufficient"), back.alias("returning"), (n - back).alias("not_returning"), F.round(F.coalesce(F.try_divide(back, n), F.lit(0.0)), 6).alias("return_ratio"), F.round(F.avg(p), 6).alias("average_probability"), *bands)


def action_plan(summary: Column, low_rating: Column, old: Column, infrequent: Column, eligible: Column) -> tuple[Column, Column]:
    """(mode, priority) from the share of returning customers and the commonest weakness."""
    mode = F.when(eligible == 0, "empty").when(summary < 0.45, "retention").when(summary > 0.55, "growth").otherwise("balanced")
    priority = F.when(low_rating >= 0.25, "experience").when(old > eligible / 2, "reactivation").when(infrequent > eligible / 2, "loyalty")
    return mode, priority


def calibrate_sigmoid(df: DataFrame, margin: str, y: str) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve of y over a margin."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[margin], outputCol="_x").transform(df.filter(F.col(margin).isNotNull() & F.col(y).isNotNull()).select(margin, F.col(y).cast("double").alias("_y")))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y").fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)


def calibrate_isotonic(df: DataFrame, score: str, y: str):
    """A fitted isotonic model of y over a score."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=score, labelCol="_y").fit(df.select(score, F.col(y).cast("double").alias("_y")))


def calibrate_beta(df: DataFrame, p: str, y: str) -> dict:
    """Beta calibration: a logistic model of y over log p and -log(1 - p)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.select(F.log(q).alias("_a"), (-F.log(1 - q)).alias("_b"), F.col(y).cast("double").alias("_y"))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y").fit(VectorAssembler(inputCols=["_a", "_b"], outputCol="_x").transform(rows))
    return {"a": float(fit.coefficients[0]), "b": float(fit.coefficients[1]), "c": float(fit.intercept)}


def shapley(names: list[str], value) -> dict[str, Column]:
    """Exact Shapley values over groups of features; ``value(subset)`` is the score with only those present."""
    n = len(names)
    score = {s: value(frozenset(s)) for k in range(n + 1) for s in combinations(names, k)}
    out = {}
    for name in names:
        rest = [x for x in names if x != name]
        total = F.lit(0.0)
        for k in range(n):
            weight = factorial(k) * factorial(n - k - 1) / factorial(n)
            for s in combinations(rest, k):
                total = total + weight * (score[tuple(x for x in names if x in (*s, name))] - score[s])
        out[name] = total
    return out


def area_effect(area: Column, change: float, median_per_m2: Column) -> tuple[Column, Column]:
    """Estimate for the area, and its change if the area changes."""
    return area * median_per_m2, change * median_per_m2


def choose_model(records: list[dict], gates: dict[str, float]) -> dict | None:
    """The best candidate that passes every gate: ROC AUC and macro F1 from below, ECE from above."""
    fine = [r for r in records if r["roc_auc"] >= gates["roc_auc"] and r["macro_f1"] >= gates["macro_f1"] and r["ece"] <= gates["ece"]]
    return max(fine, key=lambda r: (r["macro_f1"], r["roc_auc"], -r["ece"]), default=None)
