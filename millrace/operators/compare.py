"""Model comparison on pyspark.ml: evaluation plan, train-only preprocessing, fit, rank, diagnose."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import kernels, neighbours, quantiles, running
from millrace.operators.metrics import classification_summary, confusion, regression_scores
from millrace.operators.sampling import folds, stratified_split
from millrace.storage import written


def evaluation_plan(n: int, class_counts: dict | None) -> dict:
    """Holdout with cross-validation, cross-validation alone, or none, by what rows and classes allow."""
    tier = "normal" if n >= 100 else "small" if n >= 30 else "tiny" if n >= 10 else "extreme_tiny"
    least = min(class_counts.values()) if class_counts else None
    holdout = n >= 30 and (class_counts is None or (least >= 3 and -(-n // 4) >= len(class_counts) and n * 3 // 4 >= len(class_counts)))
    train = n - -(-n // 4) if holdout else n
    k = min(5 if n >= 100 else 3, train)
    if class_counts is not None:
        k = min(k, max(0, least - (-(-least // 4) if holdout else 0)))
    else:
        k = min(k, max(2, train // 2)) if train >= 4 else 0
    if k < 2:
        return {"tier": tier, "mode": "exploratory", "folds": 0, "has_holdout": False}
    return {"tier": tier, "mode": "holdout_cv" if holdout else "cv_only", "folds": k, "has_holdout": holdout}


#: An evaluation in time order holds out the last quarter, if 10 rows stay before it and 2 lie in it.
TIME_SHARE, TIME_ROWS = 0.75, (10, 2)


def temporal_plan(df: DataFrame, time: str, target: str | None = None) -> dict:
    """The plan of an evaluation in time order: a holdout of the last rows and folds that grow forward.

    Rows of one time are never parted. The holdout begins at the last time that
    leaves at most three quarters of the rows before it. The times before it are
    cut into folds + 1 blocks, the first taking the remainder: each block but the
    first is judged by what precedes it. With ``target`` (classes), a holdout
    needs two rows of each class before it and no new class, and a fold needs two
    classes before it and no new one; other folds are left out. ``cut`` and the
    (begin, end) of each of the ``splits`` are times, so rows are dealt by
    comparison, without a join. A row without a time raises.
    """
    classes = F.col(target).cast("string") if target else F.lit("")
    counted = written(df.groupBy(F.col(time).alias("t"), classes.alias("y")).agg(F.count(F.lit(1)).alias("n")), "times")
    n, missing = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("t").isNull())).first()
    if missing:
        raise ValueError("an evaluation in time order needs a time in every row")
    tier = evaluation_plan(n, None)["tier"]
    nothing = {"tier": tier, "mode": "exploratory", "folds": 0, "has_holdout": False, "cut": None, "splits": []}
    if not n:
        return nothing
    times = counted.groupBy("t").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1).cast("long"))
    placed = written(running.running_totals(times, [], [F.col("t")], {"upto": "n", "place": "one"}), "places")
    before = placed.filter(F.col("upto") <= int(n * TIME_SHARE)).agg(F.max("upto"), F.max("place")).first()
    groups, cut = placed.count(), None
    if n >= 30 and (before[0] or 0) >= TIME_ROWS[0] and n - before[0] >= TIME_ROWS[1]:
        first = placed.filter(F.col("place") == before[1] + 1).first()["t"]
        if target is None or _classes_known(counted, [(F.col("t") < first, F.col("t") >= first, 2, 1)])[0]:
            cut, groups = first, before[1]
    k = min(5 if n >= 100 else 3, groups - 1)
    if k < 2:
        return nothing
    size = groups // (k + 1)
    starts = [groups - (k - i) * size for i in range(k)]  # times before each block
    found = {r["place"]: r["t"] for r in placed.filter(F.col("place").isin([p + 1 for p in (*starts, groups)])).collect()}  # k + 1 rows at most
    blocks = [(found[p + 1], found.get(p + size + 1)) for p in starts]
    if target is not None:
        inside = lambda a, b: (F.col("t") >= a) & ((F.col("t") < b) if b is not None else F.lit(True))
        fine = _classes_known(counted, [(F.col("t") < a, inside(a, b), 1, 2) for a, b in blocks])
        blocks = [b for b, ok in zip(blocks, fine) if ok]
    if len(blocks) < 2:
        return nothing
    return {"tier": tier, "mode": "holdout_cv" if cut is not None else "cv_only", "folds": len(blocks), "has_holdout": cut is not None, "cut": cut, "splits": blocks}


def _classes_known(counted: DataFrame, parts: list[tuple]) -> list[bool]:
    """For each (before, judged, rows, classes): at least ``rows`` of each class and ``classes`` classes before, and none first met among the judged."""
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    of_class = counted.filter("y IS NOT NULL").groupBy("y").agg(*[x for i, (a, b, _, _) in enumerate(parts) for x in (rows(a).alias(f"a{i}"), rows(b).alias(f"b{i}"))])
    fine = []
    for i, (_, _, least, classes) in enumerate(parts):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        fine.append(((F.count_if(a > 0) >= classes) & (F.count_if((a > 0) & (a < least)) == 0) & (F.count_if((a == 0) & (b > 0)) == 0)).alias(f"ok{i}"))
    return list(of_class.agg(*fine).first())


def deal_by_time(df: DataFrame, time: str, plan: dict) -> DataFrame:
    """``df`` with ``is_test`` and ``fold``: the block that judges a row, -1 before the first and where a block was left out."""
    t, fold = F.col(time), F.lit(-1)
    for i, (a, b) in enumerate(plan["splits"]):
        fold = F.when((t >= a) & ((t < b) if b is not None else F.lit(True)), i).otherwise(fold)
    test = (t >= plan["cut"]) if plan["has_holdout"] else F.lit(False)
    return df.withColumns({"is_test": test, "fold": fold})


def temporal_parts(df: DataFrame, time: str, plan: dict) -> DataFrame:
    """(part, n_train, n_rows, begins, ends): what each fold and the holdout learn from and judge, in one pass."""
    t = F.col(time)
    parts = [(f"fold {i}", a, b) for i, (a, b) in enumerate(plan["splits"])] + ([("holdout", plan["cut"], None)] if plan["has_holdout"] else [])
    if not parts:
        return df.sparkSession.createDataFrame([], "part string, n_train bigint, n_rows bigint, begins timestamp, ends timestamp")
    structs = []
    for name, a, b in parts:
        inside = (t >= a) & ((t < b) if b is not None else F.lit(True))
        structs.append(F.struct(F.lit(name).alias("part"), F.count_if(t < a).alias("n_train"), F.count_if(inside).alias("n_rows"), F.min(F.when(inside, t)).alias("begins"), F.max(F.when(inside, t)).alias("ends")))
    return df.agg(F.array(*structs).alias("parts")).select(F.inline("parts"))


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str], most: int = 32, least_count: int = 2) -> dict:
    """Medians, means and population deviations, and the commonest categories, of the training rows alone."""
    medians = quantiles.medians(train, {c: F.col(c) for c in numeric})
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c] if medians[c] is not None else 0.0)) for c in numeric}
    stats = train.agg(*[x for c in numeric for x in (F.avg(filled[c]).alias(f"{c}_m"), F.stddev_pop(filled[c]).alias(f"{c}_s"))]).first().asDict() if numeric else {}
    levels = {}
    for c in categorical:  # at most `most` categories each
        rows = train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count).orderBy(F.desc("n"), c).limit(most).collect()
        levels[c] = [r[c] for r in rows]
    return {"medians": medians, "stats": stats, "levels": levels, "numeric": numeric, "categorical": categorical}


def encoded_width(model: dict) -> int:
    return len(model["numeric"]) + sum(map(len, model["levels"].values()))


def transform(df: DataFrame, model: dict, target: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """features and label; unknown categories have no indicator set."""
    from pyspark.ml.feature import VectorAssembler

    columns = {}
    for c in model["numeric"]:
        scale = model["stats"][f"{c}_s"] or 1.0
        columns[f"x_{c}"] = (F.coalesce(F.col(c).cast("double"), F.lit(model["medians"][c] if model["medians"][c] is not None else 0.0)) - F.lit(model["stats"][f"{c}_m"] or 0.0)) / F.lit(scale)
    for c, levels in model["levels"].items():
        common = F.coalesce(F.col(c), F.lit(levels[0] if levels else None).cast("string"))
        columns |= {f"x_{c}_{i}": F.coalesce((common == v).cast("double"), F.lit(0.0)) for i, v in enumerate(levels)}
    rows = df.select(*extra, F.col(target).cast("double").alias("label"), *[v.alias(k) for k, v in columns.items()])
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows).select(*extra, "label", "features")


class Neighbours:
    """Estimator over (row_key, label, features): the vote or the mean of the k nearest training rows, exactly."""

    def __init__(self, task: str, k: int = 5):
        self.task, self.k = task, k

    def fit(self, rows: DataFrame) -> Neighbours:
        out = Neighbours(self.task, self.k)
        out.rows = rows
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        width = self.rows.select(F.size(vector_to_array("features"))).first()[0]
        flat = lambda df, *more: df.select("row_key", *more, *[vector_to_array("features")[i].alias(f"x{i}") for i in range(width)])
        say = neighbours.vote if self.task == "classification" else neighbours.average
        said = neighbours.predicted(flat(self.rows, "label"), flat(rows), "row_key", [f"x{i}" for i in range(width)], "label", say, self.k)
        return rows.join(said.withColumnRenamed("query", "row_key"), "row_key")


def estimators(task: str) -> dict:
    """Models by name, with the sizes of the product; classes are balanced by the ``weight`` column where it balances them."""
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    if task == "classification":
        return {
            "Logistic Regression": c.LogisticRegression(maxIter=600, weightCol="weight"),
            "K-Nearest Neighbors": Neighbours(task),
            "Support Vector Machine": kernels.KernelMachine(task),
            "Decision Tree": c.DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=2, weightCol="weight", seed=42),
            "Random Forest": c.RandomForestClassifier(numTrees=60, maxDepth=12, minInstancesPerNode=2, weightCol="weight", seed=42),
            "Gaussian Naive Bayes": c.NaiveBayes(modelType="gaussian"),
            "Gradient Boosting": c.GBTClassifier(maxIter=60, maxDepth=2, seed=42),
            "Linear SVC": c.LinearSVC(),
        }
    return {
        "Linear Regression": r.LinearRegression(), "Ridge": r.LinearRegression(regParam=1.0, elasticNetParam=0.0), "Lasso": r.LinearRegression(regParam=0.01, elasticNetParam=1.0, maxIter=2000),
        "KNN Regressor": Neighbours(task), "SVR": kernels.KernelMachine(task), "Decision Tree": r.DecisionTreeRegressor(maxDepth=8, minInstancesPerNode=2, seed=42),
        "Random Forest": r.RandomForestRegressor(numTrees=60, maxDepth=12, minInstancesPerNode=2, seed=42), "Gradient Boosting": r.GBTRegressor(maxIter=60, maxDepth=2, seed=42),
    }


def _score(model, rows: DataFrame, task: str) -> float:
    p = model.transform(rows)
    if task == "classification":
        return classification_summary(confusion(p, "label", "prediction")).first()["macro_f1"]
    return -regression_scores(p, "label", "prediction").first()["rmse"]


def compare_models(df: DataFrame, target: str, numeric: list[str], categorical: list[str], key: str, task: str = "classification", names: list[str] | None = None, budget_s: float | None = None, most_features: int = 500, most_cells: int | None = None, time_column: str | None = None) -> list[dict]:
    """Cross-validated score of each model, ranked before the holdout is looked at, and the gap that hints at overfitting.

    More than ``most_features`` encoded columns, or ``most_cells`` numbers in all, raise.
    With ``time_column`` the holdout is the last quarter, and each fold is judged by the rows before it.
    """
    usable = df.filter(F.col(target).isNotNull())
    counts = {r[target]: r["n"] for r in usable.groupBy(target).agg(F.count(F.lit(1)).alias("n")).limit(31).collect()} if task == "classification" else None
    if time_column is not None:
        plan = temporal_plan(usable, time_column, target if counts else None)
        split = deal_by_time(usable, time_column, plan)
        train = split.filter("NOT is_test").withColumn("earlier", F.array(*[F.col(time_column) < a for a, _ in plan["splits"]]))
    else:
        plan = evaluation_plan(usable.count(), counts)
        split = stratified_split(usable, target, F.col(key)) if plan["has_holdout"] and task == "classification" else usable.withColumn("is_test", (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(4)) == 0) & F.lit(plan["has_holdout"]))
        train = folds(split.filter("NOT is_test"), F.col(key), max(plan["folds"], 2), target if task == "classification" else None)
    prep = fit_preprocessor(train, numeric, categorical)
    balance = F.lit(1.0)
    if counts:  # at most 31 classes: all of them alike in weight
        for value, n in counts.items():
            balance = F.when(F.col(target) == value, sum(counts.values()) / (len(counts) * n)).otherwise(balance)
    width = encoded_width(prep)
    if width > most_features or most_cells is not None and width * sum(counts.values() if counts else [usable.count()]) > most_cells:
        raise ValueError(f"{width} encoded features: more than the comparison allows")
    weigh = lambda df: df.withColumns({"row_key": F.col(key), "weight": balance})
    rows, out, began = transform(weigh(train), prep, target, ("fold", "row_key", "weight", *(["earlier"] if time_column is not None else []))).cache(), [], time.monotonic()
    test = transform(weigh(split.filter("is_test")), prep, target, ("row_key", "weight")).cache()
    for name, estimator in estimators(task).items():
        if names and name not in names:
            continue
        if budget_s is not None and time.monotonic() - began > budget_s:
            out.append({"model": name, "status": "SKIPPED_TIME_BUDGET"})
            continue
        if counts and len(counts) > 2 and name in ("Gradient Boosting", "Linear SVC"):
            from pyspark.ml.classification import OneVsRest

            estimator = OneVsRest(classifier=estimator)
        scores = []
        for k in range(plan["folds"]):
            known = F.col("earlier")[k] if time_column is not None else F.col("fold") != k
            scores.append(_score(estimator.fit(rows.filter(known)), rows.filter(F.col("fold") == k), task))
        final = estimator.fit(rows)
        fitted = _score(final, rows, task)
        mean = sum(scores) / len(scores) if scores else None
        out.append({"model": name, "status": "SUCCESS", "cv_score": mean, "train_score": fitted, "_fit": final, "gap": None if mean is None else fitted - mean})
    ranked = sorted((r for r in out if r["status"] == "SUCCESS"), key=lambda r: (-(r["cv_score"] if r["cv_score"] is not None else r["train_score"]), r["model"]))
    for i, r in enumerate(ranked, 1):
        fit = r.pop("_fit")
        r |= {"rank": i, "test_score": _score(fit, test, task) if plan["has_holdout"] else None, "overfit": "none" if r["gap"] is None else "high" if r["gap"] > 0.15 else "medium" if r["gap"] > 0.05 else "low"}
        weights = getattr(fit, "featureImportances", None)
        if weights is None:
            weights = getattr(fit, "coefficients", None) if not counts or len(counts) == 2 else None
        if weights is not None:
            names_ = [*prep["numeric"], *[f"{c}={v}" for c, vs in prep["levels"].items() for v in vs]]
            r["importances"] = sorted(((n, abs(float(w))) for n, w in zip(names_, weights.toArray())), key=lambda x: -x[1])[:15]
    rows.unpersist()
    test.unpersist()
    return ranked + [r for r in out if r["status"] != "SUCCESS"]


def beats_majority(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """Macro F1 of the predictions and of always naming the commonest class."""
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    base = n.agg(F.round(F.try_divide(2.0 * F.max("n"), F.max("n") + F.sum("n")) / F.count(F.lit(1)), 6).alias("majority_f1"))
    return classification_summary(confusion(df, y, prediction)).select(F.col("macro_f1").alias("model_f1")).crossJoin(F.broadcast(base)).withColumn("better", F.col("model_f1") > F.col("majority_f1"))  # one row


def nearest_neighbours(train: DataFrame, queries: DataFrame, key: str, columns: list[str], label: str, k: int = 5) -> DataFrame:
    """(key, label): the majority label of the k nearest training rows; ties go to the smaller label.

    Both sides are distributed and neither is bounded; training rows are told apart by ``key`` if
    they have it, else by their columns and label.
    """
    own = train.select(*columns, F.col(label).cast("string").alias("label")).withColumn(key, F.monotonically_increasing_id())
    source = train.select(key, *columns, F.col(label).cast("string").alias("label")) if key in train.columns else written(own, "training-rows")
    said = neighbours.predicted(source, queries.select(key, *columns), key, columns, "label", neighbours.vote, k)
    return said.select(F.col("query").alias(key), F.col("prediction").alias("label"))
