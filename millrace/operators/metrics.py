"""Model metrics as aggregates over (label, prediction, score) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.running import running_totals


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 6).alias("mean_y"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error, Brier score and log loss."""
    label = F.col(y).cast("double")
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    per = df.groupBy(b.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(label).alias("sy"), F.sum(F.pow(F.col(p) - label, 2)).alias("se"), F.sum(-(label * F.log(q) + (1 - label) * F.log(1 - q))).alias("sl")
    )
    n = F.sum("n")
    return per.agg(F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / n, 6).alias("ece"), F.round(F.sum("se") / n, 6).alias("brier"), F.round(F.sum("sl") / n, 6).alias("log_loss"))


def confusion(df: DataFrame, y: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class of a confusion table."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    a = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    p = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    j = a.join(p, "label", "full").na.fill(0)
    j = j.withColumns({"precision": F.coalesce(F.try_divide("hits", "predicted_n"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))})
    return j.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def classification_summary(cells: DataFrame) -> DataFrame:
    """Accuracy, and macro and weighted precision, recall and F1."""
    s = class_scores(cells)
    n = F.sum("support")
    aggs = [F.round(F.sum("hits") / n, 6).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs += [F.round(F.avg(m), 6).alias(f"macro_{m}"), F.round(F.sum(F.col(m) * F.col("support")) / n, 6).alias(f"weighted_{m}")]
    return s.agg(*aggs)


def confused_pairs(cells: DataFrame, k: int = 3) -> DataFrame:
    return cells.filter("actual <> predicted").orderBy(F.desc("n"), "actual", "predicted").limit(k)


def score_curve(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the top, with the positives ``p`` and negatives ``q`` at it.

    Equal scores are summed before the shuffle; the totals are added up range by range.
    """
    by = by or []
    per = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("q"))
    return running_totals(per, by, [F.desc("score")], {"tp": "p", "fp": "q"})


def ranking_scores(df: DataFrame, y: str, score: str, by: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """ROC AUC with ties, trapezoid PR AUC, and average precision; null without positives or negatives."""
    c = score_curve(df, y, score, by)
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("q")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    steps = c.select(*(by or []), "p", "q", (F.col("q") * (F.col("tp") + tp0) / 2.0).alias("roc"), (F.col("p") * (precision + before) / 2).alias("pr"), (F.col("p") * precision).alias("ap"))
    p, q = F.sum("p"), F.sum("q")
    named = {"roc_auc": F.try_divide(F.sum("roc"), p * q), "pr_auc": F.try_divide(F.sum("pr"), p), "average_precision": F.try_divide(F.sum("ap"), p)}
    return steps.groupBy(*(by or [])).agg(*[(v if digits is None else F.round(v, digits)).alias(k) for k, v in named.items()])


def one_vs_rest(df: DataFrame, y: str, scores: dict[str, str], digits: int | None = 6) -> DataFrame:
    """(class, n, roc_auc, pr_auc, average_precision) of each class against the others; ``scores`` names the column of each class."""
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("score"), (F.col(y).cast("string") == k).cast("long").alias("hit")) for k, c in scores.items()]))
    long = df.filter(F.col(y).isNotNull()).select(pairs)
    found = ranking_scores(long, "hit", "score", ["class"], digits)
    return found.join(long.groupBy("class").agg(F.sum("hit").alias("n")), "class").select("class", "n", "roc_auc", "pr_auc", "average_precision")


def macro_ranking_scores(df: DataFrame, y: str, scores: dict[str, str], digits: int | None = 6) -> DataFrame:
    """One row: the unweighted mean over classes of the one-vs-rest ROC AUC; null unless every class, and no other, occurs."""
    unknown = df.filter(F.col(y).isNotNull() & ~F.col(y).cast("string").isin(*scores)).select(F.lit(1).alias("x")).limit(1)
    per = one_vs_rest(df, y, scores, None)
    mean = per.agg(F.when(F.count("roc_auc") == len(scores), F.avg("roc_auc")).alias("_auc"), F.count(F.lit(1)).alias("classes"))
    value = F.when(F.col("_unknown") == 0, F.col("_auc"))
    out = mean.crossJoin(unknown.agg(F.count(F.lit(1)).alias("_unknown")))  # one row each
    return out.select((value if digits is None else F.round(value, digits)).alias("roc_auc_ovr"), "classes")


def regression_scores(df: DataFrame, y: str, prediction: str, by: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """MAE, MSE, RMSE, R2, MAPE and sMAPE, rounded unless ``digits`` is None; MAPE is null if an actual is about 0, R2 if it has no meaning."""
    a, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    e, size = a - p, F.abs(a) + F.abs(p)
    sst = F.var_pop(a) * F.count(a)
    mape = F.when(F.min(F.abs(a)) > 1e-9, 100 * F.avg(F.abs(F.try_divide(e, a))))
    r2 = F.when((F.count(a) >= 2) & (sst > 1e-9), 1 - F.try_divide(F.sum(e * e), sst))
    smape = 100 * F.avg(F.when(size > 1e-9, 2 * F.abs(e) / size).otherwise(0.0))
    named = {"mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "r2": r2, "mape": mape, "smape": smape}
    return df.groupBy(*(by or [])).agg(*[(v if digits is None else F.round(v, digits)).alias(k) for k, v in named.items()])


def threshold_grid(df: DataFrame, y: str, p: str, points: int = 81) -> DataFrame:
    """Macro F1 at ``points`` thresholds from 0.1 to 0.9.

    Rows are counted once per interval between thresholds; the grid then meets
    those few counts, not the rows.
    """
    step = 0.8 / (points - 1)
    slot = F.floor((F.col(p) - 0.1) / step + 1e-9).cast("long")
    counts = df.groupBy(F.greatest(F.lit(-1), F.least(slot, F.lit(points - 1))).alias("slot")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    grid = counts.sparkSession.range(points).select(F.col("id").alias("k"))
    at = F.col("slot") >= F.col("k")
    cells = grid.crossJoin(F.broadcast(counts)).groupBy("k").agg(  # `points` rows by at most points + 1 rows
        F.sum(F.when(at, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(at, F.col("n") - F.col("p")).otherwise(0)).alias("fp"), F.sum(F.when(~at, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(~at, F.col("n") - F.col("p")).otherwise(0)).alias("tn")
    )
    f1 = lambda t, a, b: F.coalesce(F.try_divide(2.0 * F.col(t), 2 * F.col(t) + F.col(a) + F.col(b)), F.lit(0.0))
    return cells.select(F.round(0.1 + F.col("k") * step, 4).alias("threshold"), F.round((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2, 6).alias("macro_f1"))


def best_threshold(grid: DataFrame, near: float = 0.5) -> DataFrame:
    """The threshold of the best macro F1; of equals the one nearest ``near``."""
    return grid.orderBy(F.desc("macro_f1"), F.abs(F.col("threshold") - near), "threshold").limit(1)


#: Cumulative chances of 0 to 6 occurrences of a Poisson variable of mean 1.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def _resampled(resamples: int, seed: int):
    """Task function: for each resample the weighted sum of differences and the sum of weights of the task's rows."""
    import numpy as np
    import pandas as pd

    salts = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)

    def mixed(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(frames):
        sums, weights = np.zeros(resamples), np.zeros(resamples, np.int64)
        for pdf in frames:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                chance = mixed(part["h"].to_numpy().view(np.uint64)[:, None] + salts) / 2.0**64
                w = np.searchsorted(POISSON, chance)
                sums += part["d"].to_numpy() @ w
                weights += w.sum(0)
        yield pd.DataFrame({"i": np.arange(resamples, dtype=np.int32), "s": sums, "w": weights})

    return run


def bootstrap_difference(df: DataFrame, y: str, p1: str, p2: str, key: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """95 % interval of the difference of Brier scores under Poisson resampling.

    A row's weight in a resample is drawn from the hash of its key, which tells rows apart, and the resample's number, so that the interval does not depend on partitions. No row is multiplied: a task sends
    one pair of sums per resample.
    """
    d = F.pow(F.col(p1) - F.col(y), 2) - F.pow(F.col(p2) - F.col(y), 2)
    rows = df.select(d.cast("double").alias("d"), F.xxhash64(key).alias("h")).filter("d IS NOT NULL")
    per = rows.mapInPandas(_resampled(resamples, seed), "i int, s double, w bigint").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    return per.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.975).alias("high"))  # one row per resample
