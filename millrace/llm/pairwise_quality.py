"""Bradley-Terry ranking of documents by quality.

Every document gets a vector of surface features. Preference pairs (a good one
over a bad one) fit a linear strength by logistic loss on feature differences;
the cutoff is a quantile of the strengths of the labelled sample.

Defined results: null text is scored as empty text; without pairs (no labels,
or one class only) every score is 0.5; labels with null ids or quality are
ignored; if a document has several labels the lowest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_FEATURES = 17


def features(text: str | None) -> list[float]:
    """Surface features of one whole text, in time linear in its length."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n_words, n_lines = len(words), len(lines)
    share = counts / max(n, 1)
    of = lambda chars: float(share[list(chars)].sum())
    some = share[share > 0]
    return [
        np.log1p(n),
        np.log1p(n_words),
        of(range(65, 91)),
        of(range(97, 123)),
        of(range(48, 58)),
        of(b"!?"),
        of(b"#*$%&"),
        of(b"|<>"),
        of(b".,;:"),
        of(b"()[]{}/\\=_+~^@\"'`-"),
        of(range(128, 256)),
        n / max(n_words, 1),
        len(set(words)) / max(n_words, 1),
        len(set(lines)) / max(n_lines, 1),
        n_words / max(n_lines, 1) / 100,
        float(-(some * np.log2(some)).sum()),
        float(n_words < 10),
    ]


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.asarray(rows, np.float64).reshape(-1)) if rows else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(flat, N_FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, x array<double>")


def preference_pairs(quality: np.ndarray, per_row: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of preferred and rejected rows: each row of the smaller class meets ``per_row`` of the other."""
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    rng = np.random.default_rng(seed)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    left, right = np.repeat(few, per_row), rng.choice(many, len(few) * per_row)
    return (right, left) if few is bad else (left, right)


def fit_strength(difference: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-difference @ w)) + l2 |w|^2 / 2, by Newton's method."""
    w = np.zeros(difference.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        gradient = -(p @ difference) / len(difference) + l2 * w
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: np.ndarray, quality: np.ndarray, per_row: int = 40, seed: int = 7) -> dict | None:
    """The model: scaling, weights and the cutoff.

    The cutoff is the quantile of the sample's strengths that separates the
    labels with the best balanced accuracy.
    """
    better, worse = preference_pairs(quality, per_row, seed)
    if not len(better):
        return None
    mean, scale = sample.mean(0), sample.std(0)
    scale[scale < 1e-9] = 1
    x = np.clip((sample - mean) / scale, -8, 8)
    w = fit_strength(x[better] - x[worse])
    strength = x @ w
    quantiles = np.linspace(0.005, 0.995, 199)
    cuts = np.quantile(strength, quantiles)
    balanced = [(strength[quality == 1] >= c).mean() + (strength[quality == 0] < c).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(balanced, max(balanced)))
    at = int(best[len(best) // 2])
    return {"mean": mean, "scale": scale, "w": w, "cut": float(cuts[at]), "quantile": float(quantiles[at])}


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    max_labels: int = 8000,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, strength, score, predicted) of each row of ``docs``.

    At most ``max_labels`` rows of ``labels`` (id_col, quality), those with the
    smallest hash of their id, take part in training. ``score`` is a logistic
    function of strength that is ``threshold`` at the cutoff.
    """
    wanted = (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
        .filter("label_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("label_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_labels)
    )
    # `wanted` has at most max_labels rows, which bounds this broadcast and what the driver collects.
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.join(F.broadcast(wanted), docs["doc_id"] == wanted["label_id"])
    labelled = (
        featurize(found.select(F.col("label_id").alias("doc_id"), F.col(text_col).alias("text")))
        .join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "quality", "x")
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .collect()
    )
    model = train(np.array([r["x"] for r in labelled]), np.array([r["quality"] for r in labelled])) if labelled else None
    offset = np.log(threshold / (1 - threshold))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                strength, score = np.zeros(batch.num_rows), np.full(batch.num_rows, 0.5)
            else:
                x = np.array([features(t.as_py()) for t in batch.column(1)])
                strength = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
                score = 1 / (1 + np.exp(-np.clip(strength - model["cut"] + offset, -30, 30)))
            predicted = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (strength, score, predicted))], ["doc_id", "strength", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, strength double, score double, predicted int")
