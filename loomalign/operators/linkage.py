"""Pair classification: features of encoded pairs, a weighted logistic model, losses on given vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.functions.similarity import cosine
from loomalign.operators.evaluate import pair_confusion, select_threshold, threshold_counts


def pair_features(pairs: DataFrame, vectors: DataFrame, head: str = "full") -> DataFrame:
    """pairs (pair_id, l, r, label) with features: paired_only has cosine and product terms, full adds |e1 - e2|."""
    if head not in ("full", "paired_only"):
        raise ValueError(f"unknown head: {head}")
    side = lambda n: vectors.select(F.col("id").alias(n), F.col("embedding").cast("array<double>").alias(f"e{n}"))
    j = pairs.join(side("l"), "l").join(side("r"), "r")
    product = F.zip_with("el", "er", lambda a, b: a * b)
    parts = [F.array(F.coalesce(cosine(F.col("el"), F.col("er")), F.lit(0.0))), product]
    if head == "full":
        parts.append(F.zip_with("el", "er", lambda a, b: F.abs(a - b)))
    return j.select("pair_id", "l", "r", "label", F.concat(*parts).alias("features"))


def train(features: DataFrame, negative: float = 1.0, positive: float = 1.0, reg: float = 0.01, iterations: int = 50):
    """A class-weighted logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = features.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, positive).otherwise(negative).alias("w"))
    return LogisticRegression(weightCol="w", regParam=reg, maxIter=iterations).fit(rows)


def score(model, features: DataFrame) -> DataFrame:
    """(pair_id, l, r, label, score): the positive probability."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(features.withColumn("features", array_to_vector("features")))
    return out.select("pair_id", "l", "r", "label", vector_to_array("probability")[1].alias("score"))


GRID = ((0.001, 1.0), (0.01, 1.0), (0.1, 1.0), (0.01, 2.0))


def train_epochs(train_set: DataFrame, valid_set: DataFrame, test_set: DataFrame, grid=GRID, selection: str = "f1", beta: float = 1.0, step: float = 0.05, done: int = 0):
    """Yields (model, metrics) of each point (regularisation, positive weight) of grid from place `done` on: one epoch each.

    metrics: epoch, reg, positive_weight, loss (mean over the training rows), the threshold that is best on valid, the
    scores there and, with that threshold, on test.
    """
    for epoch, (reg, positive) in list(enumerate(grid))[done:]:
        model = train(train_set, positive=positive, reg=reg)
        found = select_threshold(score(model, valid_set), step, selection, beta).first()  # one row
        test = threshold_counts(score(model, test_set), [found["threshold"]]).first()
        loss = float(model.summary.objectiveHistory[-1])
        yield model, {"epoch": epoch, "reg": reg, "positive_weight": positive, "loss": loss, "threshold": float(found["threshold"]), "valid_score": float(found["score"]), **{f"{n}_{c}": float(r[c]) for n, r in (("valid", found), ("test", test)) for c in ("f1", "precision", "recall")}}


def train_selected(train_set: DataFrame, valid_set: DataFrame, test_set: DataFrame, grid=GRID, selection: str = "f1", beta: float = 1.0, step: float = 0.05):
    """(model, metrics) of the epoch that is best on valid, the first of equals. Features as pair_features gives them."""
    return max(train_epochs(train_set, valid_set, test_set, grid, selection, beta, step), key=lambda x: (x[1]["valid_score"], -x[1]["epoch"]))


def kmeans_clusters(vectors: DataFrame, clusters: int = 90, seed: int = 0) -> DataFrame:
    """(id, cluster) by k-means with at most half as many clusters as rows (two at least)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = min(clusters, max(2, vectors.count() // 2))
    rows = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def info_nce(views, temperature: float = 0.07) -> float:
    """InfoNCE loss of two views, an array (2, n, dim)."""
    import numpy as np

    z = np.concatenate(list(views)).astype(float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    n = len(z) // 2
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    other = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    top = s.max(1)
    return float(np.mean(np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(2 * n), other]))


def barlow_twins(views, lambd: float = 0.0039, scale: float = 1 / 256) -> float:
    """Barlow Twins loss of two views: cross-correlation towards the identity."""
    import numpy as np

    a, b = (np.asarray(v, float) for v in views)
    norm = lambda x: (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5)
    c = norm(a).T @ norm(b) / len(a)
    on = ((np.diag(c) - 1) ** 2).sum() * scale
    return float(on + lambd * scale * ((c**2).sum() - (np.diag(c) ** 2).sum()))


def combined_loss(views, alpha: float = 0.001, **options) -> float:
    return (1 - alpha) * info_nce(views) + alpha * barlow_twins(views, **options)


__all__ = ["barlow_twins", "combined_loss", "info_nce", "kmeans_clusters", "pair_confusion", "pair_features", "score", "train", "train_selected"]
