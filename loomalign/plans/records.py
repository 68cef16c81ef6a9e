"""Record matching end to end: data sets from tables, blocking, training, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomalign.functions.similarity import cosine
from loomalign.operators import blocking, evaluate, labels, linkage, serialize
from loomalign.operators.encode import Encoder, HashedEncoder
from loomalign.sources import sinks, tables
from loomalign.sources.durable import stored


def build_dataset(reference: DataFrame, target: DataFrame, max_cells: int = 128, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split pairs, reference columns, target columns) from the cells of two tables: all column pairs labelled by equal headers, split 80 / 10 / 10."""
    a, b = (serialize.value_texts(c, max_cells).select("column_name", "text") for c in (reference, target))
    return labels.split_80_10_10(labels.header_pairs(a, b), ["left", "right"], seed), a, b


def encoded(records: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """records (id, text) with embeddings."""
    return (encoder or HashedEncoder()).fit(records, "id", "text").transform(records, "id", "text")


def block(a: DataFrame, b: DataFrame, k: int = 20, threshold: float | None = None, tfidf: bool = False, encoder: Encoder | None = None) -> DataFrame:
    """Candidates (l, r, score) of two record tables (id, text)."""
    if tfidf:
        return blocking.tfidf_candidates(a, b, k)
    enc = (encoder or HashedEncoder()).fit(a.select("id", "text").unionByName(b.select("id", "text")), "id", "text")
    x, y = (enc.transform(t.select("id", "text"), "id", "text") for t in (a, b))
    return blocking.vector_candidates(x, y, threshold=threshold) if threshold is not None else blocking.vector_candidates_matrix(x, y, k)


def _text_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs of texts as pairs of ids of vectors (id = text)."""
    return pairs.select("pair_id", F.col("left").alias("l"), F.col("right").alias("r"), "label")


def match_records(
    train: DataFrame,
    valid: DataFrame,
    test: DataFrame,
    encoder: Encoder | None = None,
    head: str = "full",
    bootstrap: bool = False,
    zero_shot: bool = False,
    multiplier: int = 8,
    negatives: bool = False,
    num_clusters: int = 90,
    negatives_per_left: int = 1,
    selection: str = "f1",
    beta: float = 1.0,
    step: float = 0.05,
    size: int | None = None,
    epochs=None,
):
    """(model, metrics) of a pair classifier over labelled text pairs (pair_id, left, right, label). epochs: another trainer over the three sets of features.

    Pseudo-labels (bootstrap) replace the labels after the first size rows by what the vectors' similarity says; hard
    negatives (negatives) add pairs of texts from one k-means cluster. The best model and threshold on valid are applied
    to test.
    """
    texts = stored(train.select("left", "right").unionByName(valid.select("left", "right")).unionByName(test.select("left", "right")).select(F.explode(F.array("left", "right")).alias("id")).distinct().withColumn("text", F.col("id")), "texts")
    vectors = stored(encoded(texts, encoder).select("id", "embedding"), "vectors")
    own = _text_pairs(train, vectors)
    if bootstrap:
        e = lambda n: vectors.select(F.col("id").alias(n), F.col("embedding").alias(f"e{n}"))
        scored = stored(own.join(e("l"), "l").join(e("r"), "r").select("pair_id", "l", "r", "label", F.coalesce(cosine(F.col("el"), F.col("er")), F.lit(0.0)).alias("score")), "scored")
        made = labels.bootstrap(scored.select("pair_id", "label", "score"), size if size is not None else train.count() // multiplier, multiplier, zero_shot)
        own = made.select("pair_id", "label").join(scored.select("pair_id", "l", "r"), "pair_id").select("pair_id", "l", "r", "label")
    elif size is not None:
        own = own.where(F.col("pair_id") < size)
    if negatives:
        clusters = stored(linkage.kmeans_clusters(vectors, num_clusters), "clusters")
        side = lambda c: clusters.join(train.select(F.col(c).alias("id")).distinct(), "id", "left_semi")
        more = labels.cluster_negatives(side("left"), side("right"), tables.positive_pairs(train), negatives_per_left)
        own = own.unionByName(more.select(F.lit(-1).cast("long").alias("pair_id"), F.col("left").alias("l"), F.col("right").alias("r"), F.lit(0).alias("label")))
    features = [stored(linkage.pair_features(p, vectors, head), "features") for p in (own, _text_pairs(valid, vectors), _text_pairs(test, vectors))]
    if epochs is not None:
        return epochs(*features, selection=selection, beta=beta, step=step)
    return linkage.train_selected(*features, selection=selection, beta=beta, step=step)


def train_task(spark: SparkSession, folder: str, out: str, run: str = "run", grid=linkage.GRID, resume: bool = False, **options) -> dict:
    """Train on a task folder, an epoch for each point of grid: out/epoch_N holds every model, out/best_model the best one on valid, out/metrics a row an epoch.

    resume: epochs of this run whose metrics are written already are not trained again. Returns the best epoch's metrics.
    """

    def epochs(*features, **how):
        rows = sinks.read_metrics(spark, run, f"{out}/metrics") if resume else []
        for model, metrics in linkage.train_epochs(*features, grid=grid, done=len(rows), **how):
            sinks.save_model(model, f"{out}/epoch_{metrics['epoch']}")
            if not rows or metrics["valid_score"] > max(r["valid_score"] for r in rows):
                sinks.save_model(model, f"{out}/best_model")
            sinks.append_metrics(spark.createDataFrame([metrics]), run, f"{out}/metrics")  # last: an epoch counts when its model is written
            rows.append(metrics)
        return None, max(rows, key=lambda r: (r["valid_score"], -r["epoch"]))

    splits = [tables.read_labelled(spark, f"{folder}/{n}.txt") for n in ("train", "valid", "test")]
    return match_records(*splits, epochs=epochs, **options)[1]


def evaluate_saved(path: str, valid: DataFrame, test: DataFrame, encoder: Encoder | None = None, head: str = "full", selection: str = "f1", beta: float = 1.0, step: float = 0.05) -> DataFrame:
    """Metrics of a saved model on test, with the threshold that is best on valid."""
    from pyspark.ml.classification import LogisticRegressionModel

    model = LogisticRegressionModel.load(tables.resolve_checkpoint(path))
    texts = valid.unionByName(test).select(F.explode(F.array("left", "right")).alias("id")).distinct().withColumn("text", F.col("id"))
    vectors = stored(encoded(texts, encoder).select("id", "embedding"), "vectors")
    scored = [linkage.score(model, linkage.pair_features(_text_pairs(p, vectors), vectors, head)) for p in (valid, test)]
    best = evaluate.select_threshold(scored[0], step, selection, beta).first()  # one row
    return evaluate.threshold_counts(scored[1], [best["threshold"]])


def run_task(spark: SparkSession, folder: str, k: int = 10, with_blocking: bool = False, **options):
    """A task folder (train.txt, valid.txt, test.txt; for blocking also tableA.txt, tableB.txt and the id splits)."""
    splits = [tables.read_labelled(spark, f"{folder}/{n}.txt") for n in ("train", "valid", "test")]
    model, metrics = match_records(*splits, **options)
    if not with_blocking:
        return model, metrics, None
    a, b = tables.read_lines(spark, f"{folder}/tableA.txt"), tables.read_lines(spark, f"{folder}/tableB.txt")
    rows = None
    for n in ("train", "valid", "test"):
        r = spark.read.csv(f"{folder}/{n}.csv", header=True, inferSchema=True)
        rows = r if rows is None else rows.unionByName(r)
    truth, _ = tables.id_truth(rows)
    return model, metrics, evaluate.blocking_recall(block(a, b, k), truth, list(range(1, k + 1)))


__all__: Sequence[str] = ("block", "build_dataset", "encoded", "evaluate_saved", "match_records", "run_task", "train_task")
