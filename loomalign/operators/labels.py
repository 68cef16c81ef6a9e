"""Training pairs: splits, pseudo-labels, negatives, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomalign.functions.text import draw, normalise_name
from loomalign.operators import grid
from loomalign.operators.candidates import in_blocks
from loomalign.operators.order import nth_value
from loomalign.sources.durable import numbered, numbered_within, stored


def unlabelled(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, text): every labelled pair as its left line, then its right line."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("text")), F.struct(F.lit(1).alias("side"), F.col("right").alias("text"))))
    return pairs.select("pair_id", sides.alias("s")).select("pair_id", "s.side", "s.text")


def header_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, left_text, right_text, label) of all columns (column_name, text) of two tables; label: equal headers but for case and outer space."""
    side = lambda t, n: t.select(F.col("column_name").alias(n), F.col("text").alias(f"{n}_text"))
    bare = lambda c: F.lower(normalise_name(F.col(c)))
    return in_blocks(side(a, "left"), side(b, "right")).withColumn("label", (bare("left") == bare("right")).cast("int"))


def split_80_10_10(pairs: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """pairs with split (train, valid, test): shuffled by hash of the keys, then cut at 80 and 90 percent by place."""
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(draw(F.lit(seed), *map(F.col, keys)).alias("draw"), *keys)
    placed, at = numbered(pairs.withColumn("_order", order), "_order", "place"), F.col("place")
    return placed.join(F.broadcast(n)).withColumn("split", F.when(at < F.floor(0.8 * F.col("n")), "train").when(at < F.floor(0.9 * F.col("n")), "valid").otherwise("test")).drop("n", "place", "_order")


def bootstrap_thresholds(scored: DataFrame, size: int, multiplier: int) -> tuple[float, float]:
    """(above which a pair counts as positive, below which as negative): scored (pair_id, label, score); the first size rows are gold."""
    gold = scored.where(F.col("pair_id") < size).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    positive, rest = int(gold["pos"] or 0), scored.where(F.col("pair_id") >= size).select("score")
    more, less = positive * (multiplier - 1), (int(gold["n"]) - positive) * (multiplier - 1)
    n = rest.count()
    if not n:
        return 1.0, -1.0
    # sorted[-more] and sorted[less]: with more = 0 the first one indexes the smallest score, as in the original definition.
    low = nth_value(rest, "score", min(less, n - 1) + 1)
    high = nth_value(rest, "score", 1) if more == 0 else nth_value(rest, "score", min(more, n), largest=True)
    return high, low


def bootstrap(scored: DataFrame, size: int, multiplier: int = 8, zero_shot: bool = False) -> DataFrame:
    """(pair_id, label, source): gold rows (unless zero_shot) and pseudo-labels of rows beyond a threshold; a row beyond both appears twice."""
    high, low = bootstrap_thresholds(scored, size, multiplier)
    rest = scored.where(F.col("pair_id") >= size)
    out = rest.where(F.col("score") > high).select("pair_id", F.lit(1).alias("label"), F.lit("pseudo").alias("source")).unionByName(rest.where(F.col("score") < low).select("pair_id", F.lit(0).alias("label"), F.lit("pseudo").alias("source")))
    return out if zero_shot else scored.where(F.col("pair_id") < size).select("pair_id", F.col("label").cast("int").alias("label"), F.lit("gold").alias("source")).unionByName(out)


def bootstrap_by_quantile(candidates: DataFrame, multiplier: int = 8) -> DataFrame:
    """candidates (l, r, score) with label 1 above the (1 - 1 / multiplier) quantile of the scores. For pairs of vectors, see bootstrap_vectors."""
    q = candidates.agg(F.percentile("score", 1 - 1 / multiplier).alias("q"))
    return candidates.join(F.broadcast(q)).withColumn("label", (F.col("score") > F.col("q")).cast("int")).drop("q")


def bootstrap_vectors(a: DataFrame, b: DataFrame, multiplier: int = 8) -> DataFrame:
    """(l, r) of the pairs of two vector tables (id, embedding) above the (1 - 1 / multiplier) quantile of all pairs' scores; the others are not made."""
    q = grid.vector_quantile(a, b, 1 - 1 / multiplier)
    return grid.vector_above(a, b, float("inf") if q is None else q, strict=True, scores=False)


def label_confusion(pseudo: DataFrame, truth: DataFrame) -> DataFrame:
    """Rates of right and wrong pseudo-labels: tpr, tnr, fpr, fnr. Both: pair_id, label."""
    j = pseudo.select("pair_id", F.col("label").alias("p")).join(truth.select("pair_id", F.col("label").alias("t")), "pair_id")
    c = lambda p, t: F.sum(((F.col("p") == p) & (F.col("t") == t)).cast("long"))
    n = j.agg(*[F.coalesce(c(p, t), F.lit(0).cast("long")).alias(f"{a}{b}") for a, p, b, t in (("p", 1, "p", 1), ("n", 0, "n", 0), ("p", 1, "n", 0), ("n", 0, "p", 1))])
    r = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return n.select(r("pp", "np").alias("tpr"), r("nn", "pn").alias("tnr"), r("pn", "nn").alias("fpr"), r("np", "pp").alias("fnr"))


def cleaning_bootstrap(labelled: DataFrame, pool: DataFrame, similarity: DataFrame, factor: int = 4) -> DataFrame:
    """(id, label) of pool rows by their nearest labelled row, kept where the similarity reaches the class's threshold.

    labelled (id, label), similarity (l, r, score) of labelled l and pool r. For each class, the threshold is the score of
    its factor * (labelled rows of the class)-th most similar pool row (the least one if there are fewer).
    """
    near = similarity.withColumn("rank", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "l"))).where("rank = 1")
    near = stored(near.join(pool.select(F.col("id").alias("r")), "r").join(labelled.select(F.col("id").alias("l"), "label"), "l").select("r", "score", "label"), "nearest")
    wanted = {r["label"]: factor * r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    out = None
    for label, n in sorted(wanted.items()):
        own = near.where(F.col("label") == label)
        least = nth_value(own, "score", n, largest=True)
        kept = own.where(F.col("score") >= F.lit(least)).select(F.col("r").alias("id"), "label")
        out = kept if out is None else out.unionByName(kept)
    return out if out is not None else near.select(F.col("r").alias("id"), "label")


def cluster_negatives(lefts: DataFrame, rights: DataFrame, positives: DataFrame, per_left: int = 1, tries: int = 5, seed: int = 0) -> DataFrame:
    """(left, right) hard negatives: per_left rights of the left's cluster, drawn by hash, that are not positive.

    lefts and rights (id, cluster). Rights are numbered inside their cluster, and a left draws tries * per_left numbers, so
    no left meets a whole cluster; a left whose cluster has no right draws from all rights.
    """
    numbers = numbered_within(rights.select(F.col("id").alias("right"), "cluster"), ["cluster"], "right")
    sizes = rights.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    everyone = numbered(rights.select(F.col("id").alias("right")), "right")
    total = rights.agg(F.count(F.lit(1)).alias("total"))
    draws = lefts.select(F.col("id").alias("left"), "cluster").join(sizes, "cluster", "left").join(F.broadcast(total)).select("left", "cluster", "n", "total", F.explode(F.sequence(F.lit(0), F.lit(tries * per_left - 1))).alias("turn"))
    picked = draws.withColumn("k", F.pmod(draw(F.lit(seed), F.col("left"), F.col("turn")), F.coalesce("n", "total")))
    own = picked.where("n is not null").join(numbers, ["cluster", "k"]).select("left", "turn", "right")
    other = picked.where("n is null").drop("cluster").join(everyone, "k").select("left", "turn", "right")
    found = own.unionByName(other).join(positives.select("left", "right"), ["left", "right"], "left_anti").where("left != right")
    once = found.groupBy("left", "right").agg(F.min("turn").alias("turn"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("left").orderBy("turn", "right"))).where(F.col("rank") <= per_left).select("left", "right")
