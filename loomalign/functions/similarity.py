"""Similarities of profiles, names and vectors, their fusion, and canonical edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomalign.functions.text import family_compatibility, name_similarity, normalise_name

EPS = 1e-8
SETS = ("categorical", "text", "date_or_time")


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + mean relative difference) of two feature arrays; 0 if one is empty or their lengths differ."""
    terms = F.zip_with(a, b, lambda x, y: F.abs(x - y) / (F.abs(x) + F.abs(y) + EPS))
    mean = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), 1 / (1 + mean)).otherwise(0.0)


def categorical_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two value sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def profile_similarity(type_a: Column, type_b: Column, features_a: Column, features_b: Column, values_a: Column, values_b: Column) -> Column:
    return (
        F.when((type_a == "numeric") & (type_b == "numeric"), numeric_similarity(features_a, features_b))
        .when(type_a.isin(*SETS) & type_b.isin(*SETS), categorical_similarity(values_a, values_b))
        .otherwise(0.0)
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = EPS) -> Column:
    """a / (|a| + eps); eps 0 divides by the norm itself (null for a zero vector)."""
    n = norm(a) + eps
    return F.transform(a.cast("array<double>"), lambda x: F.try_divide(x, n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise_weights(embedding: float, profile: float, name: float) -> tuple[float, float, float]:
    """Weights at least 0 that sum up to 1; all zero gives (1, 0, 0)."""
    w = [max(0.0, float(x)) for x in (embedding, profile, name)]
    return tuple(x / sum(w) for x in w) if sum(w) > 0 else (1.0, 0.0, 0.0)


def fused_score(weights: Sequence[float], embedding: Column, profile: Column | None, names: tuple[Column, Column] | None, family_prior: bool = True) -> Column:
    """Weighted evidence times family compatibility. A term of weight 0 is left out of the plan, so NaN in it cannot spread."""
    we, wp, wn = normalise_weights(*weights)
    out = F.lit(0.0)
    if we > 0:
        out = out + F.lit(we) * embedding
    if wp > 0 and profile is not None:
        out = out + F.lit(wp) * profile
    if wn > 0 and names is not None:
        out = out + F.lit(wn) * name_similarity(*names)
    return out * family_compatibility(*names) if family_prior and names is not None else out


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(src_table, src_col, dst_table, dst_col[, score]): the smaller (table, column) first, the best score of each edge."""
    a, b = F.struct(F.col("src_table").alias("t"), F.col("src_col").alias("c")), F.struct(F.col("dst_table").alias("t"), F.col("dst_col").alias("c"))
    rows = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *[c for c in ["score"] if c in edges.columns])
    keys = [F.col("a.t").alias("src_table"), F.col("a.c").alias("src_col"), F.col("b.t").alias("dst_table"), F.col("b.c").alias("dst_col")]
    return rows.groupBy(*keys).agg(F.max("score").alias("score")) if "score" in edges.columns else rows.select(*keys).distinct()


def canonical_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct unordered pairs (left, right) of normalised labels."""
    a, b = normalise_name(F.col(left)), normalise_name(F.col(right))
    return pairs.select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right")).distinct()


def relabel_cluster_node(label: Column, reference: str, target: str) -> Column:
    """Ref::x and Target::x become <table>::x; other labels stay."""
    return F.when(label.startswith("Ref::"), F.concat(F.lit(f"{reference}::"), F.substring(label, 6, 1 << 30))).when(label.startswith("Target::"), F.concat(F.lit(f"{target}::"), F.substring(label, 9, 1 << 30))).otherwise(label)
