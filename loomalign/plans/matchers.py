"""Column matching end to end: two tables, every pair of tables, many tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.functions.similarity import dot, fused_score, normalise_weights, profile_similarity, relabel_cluster_node
from loomalign.operators import candidates, evaluate, graph, grid, profile, serialize
from loomalign.operators.encode import Encoder, HashedEncoder
from loomalign.sources.durable import stored


def column_nodes(cells: DataFrame, encoder: Encoder | None = None, with_profiles: bool = True, **text_options) -> DataFrame:
    """nodes(node, table_id, table_name, column_name, type, numeric_features, categorical_values, embedding), stored; the cells are read once for texts and once for profiles."""
    texts = serialize.column_texts(cells, **text_options).withColumn("node", F.concat_ws("::", "table_name", "column_name")).dropDuplicates(["node"])
    vectors = (encoder or HashedEncoder()).fit(texts.select("node", "text"), "node", "text").transform(texts.select("node", "text"), "node", "text").select("node", "embedding")
    nodes = texts.select("node", "table_id", "table_name", "column_name")
    if with_profiles:
        nodes = nodes.join(profile.profiles(cells).select("table_name", "column_name", "type", "numeric_features", "categorical_values"), ["table_name", "column_name"])
    return stored(nodes.join(vectors, "node"), "nodes")


def match_heuristic(cells: DataFrame, target: str, reference: str) -> DataFrame:
    """(tgt, ref, score): each target column's best reference column by profiles; without references "" and 0."""
    p = stored(profile.profiles(cells), "profiles")
    own, other = p.where(F.col("table_name") == target), p.where(F.col("table_name") == reference)
    found = candidates.top_match(candidates.heuristic_scores(own, other))
    return own.select(F.col("column_name").alias("tgt")).join(found, "tgt", "left").select("tgt", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "tgt")


def match_tables(cells: DataFrame, target: str, reference: str, encoder: Encoder | None = None, cluster_threshold: float | None = None, **text_options) -> tuple[DataFrame, DataFrame | None]:
    """(matches (tgt, ref, score), best first; clusters (node, cluster_id) of labels Target::x and Ref::x, if a threshold is given)."""
    nodes = column_nodes(cells, encoder, with_profiles=False, **text_options)
    side = lambda t, n: nodes.where(F.col("table_name") == t).select(F.col("column_name").alias(n), F.col("embedding").alias(f"e{n}"))
    scores = stored(candidates.in_blocks(side(target, "tgt"), side(reference, "ref")).select("tgt", "ref", dot(F.col("etgt"), F.col("eref")).alias("score")), "scores")
    matches = candidates.top_match(scores).orderBy(F.desc("score"), "tgt")
    if cluster_threshold is None:
        return matches, None
    labelled = scores.select(F.concat(F.lit("Target::"), "tgt").alias("tgt"), F.concat(F.lit("Ref::"), "ref").alias("ref"), "score")
    return matches, graph.connected_components(graph.two_table_edges(labelled, cluster_threshold), "tgt", "ref")


def evaluate_match(matches: DataFrame, clusters: DataFrame | None, truth: DataFrame, target: str, reference: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Metrics of match_tables against column ground truth (left, right) of the two tables: of its pairs; of its clusters, purity and pair metrics.

    A column's true label is its component in the ground truth; a column without one has a label of its own.
    """
    own = evaluate.table_pair_truth(truth, target, reference)
    label = lambda t, c: F.concat(F.lit(f"{t}::"), c)
    pairs = matches.select(label(target, "tgt").alias("x"), label(reference, "ref").alias("y")).select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))
    found = evaluate.pair_confusion(pairs, own)
    if clusters is None:
        return found, None, None
    named = stored(clusters.select("cluster_id", relabel_cluster_node(F.col("node"), reference, target).alias("node")), "named-clusters")
    labels = graph.connected_components(own, "left", "right").select("node", F.col("cluster_id").alias("label"))
    return found, evaluate.cluster_purity(named, labels), evaluate_clusters(named, own)


def pairwise_predictions(pairs: DataFrame) -> DataFrame:
    """(left, right, la, lb, score) of every two tables: the table with the smaller id is the reference, and each column of the other one gets its best reference. One job for all table pairs.

    pairs: (src, dst, ts, td, score), directed, with td < ts; it needs only the best of each source and table.
    """
    best = candidates.best(pairs.where("td < ts"), ["src", "td"], 1, F.desc("score"), "dst")
    return best.select(F.least("src", "dst").alias("left"), F.greatest("src", "dst").alias("right"), F.col("td").alias("la"), F.col("ts").alias("lb"), "score")


def pairwise_match(cells: DataFrame, truth: DataFrame | None = None, encoder: Encoder | None = None, **text_options) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(predictions of all table pairs; metrics of each pair that has ground truth; their macro and micro average). Each table is read and encoded once."""
    nodes = column_nodes(cells, encoder, with_profiles=False, **text_options)
    found = stored(pairwise_predictions(grid.candidate_pairs(nodes, per_table=1, below=True)), "pairwise")
    if truth is None:
        return found, None, None
    tables = nodes.select("table_name", "table_id").distinct()
    ids = lambda c, n: tables.select(F.col("table_name").alias(c), F.col("table_id").alias(n))
    t = truth.withColumn("x", F.substring_index("left", "::", 1)).withColumn("y", F.substring_index("right", "::", 1)).join(ids("x", "tx"), "x").join(ids("y", "ty"), "y")
    t = t.select("left", "right", F.least("tx", "ty").alias("la"), F.greatest("tx", "ty").alias("lb"))
    both = found.select("la", "lb").distinct().join(t.select("la", "lb").distinct(), ["la", "lb"])  # a pair counts if it has predictions and truth
    per_pair = stored(evaluate.pair_confusion(found.join(both, ["la", "lb"], "left_semi"), t.join(both, ["la", "lb"], "left_semi"), ["la", "lb"]), "pairwise-metrics")
    return found, per_pair, evaluate.macro_micro(per_pair)


def multi_match(
    cells: DataFrame,
    encoder: Encoder | None = None,
    top_k: int = 1,
    weights: tuple[float, float, float] = (0.8, 0.15, 0.05),
    family_prior: bool = True,
    cluster_threshold: float | None = None,
    cluster_strategy: str = "conservative",
    cluster_average: float | None = None,
    expand: bool = True,
    cluster_edge_threshold: float | None = None,
    **text_options,
) -> tuple[DataFrame, DataFrame | None]:
    """(edges (src_table, src_col, dst_table, dst_col, score), best first; clusters (cluster_id, node) if a threshold is given).

    Reciprocal per-table top-k candidates by fused scores, clustered (conservative, or connected_components of the sparse
    graph) and expanded to all cross-table pairs of a cluster.
    """
    if cluster_strategy not in ("conservative", "connected_components"):
        raise ValueError(f"unknown cluster strategy: {cluster_strategy}")
    nodes = column_nodes(cells, encoder, **text_options)
    pairs = candidates.node_pairs(nodes, same_table=True)
    info = lambda n: nodes.select(F.col("node").alias(n), F.col("column_name").alias(f"n{n}"), F.col("type").alias(f"k{n}"), F.col("numeric_features").alias(f"f{n}"), F.col("categorical_values").alias(f"v{n}"))
    joined = pairs.join(info("a"), "a").join(info("b"), "b")
    _, wp, _ = normalise_weights(*weights)
    profile_term = profile_similarity(*[F.col(f"{x}{n}") for x in ("k", "f", "v") for n in ("a", "b")]) if wp > 0 else None
    scored = stored(joined.select("a", "b", "ta", "tb", "score", fused_score(weights, F.col("score"), profile_term, (F.col("na"), F.col("nb")), family_prior).alias("fused")), "fused")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("table_id").alias("t")).first()
    directed = candidates.nearest_pool(candidates.mirrored(scored, "fused"), candidates.pool_size(size["n"], size["t"], top_k))
    edges = stored(candidates.reciprocal(candidates.per_table_top(directed, top_k)), "edges")
    clusters = None
    if cluster_threshold is not None:
        cross = scored.where("ta != tb").select("a", "b", "ta", "tb", F.col("fused").alias("score"))
        if cluster_strategy == "conservative":
            inside = cross.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score")
            clusters = graph.conservative_clusters(edges.withColumnsRenamed({"a": "src", "b": "dst"}), inside, nodes, cluster_threshold, cluster_average)
        else:
            clusters = graph.connected_components(graph.sparse_edges(candidates.mirrored(cross), cluster_threshold)).select("cluster_id", "node")
        clusters = stored(clusters, "clusters")
        if expand:
            placed = clusters.join(nodes.select("node", "table_id"), "node")
            edges = graph.expand_edges(edges.withColumnsRenamed({"a": "left", "b": "right"}), placed, cross.select(F.col("a").alias("left"), F.col("b").alias("right"), "score"), cluster_edge_threshold).withColumnsRenamed({"left": "a", "right": "b"})
    cut = lambda c: (F.substring_index(c, "::", 1), F.expr(f"substring({c}, instr({c}, '::') + 2)"))
    (at, ac), (bt, bc) = cut("a"), cut("b")
    named = edges.select(at.alias("src_table"), ac.alias("src_col"), bt.alias("dst_table"), bc.alias("dst_col"), "score")
    return named.orderBy(F.desc("score"), "src_table", "src_col", "dst_table", "dst_col"), clusters


def edge_pairs(edges: DataFrame) -> DataFrame:
    """(left, right) labels of edges, for evaluation against column ground truth."""
    a, b = F.concat_ws("::", "src_table", "src_col"), F.concat_ws("::", "dst_table", "dst_col")
    return edges.select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right")).distinct()


def evaluate_edges(edges: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluate.pair_confusion(edge_pairs(edges), truth)


def evaluate_clusters(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """Pair metrics of clusters (cluster_id, node) over all their cross-table pairs."""
    placed = clusters.withColumn("table_id", F.substring_index("node", "::", 1))
    return evaluate.pair_confusion(graph.cluster_pairs(placed), truth)
