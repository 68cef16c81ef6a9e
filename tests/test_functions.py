"""Hand-worked values of functions, profiles and metrics."""

import pytest
from pyspark.sql import functions as F

from loomalign.functions import scores, similarity, text
from loomalign.operators import candidates, evaluate, graph, profile
from loomalign.sources import tables


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_numeric_similarity(spark):
    a, b = F.array(*map(F.lit, [1.0, 2.0])), F.array(*map(F.lit, [-1.0, -2.0]))
    same, opposite, short = values(spark, similarity.numeric_similarity(a, a), similarity.numeric_similarity(a, b), similarity.numeric_similarity(a, F.array(F.lit(1.0))))
    assert same == 1.0 and abs(opposite - 0.5) < 1e-6 and short == 0.0


def test_names(spark):
    sim = lambda a, b: text.name_similarity(F.lit(a), F.lit(b))
    assert values(spark, sim("PM_US Post", "PM_Dongsi"), sim("TEMP", "temp"), sim("气温", "温度"), sim("", "a")) == [0.25, 1.0, 0.0, 0.0]
    names = ["No", "Time", "Is", "Ir", "RH", "PT08.S1(CO)", "PM_Jingan", "l_discount", "﻿ year ", None]
    assert values(spark, *[text.semantic_family(F.lit(n).cast("string")).alias(f"x{i}") for i, n in enumerate(names)]) == ["identifier", "time", "snow", "precipitation", "humidity", "gas_sensor", "particulate_matter", "gas_sensor", "year", "unknown"]


def test_fusion(spark):
    score = similarity.fused_score((0.5, 0.5, 0), F.lit(0.8), F.lit(0.6), (F.lit("temp"), F.lit("year")))
    assert abs(values(spark, score)[0] - 0.245) < 1e-12
    assert similarity.normalise_weights(0, -1, 0) == (1.0, 0.0, 0.0)
    assert [round(x, 4) for x in similarity.normalise_weights(0.85, 0.05, 0)] == [0.9444, 0.0556, 0.0]
    assert values(spark, similarity.fused_score((1, 0, 0), F.lit(0.5), F.lit(float("nan")), None))[0] == 0.5  # a term of weight 0 is not there


@pytest.mark.parametrize(("cell", "number"), [("1,234.5", True), ("1_000", True), ("1__0", False), ("1d", False), (" .5e3 ", True), ("inf", True), ("x", False), ("", False), ("+-1", False)])
def test_numbers(spark, cell, number):
    assert values(spark, text.is_number(F.lit(cell)))[0] == number


def column(spark, cells):
    return spark.createDataFrame([(0, "t", 0, "c", i, v) for i, v in enumerate(cells)], tables.CELLS)


@pytest.mark.parametrize(("cells", "kind"), [(["1", "2", "x", "3", "4"], "numeric"), (["a", "a"], "categorical"), (["a"], "text"), (["NA", ""], "empty"), (["2020-01-01", "1/2/3", "10:00"], "date_or_time")])
def test_types(spark, cells, kind):
    assert profile.column_types(column(spark, cells)).first()["type"] == kind


def test_features(spark):
    got = profile.numeric_features(column(spark, ["1", "NA", "3", "x"])).first()["numeric_features"]
    assert got == [2.0, 1.0, 1.0, 3.0, 1.5, 2.0, 2.5, 0.5]
    assert profile.numeric_features(column(spark, ["a"])).first()["numeric_features"] == [0.0] * 8
    assert profile.value_sets(column(spark, [" A", "a", "b ", "NA"])).first()["categorical_values"] == ["a", "b"]


def test_thresholds(spark):
    zero = spark.createDataFrame([(1, 0.0), (0, 0.0)], "label int, score double")
    assert evaluate.best_threshold(zero).first()["threshold"] == 0.5
    exact = spark.createDataFrame([(1, 0.5), (0, 0.1)], "label int, score double")
    assert evaluate.threshold_counts(exact, [0.5]).first()["tp"] == 0  # a score at the threshold is negative
    assert evaluate.select_threshold(exact).first()["threshold"] == 0.1
    with pytest.raises(ValueError, match="step"):
        evaluate.select_threshold(exact, 0)
    assert values(spark, scores.f_beta(F.lit(0.0), F.lit(0.0)))[0] == 0.0


def test_two_table_edge_at_the_threshold(spark):
    s = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.85), ("b", "y", 0.2)], "tgt string, ref string, score double")
    assert {(r.tgt, r.ref) for r in graph.two_table_edges(s, 0.85).collect()} == {("a", "x"), ("b", "x")}


def test_cluster_edges(spark):
    c = spark.createDataFrame([("k", "t1::a", 1), ("k", "t1::b", 1), ("k", "t2::c", 2)], "cluster_id string, node string, table_id int")
    assert {tuple(r) for r in graph.cluster_pairs(c).collect()} == {("t1::a", "t2::c"), ("t1::b", "t2::c")}


def test_recall_ties_go_to_the_larger_left(spark):
    c = spark.createDataFrame([(3, 1, 0.5), (5, 1, 0.5)], "l long, r long, score double")
    t = spark.createDataFrame([(5, 1)], "ltable_id long, rtable_id long")
    assert evaluate.blocking_recall(c, t, [1]).first()["recall"] == 1.0


def test_pool_sizes():
    assert candidates.pool_size(132, 8, 2) == 56 and candidates.pool_size(500, 10, 2) == 72 and candidates.pool_size(10, 2, 1) == 10


def test_conservative_clusters(spark):
    """The best edge first; a merge that would put two columns of a table together, or join loosely, is left out."""
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 3), ("e", 4)], "node string, table_id int")
    edges = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.94), ("b", "d", 0.93), ("d", "e", 0.9)], "src string, dst string, score double")
    pairs = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.94), ("b", "d", 0.93), ("a", "d", 0.92), ("d", "e", 0.9), ("a", "e", 0.1), ("b", "e", 0.95)], "src string, dst string, score double")
    got = {}
    for r in graph.conservative_clusters(edges, pairs, nodes, 0.9).collect():
        got.setdefault(r.cluster_id, set()).add(r.node)
    assert list(got.values()) == [{"a", "b", "d"}]


def test_purity_counts_unknown_labels_alone(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "cluster_id int, node string")
    own = spark.createDataFrame([("a", "x"), ("b", "x")], "node string, label string")
    assert evaluate.cluster_purity(c, own).first()["purity"] == 0.75
