"""Files, matchers, records, augmentation, streaming: end to end on small inputs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomalign.functions.text import general
from loomalign.operators import augment, blocking, graph, labels, linkage, profile, serialize
from loomalign.operators.encode import FunctionEncoder, GivenVectors, HashedEncoder
from loomalign.operators.order import nth_in_groups, nth_value
from loomalign.plans import cli, matchers, records
from loomalign.plans.queries import ORACLES, QUERIES
from loomalign.sources import sinks, tables
from loomalign.streaming.arrivals import score_arrivals


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text("﻿ id ,city,temp\n1,Rome,3.5\n2,Oslo,-1\n3,\"Two\nlines\",\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("no,town,temp,x\n7,Rome,3.0,1\n8,Oslo\n9,Bonn,2,3,4\n", encoding="utf-8")
    (tmp_path / "multi_gt.csv").write_text("src_table,src_col,dst_table,dst_col\na.csv,city,b.csv,town\nb.csv,temp,a.csv,temp\na.csv,temp,b.csv,temp\n,x,b.csv,y\n")
    return tmp_path


def test_sources(spark, folder):
    paths = tables.discover_tables(folder=str(folder))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.csv", "b.csv"]
    cells = {(r.table_name, r.column_name, r.row_idx): r.value for r in tables.read_tables(spark, paths).collect()}
    assert cells["a.csv", "id", 0] == "1" and cells["a.csv", "city", 2] == "Two\nlines" and cells["b.csv", "x", 1] == "" and cells["b.csv", "x", 2] == "3"
    assert ("b.csv", "x", 1) not in {(r.table_name, r.column_name, r.row_idx) for r in tables.read_csv_cells(spark, paths[1], short_rows="skip").collect()}
    assert [tables.surplus_cells(spark, p) for p in paths] == [0, 1]
    assert {r.table_name for r in tables.read_tables(spark, [*paths, str(folder / "no.csv")], skip_bad=True).select("table_name").distinct().collect()} == {"a.csv", "b.csv"}
    (folder / "lines").write_text("a\tb\t1\n\n  \nc\t0\nd\n" + "e\tf\t0\n" * 3)
    assert [(r.id, r.text) for r in tables.read_lines(spark, str(folder / "lines")).orderBy("id").limit(3).collect()] == [(0, "a\tb\t1"), (1, "c\t0"), (2, "d")]
    assert [tuple(r) for r in tables.read_labelled(spark, str(folder / "lines"), 4).orderBy("pair_id").collect()] == [(0, "a", "b", 1), (1, "c", "", 0), (3, "e", "f", 0)]
    truth = tables.read_column_truth(spark, str(folder / "multi_gt.csv"))
    assert {tuple(r) for r in truth.collect()} == {("a.csv::city", "b.csv::town"), ("a.csv::temp", "b.csv::temp")}
    with pytest.raises(ValueError, match="lacks"):
        tables.column_truth(spark.createDataFrame([("a",)], "src_table string"))
    assert tables.read_column_truth(spark, str(folder / "none.csv")).count() == 0 and tables.read_lines(spark, str(folder / "none")).count() == 0


def test_matchers(spark, folder):
    paths = tables.discover_tables(folder=str(folder))
    cells = tables.read_tables(spark, paths).cache()
    truth = tables.read_column_truth(spark, str(folder / "multi_gt.csv"))
    assert {r.tgt: r.ref for r in matchers.match_heuristic(cells, "b.csv", "a.csv").collect()}["town"] == "city"
    matches, clusters = matchers.match_tables(cells, "b.csv", "a.csv", cluster_threshold=0.3)
    assert matches.count() == 4 and clusters.where("node like 'Ref::%'").count() > 0
    found, per_pair, total = matchers.pairwise_match(cells, truth)
    assert found.count() == 4 and per_pair.first()["tp"] == 2 and total.first()["micro_recall"] == 1.0
    for strategy in ("conservative", "connected_components"):
        edges, groups = matchers.multi_match(cells, top_k=1, cluster_threshold=0.3, cluster_strategy=strategy)
        assert matchers.evaluate_edges(edges, truth).first()["recall"] == 1.0
        assert groups.groupBy("node").count().where("count > 1").count() == 0
    one = cells.where("table_name = 'a.csv'")
    assert matchers.multi_match(one)[0].count() == 0
    cli.main(["multi_match", "--tables_dir", str(folder), "--ground_truth", str(folder / "multi_gt.csv"), "--logdir", str(folder / "out")], spark)


def test_match_against_ground_truth(spark, folder):
    cells = tables.read_tables(spark, tables.discover_tables(folder=str(folder)))
    truth = tables.read_column_truth(spark, str(folder / "multi_gt.csv"))
    matches = spark.createDataFrame([("town", "city", 0.9), ("temp", "temp", 0.8), ("no", "city", 0.1)], "tgt string, ref string, score double")
    clusters = spark.createDataFrame([("1", "Ref::city"), ("1", "Target::town"), ("2", "Ref::temp"), ("2", "Target::temp"), ("2", "Target::x")], "cluster_id string, node string")
    pairs, purity, grouped = (df.first() for df in matchers.evaluate_match(matches, clusters, truth, "b.csv", "a.csv"))
    assert (pairs.tp, pairs.fp, pairs.fn) == (2, 1, 0) and (purity["items"], purity.majority) == (5, 4) and (grouped.tp, grouped.fp, grouped.fn) == (2, 1, 0)
    assert matchers.evaluate_match(matches, None, truth, "b.csv", "a.csv")[1] is None
    for backend in ("heuristic", "vectors"):
        cli.main(["match", "--reference", str(folder / "a.csv"), "--target", str(folder / "b.csv"), "--backend", backend, "--cluster_threshold", "0.3", "--ground_truth", str(folder / "multi_gt.csv"), "--logdir", str(folder / "out")], spark)
    assert cells.count() == 21


def test_training_is_kept_and_resumed(spark, folder):
    lines = [f"thing {i % 40} red\tthing {(i if i % 2 else i + 7) % 40} blue\t{i % 2}" for i in range(120)]
    task = folder / "em" / "t"
    task.mkdir(parents=True)
    for name, part in (("train", lines[:80]), ("valid", lines[80:100]), ("test", lines[100:])):
        (task / f"{name}.txt").write_text("\n".join(part) + "\n")
    out = str(folder / "model")
    first = records.train_task(spark, str(task), out, grid=linkage.GRID[:2])
    assert [r["epoch"] for r in sinks.read_metrics(spark, "run", f"{out}/metrics")] == [0, 1] and first["valid_f1"] > 0.5 and first["loss"] > 0
    cli.main(["train", "--task_type", str(folder / "em"), "--task", "t", "--save", out, "--epochs", "3", "--resume", "--logdir", str(folder / "out")], spark)
    rows = sinks.read_metrics(spark, "run", f"{out}/metrics")
    assert [r["epoch"] for r in rows] == [0, 1, 2] and {p.name for p in (folder / "model").iterdir()} == {"metrics", "best_model", "epoch_0", "epoch_1", "epoch_2"}
    assert records.train_task(spark, str(task), out, grid=linkage.GRID[:3], resume=True)["valid_score"] == max(r["valid_score"] for r in rows)
    cli.main(["evaluate", "--task_type", str(folder / "em"), "--task", "t", "--checkpoint", f"{out}/best_model", "--logdir", str(folder / "out")], spark)
    cli.main(["convert", "--task_type", str(folder / "em"), "--task", "t", "--logdir", str(folder / "out")], spark)
    assert [r.value for r in spark.read.text(f"{task}/train_no_label.txt").collect()][:3] == ["thing 0 red", "thing 7 blue", "thing 1 red"]


def test_corpus(spark, folder):
    cli.main(["corpus", "--tables_dir", str(folder), "--save", str(folder / "corpus"), "--logdir", str(folder / "out")], spark)
    lines = {r.value for r in spark.read.text(str(folder / "corpus/train_no_label.txt")).collect()}
    assert "[COL] city [VAL] Rome [VAL] Oslo [VAL] Two lines" in lines and len(lines) == 7
    assert [r.value for r in spark.read.text(str(folder / "corpus/valid.txt")).collect()] == [f"{min(lines)}\t{min(lines)}\t1"]
    with pytest.raises(ValueError, match="no columns"):
        sinks.write_corpus(spark.createDataFrame([], "text string"), str(folder / "none"))


# The benchmark's tables (columns of each, numbered through) and its true clusters.
SIZES = (13, 18, 17, 17, 17, 17, 15, 18)
CLUSTERS = """18,36,53,70,87,119 30,47,64,81,98,131 0,13,31,48,65,82,114 1,14,32,49,66,83,115 2,15,33,50,67,84,116 3,16,34,51,68,85,117 6,23,40,57,74,91,124
8,25,42,59,76,93,126 9,27,44,61,78,95,128 10,28,45,62,79,96,129 12,29,46,63,80,97,130 24,41,58,75,92,112,125 4,17,35,52,69,86,100,118 7,26,43,60,77,94,111,127
5,19,20,21,22,37,38,39,54,55,56,71,72,73,88,89,90,120,121,122,123"""


def test_golden_clusters(spark):
    """The true clusters come back as components of their cross-table pairs; 482 pairs, 462 without the seventh table, at most 348 one-to-one in each two tables."""
    table = [t for t, n in enumerate(SIZES) for _ in range(n)]
    groups = [[int(x) for x in g.split(",")] for g in CLUSTERS.split()]
    nodes = spark.createDataFrame([(k, n, table[n]) for k, g in enumerate(groups) for n in g], "cluster_id int, node int, table_id int")
    pairs = graph.cluster_pairs(nodes)
    assert len(table) == 132 and pairs.count() == 482 and graph.cluster_pairs(nodes.where("table_id != 6")).count() == 462
    found = {}
    for r in graph.connected_components(pairs, "left", "right").collect():
        found.setdefault(r.cluster_id, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))
    per_table = [Counter(table[n] for n in g) for g in groups]
    assert sum(min(c[a], c[b]) for c in per_table for a in c for b in c if a < b) == 348


def test_dataset_and_records(spark, folder):
    cells = [tables.read_csv_cells(spark, p, i, short_rows="skip") for i, p in enumerate(tables.discover_tables(folder=str(folder)))]
    pairs, a, b = records.build_dataset(*cells)
    assert pairs.count() == 12 and {r.split for r in pairs.collect()} == {"train", "valid", "test"} and pairs.where("label = 1").count() == 1
    sinks.write_matching_dataset(pairs, a, b, str(folder / "em/task"))
    assert sum(tables.read_labelled(spark, str(folder / f"em/task/{n}.txt")).count() for n in ("train", "valid", "test")) == 12
    rows = [(i, f"thing {i % 40} red", f"thing {(i if i % 2 else i + 7) % 40} blue", i % 2) for i in range(120)]
    data = spark.createDataFrame(rows, "pair_id long, left string, right string, label int")
    model, metrics = records.match_records(data.where("pair_id < 80"), data.where("pair_id between 80 and 99"), data.where("pair_id >= 100"), negatives=True, num_clusters=5)
    assert metrics["test_f1"] > 0.8
    sinks.save_model(model, str(folder / "saved/best_model"))
    assert records.evaluate_saved(str(folder / "saved"), data.where("pair_id < 80"), data.where("pair_id >= 100")).first()["f1"] > 0.8
    _, metrics = records.match_records(data.where("pair_id < 80"), data.where("pair_id between 80 and 99"), data.where("pair_id >= 100"), bootstrap=True, multiplier=2, size=40)
    assert 0 <= metrics["test_f1"] <= 1
    left = spark.createDataFrame([(i, f"thing code{i * 37 + 1000} red") for i in range(20)], "id long, text string")
    for tfidf in (False, True):
        found = records.block(left, left.withColumn("text", F.regexp_replace("text", "red", "blue")), 1, tfidf=tfidf)
        assert found.where("l = r").count() >= 18


def test_encoders(spark):
    rows = spark.createDataFrame([("a", "red fox"), ("b", "red fox jumps"), ("c", ""), ("d", None)], "node string, text string")
    got = {r.node: np.array(r.embedding) for r in HashedEncoder(64).fit(rows).transform(rows).collect()}
    assert abs(np.linalg.norm(got["a"]) - 1) < 1e-6 and got["a"] @ got["b"] > 0.3 and not got["c"].any() and not got["d"].any()
    one = {r.node: r.embedding for r in HashedEncoder(64).fit(rows).transform(rows.repartition(3)).collect()}
    assert all(np.allclose(got[n], one[n]) for n in got)
    assert GivenVectors(rows.select("node", F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))).fit(rows).transform(rows).first().embedding[0] == pytest.approx(0.6)
    lm = FunctionEncoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert lm.fit(rows).transform(rows).count() == 4


def test_losses():
    z = np.random.default_rng(0).normal(size=(8, 5))
    assert linkage.info_nce(np.stack([z, z])) < linkage.info_nce(np.stack([z, z[::-1]]))
    assert linkage.barlow_twins((z, z)) < linkage.barlow_twins((z, z[::-1]))
    x, y = np.random.default_rng(4).normal(size=(2, 5, 3))
    rows, n = [v / np.linalg.norm(v) for v in (*x, *y)], 5
    want = np.mean([-np.log(np.exp(rows[i] @ rows[(i + n) % 10] / 0.07) / sum(np.exp(rows[i] @ rows[k] / 0.07) for k in range(10) if k != i)) for i in range(10)])
    assert linkage.info_nce([x, y]) == pytest.approx(want)
    unit = [[(v[i, d] - v[:, d].mean()) / (v[:, d].var() + 1e-5) ** 0.5 for i in range(5) for d in range(3)] for v in (x, y)]
    c = [[sum(unit[0][i * 3 + a] * unit[1][i * 3 + b] for i in range(5)) / 5 for b in range(3)] for a in range(3)]
    loss = sum((c[a][a] - 1) ** 2 for a in range(3)) / 256 + 0.0039 / 256 * sum(c[a][b] ** 2 for a in range(3) for b in range(3) if a != b)
    assert linkage.barlow_twins((x, y)) == pytest.approx(loss) and linkage.combined_loss([x, y]) == pytest.approx(0.999 * want + 0.001 * loss)
    assert linkage.combined_loss(np.stack([z, z])) > 0


def test_augmentation_keeps_marks(spark):
    text = "COL a VAL x1 y2 z3 COL b VAL w4"
    tokens, kinds = serialize.pair_tokens(F.lit(text), F.lit("COL a VAL x1 COL c VAL q-5"))
    df = spark.range(200).select(F.col("id"), tokens.alias("tokens"), kinds.alias("labels"))
    for op in (*augment.ORDER, "swap_del"):
        rows = augment.augment(df, op, ["id"]).collect()
        assert all(len(r.tokens) == len(r.labels) and r.labels.count("<SEP>") == 1 for r in rows), op
        assert any(r.tokens != df.first().tokens for r in rows), op
        if op not in ("append_col", "drop_col"):
            assert all([t for t, k in zip(r.tokens, r.labels, strict=True) if k != "O"] == [t for t, k in zip(df.first().tokens, df.first().labels, strict=True) if k != "O"] for r in rows), op
    for op in ("all", "corrupt", "cutoff"):
        assert all("[SEP]" in r.tokens for r in augment.augment_pairs(df, ["id"], op).collect())
    moved = augment.augment(df, "append_col", ["id"]).first().tokens
    assert moved.index("[SEP]") < len(moved) and moved.count("COL") == 3 and sorted(t for t in moved if t not in ("COL", "VAL", "a", "b", "c", "[SEP]")) == sorted(t for t in df.first().tokens if t not in ("COL", "VAL", "a", "b", "c", "[SEP]"))
    with pytest.raises(ValueError, match="unknown"):
        augment.augment(df, "nothing", ["id"])
    none = spark.createDataFrame([(1, [], [])], "id int, tokens array<string>, labels array<string>")
    assert all(augment.augment(none, op, ["id"]).first().tokens == [] for op in augment.ORDER if op != "append_col")


def test_bootstrap_edges(spark):
    s = spark.createDataFrame([(i, int(i < 2), i / 10) for i in range(10)], "pair_id long, label int, score double")
    got = {(r.pair_id, r.label, r.source) for r in labels.bootstrap(s, 4, 2).collect()}
    assert {x for x in got if x[2] == "gold"} == {(0, 1, "gold"), (1, 1, "gold"), (2, 0, "gold"), (3, 0, "gold")}
    assert {x[:2] for x in got if x[2] == "pseudo"} == {(9, 1), (4, 0), (5, 0)}
    assert labels.bootstrap(s, 10, 2).count() == 10


def test_tfidf_bounds_change_nothing(spark):
    """Whatever counts as a common term, each row's nearest ones are those of the plain join."""
    rng = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) % 300]
    table = lambda at, n: spark.createDataFrame([(i, " ".join(words[(at + 7 * i + j) % 4000] for j in range(3 + i % 9))) for i in range(n)], "id long, text string")
    a, b = table(0, 120), table(1500, 60)
    plain = {(r.r, r.l): r.score for r in blocking.tfidf_candidates(a, b, 4, common=10**6).collect()}
    for common in (0, 3, 25):
        got = {(r.r, r.l): r.score for r in blocking.tfidf_candidates(a, b, 4, common=common).collect()}
        assert got.keys() == plain.keys() and all(abs(got[x] - plain[x]) < 1e-9 for x in got), common


def test_conservative_clusters_against_a_plain_greedy_run(spark):
    """Random weighted graphs: the best edge first, merging what stays coherent, over all nodes at once."""
    rng = np.random.default_rng(9)
    nodes = [(i, int(rng.integers(0, 6))) for i in range(40)]
    table, score = dict(nodes), {(i, j): round(float(rng.random()), 3) for i in range(40) for j in range(i) if rng.random() < 0.3}
    score = {(j, i): s for (i, j), s in score.items()}
    edges = [(i, j, s) for (i, j), s in score.items() if table[i] != table[j] and rng.random() < 0.7]
    of, at = lambda i, j: score.get((min(i, j), max(i, j)), 0.0), 0.4
    groups = [{i} for i in range(40)]
    for i, j, s in sorted(edges, key=lambda x: (-x[2], x[0], x[1])):
        x, y = (next(g for g in groups if n in g) for n in (i, j))
        if s < at or x is y or {table[n] for n in x} & {table[n] for n in y}:
            continue
        if all(max(of(n, k) for k in y) >= at for n in x) and all(max(of(n, k) for k in x) >= at for n in y) and sum(of(n, k) for n in x for k in y) / len(x) / len(y) >= 0.3:
            groups = [g for g in groups if g is not x and g is not y] + [x | y]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = graph.conservative_clusters(make(edges, "src int, dst int, score double"), make([(i, j, s) for (i, j), s in score.items()], "src int, dst int, score double"), make(nodes, "node int, table_id int"), at, 0.3)
    found = {}
    for r in got.collect():
        found.setdefault(r.cluster_id, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups if len(g) > 1) and len(found) > 3


def test_order_statistics(spark):
    """Histograms find the n-th value that sorting finds, with ties, in groups and over huge ranges."""
    rng = np.random.default_rng(3)
    rows = [(str(g), int(v)) for g in range(4) for v in rng.choice([-(1 << 60), -7, -1, 0, 1, 5, 255, 256, 1 << 20, 1 << 60, *range(90)], 40 * g + 1)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    for n in (1, 7, 30, 1000):
        for r in nth_in_groups(df, ["g"], "v", n).collect():
            own = sorted(v for g, v in rows if g == r.g)
            cut = own[min(n, len(own)) - 1]
            assert (r.total, r.cut) == (len(own), cut) and (own.count(cut) if r.rest is None else r.rest) == min(n, len(own)) - sum(v < cut for v in own)
    x = [float(v) for v in rng.choice(rng.normal(size=50) * 1e9, 300)] + [None]
    scores = spark.createDataFrame([(v,) for v in x], "score double")
    own = sorted(v for v in x if v is not None)
    for n in (1, 2, 150, 300, 900):
        assert nth_value(scores, "score", n) == own[min(n, 300) - 1] and nth_value(scores, "score", n, largest=True) == own[-min(n, 300)]
    assert nth_value(scores.limit(0), "score", 1) is None


def test_profile_samples_beyond_the_first_cells(spark):
    """A column whose first cells are missing is typed by its first values, however far behind they lie."""
    rows = [(0, "t", 0, "far", i, "" if i < 150 else str(i)) for i in range(300)] + [(0, "t", 1, "near", i, f"w{i}") for i in range(300)] + [(0, "t", 2, "none", i, "NA") for i in range(300)]
    cells = spark.createDataFrame(rows, tables.CELLS).repartition(4)
    got = {r.column_name: r for r in profile.profiles(cells, 50, 20).collect()}
    assert {k: v.type for k, v in got.items()} == {"far": "numeric", "near": "text", "none": "empty"} and got["far"].numeric_features == [0.0] * 8
    assert {r.column_name: (r.type, r.n_sampled) for r in profile.column_types(cells, 20).collect()} == {"far": ("numeric", 20), "near": ("text", 20), "none": ("empty", 0)}


def test_general_format(spark):
    values = [0.0, 1.0, -999.85, 43824.0, 2012.5, 0.00012345, 9.9996, 99996.0, 1e-7, 1.5e300, 0.5, 1234.0, -0.0625]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(general(F.col("x"))).collect()]
    assert got == ["0", "1", "-999.9", "4.382e+04", "2013", "0.0001235", "10", "1e+05", "1e-07", "1.5e+300", "0.5", "1234", "-0.0625"]


def test_negatives(spark):
    n = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, cluster int")
    positives = spark.createDataFrame([(0, 2)], "left long, right long")
    got = labels.cluster_negatives(n, n.where("cluster = 0"), positives, per_left=2).collect()
    assert all((r.left, r.right) != (0, 2) and r.left != r.right and (r.left % 2 or r.right % 2 == 0) for r in got)
    assert max(sum(r.left == i for r in got) for i in range(40)) == 2


def test_partition_counts_do_not_matter(spark):
    a = spark.range(60).select(F.col("id"), F.concat_ws(" ", F.lit("t"), F.col("id").cast("string"), (F.col("id") % 7).cast("string")).alias("text"))
    run = lambda n: sorted((r.l, r.r, round(r.score, 9)) for r in blocking.tfidf_candidates(a.repartition(n), a.repartition(n), 3).collect())
    assert run(1) == run(8)


def test_streaming(spark, tmp_path):
    nodes = spark.createDataFrame([("t::a", "t", "red fox"), ("t::b", "t", "blue bird")], "node string, table_name string, text string")
    enc = HashedEncoder(64).fit(nodes)
    nodes.select(F.concat(F.lit("u"), "node").alias("node"), F.lit("u").alias("table_name"), "text").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(nodes.schema).parquet(str(tmp_path / "in"))
    q = score_arrivals(arriving, enc.transform(nodes), enc, str(tmp_path / "out"), str(tmp_path / "mark"))
    q.processAllAvailable()
    q.stop()
    assert {(r.src, r.dst) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("ut::a", "t::a"), ("ut::b", "t::b")}


def test_entry_and_oracles(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["semantic_family", "cell_flags", "heuristic_match", "sparse_graph_components", "pair_metrics", "threshold_select_fbeta", "augment_swap", "augment_drop_same", "augment_ins", "bootstrap_labels"])
def test_oracle(spark, name):
    import glob

    import duckdb

    db = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        db.sql(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    want, got = db.sql(ORACLES[name]), QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda r: sorted(map(str, r))
    assert rows(tuple(r[c] for c in want.columns) for r in got.collect()) == rows(want.fetchall())
