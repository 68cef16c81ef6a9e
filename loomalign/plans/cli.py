"""Command line: match, pairwise_match, multi_match, pipeline, train, block, build_dataset, corpus, convert, evaluate."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from loomalign.operators import labels, linkage, serialize
from loomalign.plans import matchers, records
from loomalign.sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomalign")
    p.add_argument("mode", choices=["match", "pairwise_match", "multi_match", "pipeline", "train", "block", "build_dataset", "corpus", "convert", "evaluate"])
    add = p.add_argument
    add("--reference", default=""), add("--target", default="")
    add("--backend", choices=["heuristic", "vectors"], default="vectors")
    add("--tables", default=""), add("--tables_dir", default=""), add("--tables_glob", default="*.csv")
    add("--max_rows", type=int, default=50_000), add("--max_cells_per_column", type=int, default=128)
    add("--top_k", type=int, default=1)
    add("--embedding_weight", type=float, default=0.8), add("--profile_weight", type=float, default=0.15), add("--name_weight", type=float, default=0.05)
    add("--semantic_family_prior", action=argparse.BooleanOptionalAction, default=True)
    add("--cluster_threshold", type=float, default=None), add("--cluster_average_threshold", type=float, default=None), add("--cluster_edge_threshold", type=float, default=None)
    add("--cluster_strategy", choices=["conservative", "connected_components"], default="conservative")
    add("--expand_edges_from_clusters", action=argparse.BooleanOptionalAction, default=True)
    add("--ground_truth", default="")
    add("--task_type", default="em"), add("--task", default=""), add("--logdir", default="results")
    add("--k", type=int, default=10), add("--threshold", type=float, default=None), add("--tfidf", action="store_true"), add("--blocking", action="store_true")
    add("--bootstrap", action="store_true"), add("--zero", action="store_true"), add("--multiplier", type=int, default=8)
    add("--clustering", action="store_true"), add("--num_clusters", type=int, default=90), add("--cluster_negatives_per_left", type=int, default=1)
    add("--head", choices=["full", "paired_only"], default="full"), add("--size", type=int, default=None), add("--seed", type=int, default=0)
    add("--selection_metric", choices=["f1", "fbeta", "precision"], default="f1"), add("--selection_beta", type=float, default=1.0), add("--threshold_step", type=float, default=0.05)
    add("--checkpoint", default=""), add("--save", default="")
    add("--run", default="run"), add("--resume", action="store_true"), add("--epochs", type=int, default=None)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomalign").getOrCreate()
    log = sinks.run_logger(a.mode, os.path.join(a.logdir, "logs"))
    sinks.log_arguments(log, vars(a))
    task = lambda: tables.resolve_task(a.task_type, a.task)
    training = {"head": a.head, "bootstrap": a.bootstrap, "zero_shot": a.zero, "multiplier": a.multiplier, "negatives": a.clustering, "num_clusters": a.num_clusters, "negatives_per_left": a.cluster_negatives_per_left, "selection": a.selection_metric, "beta": a.selection_beta, "step": a.threshold_step, "size": a.size}
    show = lambda df: [log.info("%s", r.asDict()) for r in df.toLocalIterator()]  # noqa: E731  reports: columns, not rows of data
    if a.mode == "match":
        cells = tables.read_tables(spark, [a.reference, a.target], a.max_rows)
        names = [os.path.basename(p) for p in (a.target, a.reference)]
        if a.backend == "heuristic":
            matches, clusters = matchers.match_heuristic(cells, *names), None
        else:
            matches, clusters = matchers.match_tables(cells, *names, cluster_threshold=a.cluster_threshold, max_cells=a.max_cells_per_column)
        show(matches)
        if clusters is not None:
            show(clusters)
        if a.ground_truth:
            for df in matchers.evaluate_match(matches, clusters, tables.read_column_truth(spark, a.ground_truth), *names):
                if df is not None:
                    show(df)
    elif a.mode in ("pairwise_match", "multi_match"):
        cells = tables.read_tables(spark, tables.discover_tables(a.tables, a.tables_dir, a.tables_glob), a.max_rows)
        truth = tables.read_column_truth(spark, a.ground_truth) if a.ground_truth else None
        if a.mode == "pairwise_match":
            found, per_pair, total = matchers.pairwise_match(cells, truth, max_cells=a.max_cells_per_column)
            for df in (found, per_pair, total):
                if df is not None:
                    show(df)
            return
        weights = (a.embedding_weight, a.profile_weight, a.name_weight)
        edges, clusters = matchers.multi_match(cells, top_k=a.top_k, weights=weights, family_prior=a.semantic_family_prior, cluster_threshold=a.cluster_threshold, cluster_strategy=a.cluster_strategy, cluster_average=a.cluster_average_threshold, expand=a.expand_edges_from_clusters, cluster_edge_threshold=a.cluster_edge_threshold, max_cells=a.max_cells_per_column)
        show(edges)
        if truth is not None:
            show(matchers.evaluate_edges(edges, truth))
            if clusters is not None:
                show(matchers.evaluate_clusters(clusters, truth))
    elif a.mode == "pipeline":
        model, metrics, recall = records.run_task(spark, task(), a.k, a.blocking, **training)
        log.info("%s", metrics)
        if recall is not None:
            show(recall)
        if a.save:
            sinks.save_model(model, a.save)
    elif a.mode == "train":
        log.info("%s", records.train_task(spark, task(), a.save or f"{a.logdir}/{a.run}", a.run, linkage.GRID[: a.epochs], a.resume, **training))
    elif a.mode == "corpus":
        cells = tables.read_tables(spark, tables.discover_tables(a.tables, a.tables_dir, a.tables_glob), a.max_rows, skip_bad=True)
        log.info("%d texts", sinks.write_corpus(serialize.corpus_texts(cells, a.max_cells_per_column), a.save or f"{a.logdir}/corpus"))
    elif a.mode == "convert":
        for path in [p for p in a.task.split(",") if p]:
            folder = tables.resolve_task(a.task_type, path)
            sinks.write_unlabelled(labels.unlabelled(tables.read_labelled(spark, f"{folder}/train.txt")), f"{folder}/train_no_label.txt")
    elif a.mode == "block":
        found = records.block(tables.read_lines(spark, f"{task()}/tableA.txt"), tables.read_lines(spark, f"{task()}/tableB.txt"), a.k, a.threshold, a.tfidf)
        sinks.write_candidates(found, f"{a.logdir}/blocking_result")
    elif a.mode == "build_dataset":
        pairs, left, right = records.build_dataset(*[tables.read_csv_cells(spark, p, i, a.max_rows, "skip") for i, p in enumerate((a.reference, a.target))], a.max_cells_per_column, a.seed)
        sinks.write_matching_dataset(pairs, left, right, task())
    else:
        valid, test = (tables.read_labelled(spark, f"{task()}/{n}.txt", a.size) for n in ("valid", "test"))
        show(records.evaluate_saved(a.checkpoint, valid, test, head=a.head, selection=a.selection_metric, beta=a.selection_beta, step=a.threshold_step))



if __name__ == "__main__":
    main()
