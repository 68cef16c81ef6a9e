"""Writers: candidate pairs, data sets, corpora, metrics, logs."""

from __future__ import annotations

import logging
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_candidates(candidates: DataFrame, path: str) -> None:
    """(l, r, score) as Parquet."""
    candidates.select("l", "r", "score").write.mode("overwrite").parquet(path)


def write_matching_dataset(pairs: DataFrame, a: DataFrame, b: DataFrame, path: str) -> None:
    """A record-matching data set under path from split pairs (left_text, right_text, label, split) and two tables (column_name, text).

    train, valid, test, all_pairs: tab-separated texts; tableA, tableB: one text a line; tableA_columns, tableB_columns:
    names; train_no_label: every text once.
    """
    line = F.concat_ws("\t", "left_text", "right_text", F.col("label").cast("string"))
    for split in ("train", "valid", "test"):
        pairs.where(F.col("split") == split).select(line.alias("value")).write.mode("overwrite").text(f"{path}/{split}.txt")
    pairs.select(line.alias("value")).write.mode("overwrite").text(f"{path}/all_pairs.txt")
    for name, t in (("tableA", a), ("tableB", b)):
        t.select("text").write.mode("overwrite").text(f"{path}/{name}.txt")
        t.select("column_name").write.mode("overwrite").text(f"{path}/{name}_columns.txt")
    a.select("text").union(b.select("text")).distinct().write.mode("overwrite").text(f"{path}/train_no_label.txt")


def write_corpus(texts: DataFrame, path: str) -> int:
    """A pretraining corpus under path: train_no_label has a line for each text, line breaks made spaces; train, valid, test,
    tableA and tableB hold one line, the first text paired with itself. Returns the number of texts; none is an error."""
    lines = texts.select(F.regexp_replace("text", "[\r\n]", " ").alias("value"))
    first, n = lines.agg(F.min("value").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not n:
        raise ValueError("there are no columns to write")
    lines.write.mode("overwrite").text(f"{path}/train_no_label.txt")
    for name in ("train", "valid", "test", "tableA", "tableB"):
        texts.sparkSession.range(1).select(F.lit(f"{first}\t{first}\t1").alias("value")).write.mode("overwrite").text(f"{path}/{name}.txt")
    return n


def write_unlabelled(lines: DataFrame, path: str) -> None:
    """Texts of labelled pairs (pair_id, side, text), a line each, in order."""
    lines.orderBy("pair_id", "side").select("text").write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, run: str, path: str) -> list[dict]:
    """The rows that append_metrics has written for a run, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return [r.asDict() for r in spark.read.parquet(path).where(F.col("run") == run).orderBy("at").collect()]  # a row an epoch


def append_metrics(df: DataFrame, run: str, path: str) -> None:
    """Rows of metrics of a run, appended; run and time are columns."""
    df.withColumn("run", F.lit(run)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def run_logger(name: str, folder: str = "logs") -> logging.Logger:
    """A logger to the console and to a file named by the time."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not log.handlers:
        for h in (logging.StreamHandler(), logging.FileHandler(os.path.join(folder, f"{name}_{time.strftime('%Y%m%d_%H%M%S')}.log"), encoding="utf-8")):
            h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
            log.addHandler(h)
    return log


def log_arguments(log: logging.Logger, arguments: dict) -> None:
    for k, v in sorted(arguments.items()):
        log.info("%s = %s", k, v)
