"""Columns that arrive in a stream, matched against stored nodes batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.functions.similarity import dot
from loomalign.operators.candidates import best, in_blocks
from loomalign.operators.encode import Encoder


def score_arrivals(arriving: DataFrame, nodes: DataFrame, encoder: Encoder, path: str, checkpoint: str, k: int = 1):
    """Start a query that writes each arriving (node, table_name, text) column's k best stored nodes of other tables to path.

    A repeated batch rewrites its own folder, so results are exactly once. Stop it by the returned handle.
    """
    known = nodes.select(F.col("node").alias("dst"), F.col("table_name").alias("other"), F.col("embedding").alias("known"))

    def run(batch: DataFrame, number: int) -> None:
        new = encoder.transform(batch.select("node", "table_name", "text"), "node", "text").select(F.col("node").alias("src"), "table_name", "embedding")
        pairs = in_blocks(new, known, F.col("table_name") != F.col("other")).select("src", "dst", dot(F.col("embedding"), F.col("known")).alias("score"))
        best(pairs, ["src"], k, F.desc("score"), "dst").drop("rank").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
