"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and all run on this machine, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file:///tmp/checkpoints/loomalign"
        os.makedirs("/tmp/checkpoints/loomalign", exist_ok=True)
    return own.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back: a short lineage that outlives lost executors, with real sizes for the optimiser."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Tasks of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: str, name: str = "k") -> DataFrame:
    """df with a gapless number from 0 in the order of a column: ranges are numbered apart and their counts summed up, so no task gets all rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = stored(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_own", own).join(before, "_part").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def numbered_within(df: DataFrame, by: list[str], order: str, name: str = "k") -> DataFrame:
    """df with a gapless number from 0 inside each group of by, in the order of a column. Rows are numbered over all groups in ranges, so a hot group is no single task's."""
    from pyspark.sql import functions as F

    rows = stored(numbered(df.withColumn("_within", F.struct(*by, order)), "_within", "_all").drop("_within"), "numbered-all")
    first = rows.groupBy(*by).agg(F.min("_all").alias("_first"))
    return rows.join(first, by).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_first")
