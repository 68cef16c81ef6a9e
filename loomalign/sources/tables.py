"""Readers: tables as cells, record lines, labelled pairs, ground truth."""

from __future__ import annotations

import glob
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomalign.functions.text import draw, is_missing, normalise_name, strip
from loomalign.sources.durable import numbered, stored

CELLS = "table_id int, table_name string, col_idx int, column_name string, row_idx long, value string"

CSV = {"header": False, "multiLine": True, "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}

# Fixed value: the label file that a folder of tables may hold beside them.
NOT_TABLES = frozenset(["multi_gt.csv"])


def discover_tables(names: str = "", folder: str = "", pattern: str = "*.csv") -> list[str]:
    """Files of a comma list and of a folder's pattern: absolute, each once, without label files, sorted."""
    found = [p.strip() for p in names.split(",") if p.strip()] + (glob.glob(os.path.join(folder, pattern)) if folder else [])
    return sorted({os.path.abspath(p) for p in found if os.path.isfile(p) and os.path.basename(p) not in NOT_TABLES})


def table_cells(df: DataFrame, table_id: int, table_name: str, row_idx: Column | str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table as one row a cell. row_idx: a long that orders the rows (a key), so no global numbering is needed."""
    columns = columns or df.columns
    row = F.expr(row_idx) if isinstance(row_idx, str) else row_idx
    # A cell's value is picked after the numbers are exploded, so that a plan that needs none reads no column but the row's.
    wide = df.select(row.cast("long").alias("row_idx"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    long = wide.withColumn("col_idx", F.explode(F.array(*[F.lit(i) for i in range(len(columns))])))
    pick = lambda values: F.coalesce(*[F.when(F.col("col_idx") == i, v) for i, v in enumerate(values)])
    value = pick([F.coalesce(F.col(f"_v{i}").cast("string"), F.lit("")) for i in range(len(columns))])
    return long.select(F.lit(table_id).alias("table_id"), F.lit(table_name).alias("table_name"), "col_idx", pick(map(F.lit, columns)).alias("column_name"), "row_idx", value.alias("value"))


def read_csv_cells(spark: SparkSession, path: str, table_id: int = 0, max_rows: int = 50_000, short_rows: str = "empty") -> DataFrame:
    """Cells of a CSV file. Header names lose byte-order marks and outer space; of equal names the last column wins.

    Rows keep the file's order: a file with quoted line ends cannot be split, so it is one task's, which stops reading after
    max_rows rows. Cells that a short row lacks are empty (short_rows "empty") or left out ("skip"); surplus cells are
    dropped here and counted by surplus_cells().
    """
    head = spark.read.options(**CSV).csv(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], CELLS)
    names = [(i, (v or "").replace("﻿", "").strip()) for i, v in enumerate(head[0])]
    last = {n: i for i, n in names}
    schema = ", ".join(f"c{i} string" for i, _ in names)
    raw = spark.read.options(**CSV).schema(schema).csv(path).limit(max_rows + 1).coalesce(1).withColumn("_row", F.monotonically_increasing_id() - 1)
    raw = raw.where((F.col("_row") >= 0) & (F.col("_row") < max_rows))
    cells = F.array(*[F.struct(F.lit(k).alias("col_idx"), F.lit(n).alias("column_name"), F.col(f"c{last[n]}").alias("value")) for k, n in enumerate(dict.fromkeys(n for _, n in names))])
    out = raw.select(F.col("_row").alias("row_idx"), F.explode(cells).alias("c")).select(F.lit(table_id).alias("table_id"), F.lit(os.path.basename(path)).alias("table_name"), "c.col_idx", "c.column_name", "row_idx", "c.value")
    return out.where(F.col("value").isNotNull()) if short_rows == "skip" else out.withColumn("value", F.coalesce("value", F.lit("")))


def surplus_cells(spark: SparkSession, path: str) -> int:
    """How many rows of a CSV file hold something beyond the header's last column, which read_csv_cells drops."""
    head = spark.read.options(**CSV).csv(path).limit(1).collect()
    if not head:
        return 0
    k = len(head[0])
    wider = spark.read.options(**CSV).schema(", ".join(f"c{i} string" for i in range(k + 1))).csv(path)
    return wider.where(F.col(f"c{k}").isNotNull()).count()


def read_tables(spark: SparkSession, paths: Sequence[str], max_rows: int = 50_000, skip_bad: bool = False) -> DataFrame:
    """Cells of several CSV files, numbered in order. skip_bad: leave out a file that cannot be read to its end, and say so; files are read, and stored, at once."""
    out = None
    for i, p in enumerate(paths):
        try:
            cells = read_csv_cells(spark, p, i, max_rows)
            cells = stored(cells, "cells") if skip_bad else cells
        except Exception as e:
            if not skip_bad:
                raise
            print(f"{p} was left out: {e}")
            continue
        out = cells if out is None else out.unionByName(cells)
    return out if out is not None else spark.createDataFrame([], CELLS)


def present(cells: DataFrame) -> DataFrame:
    return cells.where(~is_missing(F.col("value")))


def record_lines(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All values of a row, ids included, joined by a space."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (columns or df.columns)])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-empty lines (id, text), numbered from 0 in file order; a missing file has none.

    Each split of the file numbers its own lines, and the splits' counts are summed up, so a file of any size is read in parallel.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "id long, text string")
    lines = spark.read.text(path).select(strip(F.col("value")).alias("text"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")).where("text != ''")
    lines = stored(lines, "lines")
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("split", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("before"))  # one row a split
    own = F.row_number().over(Window.partitionBy("split").orderBy("at")) - 1
    return lines.withColumn("own", own).join(before, "split").select((F.col("before") + F.col("own")).alias("id"), "text")


def read_labelled(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(pair_id, left, right, label) of a TSV: the last field is the label, one text leaves right empty. size: first lines only."""
    parts = F.split("text", "\t")
    rows = read_lines(spark, path).select(F.col("id").alias("pair_id"), parts.alias("p")).where(F.size("p") >= 2)
    if size is not None:
        rows = rows.where(F.col("pair_id") < size)
    return rows.select("pair_id", F.get("p", F.lit(0)).alias("left"), F.when(F.size("p") > 2, F.get("p", F.lit(1))).otherwise("").alias("right"), F.element_at("p", -1).cast("int").alias("label"))


def positive_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (left, right) with label 1; union the splits first."""
    return pairs.where("label = 1").select("left", "right").distinct()


def id_truth(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ltable_id, rtable_id) of label 1, and a one-row count of all rows."""
    return rows.where("label = 1").select("ltable_id", "rtable_id").distinct(), rows.agg(F.count(F.lit(1)).alias("total"))


def column_truth(rows: DataFrame) -> DataFrame:
    """Ground truth (left, right) of labels table::column, left <= right; incomplete rows are skipped."""
    need = ["src_table", "src_col", "dst_table", "dst_col"]
    if missing := [c for c in need if c not in rows.columns]:
        raise ValueError(f"ground truth lacks the columns {missing}")
    t = rows.select(*[normalise_name(F.col(c)).alias(c) for c in need]).where(" and ".join(f"{c} != ''" for c in need))
    a, b = F.concat_ws("::", "src_table", "src_col"), F.concat_ws("::", "dst_table", "dst_col")
    return t.select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right")).distinct()


def read_column_truth(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.exists(path.removeprefix("file://")):
        return spark.createDataFrame([], "left string, right string")
    return column_truth(spark.read.csv(path, header=True))


def resize(records: DataFrame, size: int, key: str = "id") -> DataFrame:
    """size rows (pos, key, text): a longer list cycles through the rows in order, a shorter one is a sample by hash order."""
    n = records.count()
    if not n:
        return records.select(F.lit(0).cast("long").alias("pos"), key, "text").limit(0)
    if size > n:
        wanted = records.sparkSession.range(size).select(F.col("id").alias("pos"), (F.col("id") % n).alias("k"))
        return wanted.join(numbered(records.select(key, "text"), key), "k").select("pos", key, "text")
    drawn = records.select(key, "text").orderBy(draw(F.lit("resize"), F.col(key)), key).limit(size)
    return drawn.select((F.row_number().over(Window.orderBy(draw(F.lit("resize"), F.col(key)), key)) - 1).cast("long").alias("pos"), key, "text")


def resolve_task(task_type: str, task: str, roots: Sequence[str] = ("data", ".", "..")) -> str:
    """The first existing <root>/<task_type>/<task>, else the first of them."""
    tried = [os.path.join(r, task_type, task) for r in roots]
    return next((p for p in tried if os.path.isdir(p)), tried[0])


def resolve_checkpoint(path: str) -> str:
    """A saved model: best_model beside or in path, then ssl, also one level deeper; else path itself."""
    here = path if os.path.isdir(path) else os.path.dirname(path)
    for name in ("best_model", "ssl", os.path.join("ssl", "ssl")):
        if os.path.exists(os.path.join(here, name)):
            return os.path.join(here, name)
    return path
