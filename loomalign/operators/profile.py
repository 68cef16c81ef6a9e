"""Column profiles: type, numeric features, value sets. Input: cells (one row a cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomalign.functions.text import is_dated, is_missing, is_number, number, strip_cell
from loomalign.operators.order import nth_in_groups
from loomalign.sources.durable import stored

COLUMN = ["table_id", "table_name", "col_idx", "column_name"]
CELL = [*COLUMN, "row_idx", "value"]
ZEROS = [0.0] * 8


def _up_to(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """The cells of each column up to its cut; cuts is a row a column, stored. The largest cut is pushed down to the scan."""
    found = cuts.agg(F.max("cut").alias("most"), F.count("rest").alias("tied")).first()
    near = cells.where(F.col("row_idx") <= (found["most"] or 0)).join(cuts, COLUMN).where(F.col("row_idx") <= F.col("cut"))
    if not found["tied"]:
        return near.drop("cut", "rest")
    split = F.col("rest").isNotNull() & (F.col("row_idx") == F.col("cut"))  # rows that share a number at the cut: as many as belong
    ties = near.where(split).withColumn("_k", F.row_number().over(Window.partitionBy(*COLUMN).orderBy("row_idx"))).where(F.col("_k") <= F.col("rest")).drop("_k")
    return near.where(~split).unionByName(ties).drop("cut", "rest")


def first_cells(cells: DataFrame, n: int) -> DataFrame:
    """The first n cells of every column in row order. Each column's n-th row is found by histograms, then rows are filtered where they are read."""
    return _up_to(cells, nth_in_groups(cells, COLUMN, "row_idx", n).drop("total"))


def first_present(cells: DataFrame, n: int, test: Column, ahead: int = 4) -> DataFrame:
    """The first n cells of every column that pass a test. It runs on a column's first ahead * n cells only, unless these hold too few."""
    cuts = nth_in_groups(cells, COLUMN, "row_idx", ahead * n)
    head = stored(_up_to(cells, cuts.drop("total")).where(test).select(*CELL), "present")
    found = head.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n"))
    few = stored(cuts.where(F.col("total") > ahead * n).join(found, COLUMN, "left").where(F.coalesce("n", F.lit(0)) < n).select(*COLUMN), "few")
    if few.isEmpty():
        return first_cells(head, n)
    rest = cells.join(few, COLUMN, "left_semi").where(test).select(*CELL)
    return first_cells(head.join(few, COLUMN, "left_anti"), n).unionByName(first_cells(rest, n))


def column_list(cells: DataFrame) -> DataFrame:
    return cells.select(*COLUMN).distinct()


def column_types(cells: DataFrame, max_samples: int = 2000) -> DataFrame:
    """numeric if 80 % of the first samples are numbers, date_or_time if 80 % look like dates, categorical if at most half are distinct, else text; empty without values."""
    return _types(column_list(cells), first_present(cells, max_samples, ~is_missing(F.col("value"))))


def _types(columns: DataFrame, seen: DataFrame) -> DataFrame:
    v = F.col("value")
    stats = seen.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n"), F.avg(is_number(v).cast("int")).alias("numbers"), F.avg(is_dated(v).cast("int")).alias("dates"), F.countDistinct(v).alias("distinct"))
    kind = F.when(F.col("numbers") >= 0.8, "numeric").when(F.col("dates") >= 0.8, "date_or_time").when(F.col("distinct") <= 0.5 * F.col("n"), "categorical").otherwise("text")
    return columns.join(stats.withColumn("type", kind), COLUMN, "left").select(*COLUMN, F.coalesce("type", F.lit("empty")).alias("type"), F.coalesce("n", F.lit(0).cast("long")).alias("n_sampled"))


def numeric_features(cells: DataFrame, max_samples: int = 50_000) -> DataFrame:
    """[mean, population deviation, min, max, quartiles, share of missing] of a column's first samples; zeros without numbers."""
    cuts = nth_in_groups(cells, COLUMN, "row_idx", max_samples)
    return _features(_up_to(cells, cuts))


def _features(seen: DataFrame) -> DataFrame:
    """seen: the first cells of each column with total, the number of all its cells."""
    x = number(F.col("value"))
    stats = seen.select(*COLUMN, "total", x.alias("x")).groupBy(*COLUMN).agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile("x", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.count("x").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("total").alias("total")
    )
    features = F.array("mean", "sd", "lo", "hi", F.get("q", F.lit(0)), F.get("q", F.lit(1)), F.get("q", F.lit(2)), (F.col("rows") - F.col("n")) / F.col("total"))
    return stats.select(*COLUMN, F.when(F.col("n") > 0, features).otherwise(F.array(*map(F.lit, ZEROS))).alias("numeric_features"))


def value_sets(cells: DataFrame, max_samples: int = 50_000, max_unique: int = 5000) -> DataFrame:
    """The max_unique most frequent values (stripped, lower-cased; ties by value) of a column's first samples, sorted."""
    return _sets(column_list(cells), first_cells(cells, max_samples), max_unique)


def _sets(columns: DataFrame, seen: DataFrame, max_unique: int = 5000) -> DataFrame:
    values = seen.where(~is_missing(F.col("value"))).select(*COLUMN, F.lower(strip_cell(F.col("value"))).alias("v"))
    counts = values.groupBy(*COLUMN, "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*COLUMN).orderBy(F.desc("n"), "v"))).where(F.col("rank") <= max_unique)
    sets = best.groupBy(*COLUMN).agg(F.sort_array(F.collect_list("v")).alias("s"))
    return columns.join(sets, COLUMN, "left").select(*COLUMN, F.coalesce("s", F.array().cast("array<string>")).alias("categorical_values"))


def profiles(cells: DataFrame, max_samples: int = 50_000, type_samples: int = 2000) -> DataFrame:
    """COLUMN, type, numeric_features (numeric columns only), categorical_values (the other types only), stored.

    Numbers and value sets come from each column's first cells, which are stored once; so does the sample of the type, but
    for columns that have more cells, and too few values among the first ones.
    """
    cuts = stored(nth_in_groups(cells, COLUMN, "row_idx", max_samples), "cuts")
    seen = stored(_up_to(cells, cuts), "first-cells")
    columns, present = cuts.select(*COLUMN), ~is_missing(F.col("value"))
    values = stored(seen.where(present).select(*CELL), "values")
    whole = cuts.where(F.col("total") <= max_samples).select(*COLUMN)
    found = values.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= type_samples).select(*COLUMN)
    far = stored(columns.join(whole.unionByName(found).distinct(), COLUMN, "left_anti"), "far")
    sample = first_cells(values, type_samples)
    if not far.isEmpty():
        sample = sample.join(far, COLUMN, "left_anti").unionByName(first_cells(cells.join(far, COLUMN, "left_semi").where(present).select(*CELL), type_samples))
    none, empty = F.array().cast("array<double>"), F.array().cast("array<string>")
    joined = _types(columns, sample).join(_features(seen), COLUMN).join(_sets(columns, seen), COLUMN)
    return stored(joined.select(*COLUMN, "type", F.when(F.col("type") == "numeric", F.col("numeric_features")).otherwise(none).alias("numeric_features"), F.when(F.col("type").isin("categorical", "text", "date_or_time"), F.col("categorical_values")).otherwise(empty).alias("categorical_values")), "profiles")
