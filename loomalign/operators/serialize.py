"""Texts of columns and of record pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomalign.functions.text import draw, general, is_missing, let, strip, strip_cell
from loomalign.operators.order import nth_in_groups
from loomalign.operators.profile import COLUMN, column_list, column_types, first_present, numeric_features


def _joined(cells: DataFrame, test: Column, value: Column, n: int, sep: str = " ") -> DataFrame:
    """The first n cells of each column that pass a test, joined in row order."""
    seen = first_present(cells, n, test).groupBy(*COLUMN).agg(F.sort_array(F.collect_list(F.struct("row_idx", value.alias("v")))).alias("c"))
    return column_list(cells).join(seen.select(*COLUMN, F.array_join(F.transform("c", lambda x: x["v"]), sep).alias("vals")), COLUMN, "left")


def column_texts(cells: DataFrame, max_cells: int = 128, table_name: bool = False, name: bool = True) -> DataFrame:
    """'[table T] column N values v1 v2 ...' from the first non-missing cells; without both names the values alone."""
    found = _joined(cells, ~is_missing(F.col("value")), strip_cell(F.col("value")), max_cells)
    vals = F.nullif(F.coalesce("vals", F.lit("")), F.lit(""))
    parts = [F.concat(F.lit("table "), "table_name")] * table_name + [F.concat(F.lit("column "), "column_name")] * name
    text = F.concat_ws(" ", *parts, F.concat(F.lit("values "), vals)) if parts else F.coalesce(vals, F.lit(""))
    return found.select(*COLUMN, text.alias("text"))


def value_texts(cells: DataFrame, max_cells: int = 128) -> DataFrame:
    """Values alone; blanks are dropped, missing markers stay."""
    v = strip_cell(F.col("value"))
    return _joined(cells, v != "", v, max_cells).select(*COLUMN, F.coalesce("vals", F.lit("")).alias("text"))


def corpus_texts(cells: DataFrame, max_cells: int = 128) -> DataFrame:
    """'[COL] name [VAL] v1 [VAL] v2 ...' of max_cells non-missing cells drawn by hash, in row order; a column without any is '[COL] name '."""
    kept = cells.where(~is_missing(F.col("value"))).withColumn("d", draw(F.lit("corpus"), F.col("table_name"), F.col("column_name"), F.col("row_idx")))
    cuts = nth_in_groups(kept, COLUMN, "d", max_cells)  # the drawn cells are those with the smallest numbers
    near = kept.join(cuts.drop("total"), COLUMN).where(F.col("d") <= F.col("cut"))
    drawn = near.withColumn("rank", F.row_number().over(Window.partitionBy(*COLUMN).orderBy("d", "row_idx"))).where(F.col("rank") <= max_cells)
    vals = drawn.groupBy(*COLUMN).agg(F.sort_array(F.collect_list(F.struct("row_idx", "value"))).alias("c"))
    marked = F.array_join(F.transform("c", lambda x: F.concat(F.lit("[VAL] "), x["value"])), " ")
    text = F.concat(F.lit("[COL] "), "column_name", F.lit(" "), F.coalesce(F.regexp_replace(marked, "[\r\n]", " "), F.lit("")))
    return column_list(cells).join(vals, COLUMN, "left").select(*COLUMN, text.alias("text"))


def sample_values(cells: DataFrame, n: int = 20) -> DataFrame:
    """The first n non-missing values joined by a space: the view (tid, table_name, column_name, sample_values)."""
    found = _joined(cells, ~is_missing(F.col("value")), strip_cell(F.col("value")), n)
    tid = F.row_number().over(Window.orderBy("table_id", "col_idx")) - 1  # one row a column
    return found.select(tid.alias("tid"), "table_name", "column_name", F.coalesce("vals", F.lit("")).alias("sample_values"))


def profile_texts(cells: DataFrame, examples: int = 10) -> DataFrame:
    """'COL table VAL t COL colname VAL c COL type VAL k COL stats VAL ... COL examples VAL a ; b ; ...'.

    Stats are min, max, mean and std to four digits for numeric columns, else the five most frequent values with their
    shares of the non-missing cells. Examples are the first non-missing cells.
    """
    present = ~is_missing(F.col("value"))
    v = cells.where(present).select(*COLUMN, strip_cell(F.col("value")).alias("v"))
    counts = v.groupBy(*COLUMN, "v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*COLUMN).agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("often", F.row_number().over(Window.partitionBy(*COLUMN).orderBy(F.desc("n"), "v")))
    cents = F.floor((200 * F.col("n") + F.col("total")) / (2 * F.col("total")))  # in whole numbers, so that ties are rounded up everywhere
    top = ranked.where("often <= 5").join(total, COLUMN).groupBy(*COLUMN).agg(F.sort_array(F.collect_list(F.struct("often", F.format_string("%s (%d.%02d)", "v", F.floor(cents / 100), cents % 100).alias("t")))).alias("c"))
    f = numeric_features(cells)
    numbers = F.concat_ws(" ", *[F.concat(F.lit(f"{n} "), general(F.round(F.get("numeric_features", F.lit(i)), 9))) for n, i in (("min", 2), ("max", 3), ("mean", 0), ("std", 1))])
    stats = F.when(F.col("type") == "numeric", numbers).otherwise(F.array_join(F.transform("c", lambda x: x["t"]), " ; "))
    text = F.concat(F.lit("COL table VAL "), "table_name", F.lit(" COL colname VAL "), "column_name", F.lit(" COL type VAL "), "type", F.lit(" COL stats VAL "), F.coalesce(stats, F.lit("")), F.lit(" COL examples VAL "), F.coalesce("vals", F.lit("")))
    shown = _joined(cells, present, strip_cell(F.col("value")), examples, " ; ")
    return column_types(cells).join(f, COLUMN).join(top, COLUMN, "left").join(shown, COLUMN, "left").select(*COLUMN, text.alias("text"))


def pair_tokens(left: Column, right: Column) -> tuple[Column, Column]:
    """Tokens of 'left [SEP] right' and their labels: HD for COL, VAL and the attribute's name after COL, <SEP>, else O."""
    tokens = F.split(F.concat(left, F.lit(" [SEP] "), right), " ")
    label = lambda tk: F.transform(tk, lambda t, i: F.when(t == "[SEP]", "<SEP>").when(t.isin("COL", "VAL") | ((i > 0) & (F.get(tk, i - 1) == "COL")), "HD").otherwise("O"))
    return tokens, let(tokens, label)
