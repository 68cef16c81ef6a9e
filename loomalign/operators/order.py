"""Order statistics without sorting: histograms that narrow to the n-th value. No task gets a group, and no sort gathers n rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomalign.sources.durable import stored

BINS = 4096


def _place(x: str) -> Column:
    """An order-preserving bin of a long: its sign, its length in bits and the next eight bits. At most 2 * 64 * 256 bins, fine ones near 0."""
    size = F.length(F.bin(F.abs(x)))
    code = size * 512 + F.call_function("shiftright", F.abs(x), F.greatest(size - 9, F.lit(0))).cast("int")
    return F.when(F.col(x) < 0, -code).otherwise(code)


def nth_in_groups(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """by, total, cut, rest: the n-th smallest long of each group, or its largest if there are fewer; rest: if not all rows equal to cut belong to the first n, how many do.

    One state row a group; after the first, a round reads only the rows of one bin a group.
    """
    first = rows.select(*by, F.col(value).alias("x")).groupBy(*by, _place("x").alias("bin")).agg(F.count(F.lit(1)).alias("w"), F.min("x").alias("a"), F.max("x").alias("b"))
    group = Window.partitionBy(*by)
    total, until = F.sum("w").over(group), F.sum("w").over(group.orderBy("bin"))
    placed = first.withColumn("total", total).withColumn("before", until - F.col("w")).withColumn("n", F.least(F.lit(n), "total")).where((F.col("before") < F.col("n")) & (F.col("before") + F.col("w") >= F.col("n")))
    whole = F.col("before") + F.col("w") == F.col("n")
    closed = (F.when((F.col("a") == F.col("b")) | whole, F.col("b")).alias("cut"), F.when((F.col("a") == F.col("b")) & ~whole, F.col("n") - F.col("before")).alias("rest"))
    state = stored(placed.select(*by, "total", "n", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("before").alias("below"), *closed), "order")
    while True:
        open_ = state.where("cut is null")
        ends = open_.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        if ends["lo"] is None:
            break
        near = rows.where(F.col(value).between(ends["lo"], ends["hi"]))  # pushed down to the scan
        live = near.select(*by, F.col(value).alias("x")).join(open_, by).where(F.col("x").between(F.col("lo"), F.col("hi")))
        bins = live.groupBy(*by, F.expr(f"(x - lo) div ((hi - lo) div {BINS} + 1)").alias("bin")).agg(F.count(F.lit(1)).alias("w"), F.min("x").alias("a"), F.max("x").alias("b"), *[F.first(c).alias(c) for c in ("below", "total", "n")])
        before = F.col("below") + F.sum("w").over(group.orderBy("bin")) - F.col("w")
        found = bins.withColumn("before", before).where((F.col("before") < F.col("n")) & (F.col("before") + F.col("w") >= F.col("n")))
        found = found.select(*by, "total", "n", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("before").alias("below"), *closed)
        state = stored(state.where("cut is not null").unionByName(found), "order")
    return state.select(*by, "total", "cut", "rest")


def nth_value(rows: DataFrame, value: str, n: int, largest: bool = False) -> float | None:
    """The n-th smallest (or largest) double, or the last one if there are fewer; nulls do not count, None without values."""
    x = F.col(value).cast("double")
    live = rows.select((-x if largest else x).alias("x")).where("x is not null")
    first = live.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not first["n"]:
        return None
    lo, hi, below = first["lo"], first["hi"], 0
    n = min(max(1, n), first["n"])
    while lo < hi:
        bin_ = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * (BINS - 1)), F.lit(BINS - 1))
        bins = live.where(F.col("x").between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("w"), F.min("x").alias("a"), F.max("x").alias("b"))
        for r in bins.orderBy("bin").collect():  # BINS rows at most
            if below + r["w"] >= n:
                lo, hi = r["a"], r["b"]
                break
            below += r["w"]
    return -lo if largest else lo
