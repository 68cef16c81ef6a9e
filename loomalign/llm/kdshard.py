"""Shards of near-equal bytes by k-d tree partitioning, in DataFrame functions only.

The tree is built level by level for all nodes at once. A node that is to hold n leaves is split along the dimension in
which it is widest (its range, over the range of all rows) at the weighted quantile of bytes that gives one side n / 2
leaves' share (the median for even n), until every node is one leaf. The number of leaves is given, or follows from the
bytes a leaf is to reach. The quantile is found by distributed histograms: each round sums bytes by (node, bin), keeps the
bin in which the quantile is reached and bins that bin again, first by the coordinate, then, among equal coordinates, by
id; so a hot value (one source with a third of the rows) is cut inside, and two sides differ from their shares by no more
than a row. Per round the driver gets one row a node.

Whole numbers are coordinates themselves; values of other types (text, floating numbers, dates) have their dense rank among
the column's distinct values, so any two values differ. Defined cases: null text has no bytes, so the size is 1; a null
coordinate is before all others; a null id counts as the smallest; rows with one id are kept together at a cut; texts of
any length are one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomalign.llm.common import shuffle_width, stored

BINS = 1024


def _is_whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType | T.BooleanType)


def ranked(values: DataFrame) -> DataFrame:
    """(v, rank) of a table of distinct values: dense from 1, in order. Ranges are numbered apart and their counts summed up, so no task gets all values."""
    parts = stored(values.repartitionByRange(shuffle_width(values.sparkSession), "v").withColumn("part", F.spark_partition_id()), "kd-values")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("v"))
    return parts.withColumn("own", own).join(before, "part").select("v", (F.col("before") + F.col("own")).alias("rank"))


def with_coordinates(rows: DataFrame, docs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """rows with column d0, d1 ... of values replaced by x0, x1 ...: order-preserving longs. Ranks are joined by value; Spark broadcasts them where they are few."""
    for i, name in enumerate(dims):
        if _is_whole(docs, name):
            low = F.lit(-(1 << 62))
            rows = rows.withColumn(f"x{i}", F.greatest(low, F.least(-low, F.coalesce(F.col(f"d{i}").cast("long"), low)))).drop(f"d{i}")
        else:
            ranks = stored(ranked(rows.select(F.col(f"d{i}").alias("v")).where("v is not null").distinct()), "kd-ranks")
            rows = rows.join(ranks, F.col(f"d{i}") == F.col("v"), "left").withColumn(f"x{i}", F.coalesce("rank", F.lit(0).cast("long"))).drop(f"d{i}", "v", "rank")
    return rows


def _small(spark, columns: str, rows: Sequence[Sequence]) -> DataFrame:
    """A table of one row a node, inline in the plan."""
    values = ", ".join("(" + ", ".join(f"{v}L" if isinstance(v, int) and not isinstance(v, bool) else str(v).lower() for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def split_level(rows: DataFrame, dims: int, width: dict[int, int], leaves: dict[int, int]) -> dict[int, tuple[int, int, int, bool]]:
    """node: (dimension, coordinate, id, whether rows with that id go left) of each node's weighted quantile. leaves: of each node to be split."""
    spark = rows.sparkSession
    chosen = _small(spark, "node", [(k,) for k in leaves])
    rows = rows.join(F.broadcast(chosen) if len(leaves) <= 4096 else chosen, "node", "left_semi")
    stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"x{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    open_, done = {}, {}
    for r in stats:
        d = max(range(dims), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / max(1, width[d]), -d))
        open_[r["node"]] = {"dim": d, "lo": r[f"lo{d}"], "hi": r[f"hi{d}"], "below": 0, "share": leaves[r["node"]] // 2 * r["bytes"], "of": leaves[r["node"]], "value": None}
    while open_:
        state = _small(spark, "node, dim, lo, step, hi, below, share, of, tied, value", [(n, s["dim"], s["lo"], (s["hi"] - s["lo"]) // BINS + 1, s["hi"], s["below"], s["share"], s["of"], s["value"] is not None, s["value"] or 0) for n, s in open_.items()])
        along = F.coalesce(*[F.when(F.col("dim") == d, F.col(f"x{d}")) for d in range(dims)])
        live = rows.join(F.broadcast(state) if len(open_) <= 4096 else state, "node").withColumn("x", along)
        live = live.where(~F.col("tied") | (F.col("x") == F.col("value"))).withColumn("x", F.when(F.col("tied"), F.col("id")).otherwise(F.col("x"))).where(F.col("x").between(F.col("lo"), F.col("hi")))
        sums = live.groupBy("node", F.expr("(x - lo) div step").alias("bin")).agg(F.sum("size").alias("w"), F.min("x").alias("a"), F.max("x").alias("b"), F.first("below").alias("below"), F.first("share").alias("share"), F.first("of").alias("of"))
        before = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.coalesce(before, F.lit(0)) + F.col("below")).where((F.col("of") * F.col("before") < F.col("share")) & (F.col("of") * (F.col("before") + F.col("w")) >= F.col("share")))
        fresh = []
        for r in sums.select("node", "w", "a", "b", "before").collect():
            s = open_[r["node"]]
            s["lo"], s["hi"], s["below"] = r["a"], r["b"], r["before"]
            if r["a"] < r["b"]:
                continue
            if s["value"] is None:
                s["value"] = r["a"]
                fresh.append(r["node"])
            else:
                over, under = s["of"] * (r["before"] + r["w"]) - s["share"], s["share"] - s["of"] * r["before"]
                done[r["node"]] = (s["dim"], s["value"], r["a"], over <= under)
                del open_[r["node"]]
        if fresh:  # on to the ids among the rows with the median's coordinate
            names = _small(spark, "node, dim, value", [(n, open_[n]["dim"], open_[n]["value"]) for n in fresh])
            tied = rows.join(F.broadcast(names) if len(fresh) <= 4096 else names, "node").where(along == F.col("value"))
            for r in tied.groupBy("node").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect():
                open_[r["node"]]["lo"], open_[r["node"]]["hi"] = r["a"], r["b"]
    return done


def kd_shards(docs: DataFrame, dims: Sequence[str] = ("source", "lang", "doc_id"), shards: int = 16, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, shard, slot. target_bytes: instead of shards, the bytes that a leaf is to reach."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("own"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("crc"), *[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)])
    n = len(dims) + 1
    rows = with_coordinates(stored(rows, "kd-read"), docs, dims)
    rows = stored(rows.withColumn(f"x{len(dims)}", F.col("size")).withColumn("node", F.lit(0).cast("long")), "kd-rows")
    spread = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[F.max(f"x{d}").alias(f"hi{d}") for d in range(n)], *[F.min(f"x{d}").alias(f"lo{d}") for d in range(n)]).first()
    if target_bytes is not None:
        shards = max(1, -(-(spread["bytes"] or 0) // target_bytes))
    leaves, level = {0: shards}, 0  # node: its leaves; a node's number is that of its first leaf
    while spread["n"] and (open_ := {k: v for k, v in leaves.items() if v > 1}):
        cuts = split_level(rows, n, {d: spread[f"hi{d}"] - spread[f"lo{d}"] for d in range(n)}, open_)
        table = _small(rows.sparkSession, "node, dim, value, cut, left, skip", [(k, *v, open_[k] // 2) for k, v in cuts.items()])
        along = F.coalesce(*[F.when(F.col("dim") == d, F.col(f"x{d}")) for d in range(n)])
        left = (along < F.col("value")) | ((along == F.col("value")) & ((F.col("id") < F.col("cut")) | ((F.col("id") == F.col("cut")) & F.col("left"))))
        moved = F.col("node") + F.when(F.col("dim").isNull() | left, 0).otherwise(F.col("skip"))
        rows = rows.join(F.broadcast(table) if len(cuts) <= 4096 else table, "node", "left").withColumn("node", moved).select("own", "id", "size", "crc", *[f"x{d}" for d in range(n)], "node")
        for k in cuts:  # a node without rows has no cut and stays as it is
            leaves[k + open_[k] // 2] = open_[k] - open_[k] // 2
            leaves[k] = open_[k] // 2
        leaves = {k: v for k, v in leaves.items() if k not in open_ or k in cuts}
        level += 1
        if level % 2 == 0:
            rows = stored(rows, "kd-level")
    # Slots: rows are numbered inside (shard, cell) and the cells' counts are summed up, so no task gets a whole shard.
    cells = max(64, spread["n"] // (shards * 20_000))
    cell = rows.select("own", "id", "size", "crc", F.col("node").cast("int").alias("shard"), F.pmod(F.xxhash64("id"), F.lit(cells)).alias("cell"))
    starts = cell.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("shard").orderBy("cell")) - F.col("c")).drop("c")
    numbered = cell.withColumn("k", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "crc"))).join(starts, ["shard", "cell"])
    return numbered.select(F.col("own").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("k") - 1).alias("slot"))
