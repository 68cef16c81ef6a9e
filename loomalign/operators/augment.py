"""Augmentations of token lists, with repeatable draws by hash. Only tokens labelled O are changed; HD and <SEP> stay.

A frame has key columns, tokens (array<string>) and labels (array<string>). Every operator returns the same columns.
Where an operator finds nothing to act on, the row stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomalign.functions.text import draw, let

# The symbols that ins puts in, and the operators that "all" draws three of.
SYMBOLS = ("-", "*", ".", ",", "#", "&")
ALL = ("del", "swap", "drop_col", "append_col")
ORDER = ("del", "swap", "drop_len", "drop_sym", "drop_same", "drop_token", "ins", "append_col", "drop_col")



def tokens_() -> Column:
    return F.col("tokens")


def labels_() -> Column:
    return F.col("labels")


def _pick(options: Column, d: Column) -> Column:
    """One element of an array by a draw; null for an empty one."""
    return F.when(F.size(options) > 0, F.get(options, F.pmod(d, F.size(options)).cast("int")))


def _places(n: Column) -> Column:
    """Starts (from 0) of spans of n tokens that are all O."""
    last = F.size(tokens_()) - n
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.forall(F.slice(labels_(), i + 1, n), lambda x: x == "O"))).otherwise(F.array().cast("array<int>"))


def _without(a: Column, at: Column, n: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), at), F.slice(a, at + n + 1, F.greatest(F.size(a) - at - n, F.lit(0))))


def _kept(df: DataFrame, keep, bound: Column | None = None) -> DataFrame:
    """Tokens for which keep(token, place, bound) holds, and every token that is not O."""
    chosen = lambda b: F.filter(F.sequence(F.lit(0), F.size(tokens_()) - 1), lambda i: (F.get(labels_(), i) != "O") | keep(F.get(tokens_(), i), i, b))
    places = F.when(F.size(tokens_()) > 0, let(F.lit(0) if bound is None else bound, chosen)).otherwise(F.array().cast("array<int>"))
    at = lambda p: F.struct(F.transform(p, lambda i: F.get(tokens_(), i)).alias("tokens"), F.transform(p, lambda i: F.get(labels_(), i)).alias("labels"))
    new = df.withColumn("_new", let(places, at))
    return new.withColumns({"tokens": F.col("_new.tokens"), "labels": F.col("_new.labels")}).drop("_new")


def _set(df: DataFrame, found: Column, tokens: Column, labels: Column) -> DataFrame:
    return df.withColumns({"tokens": F.when(found, tokens).otherwise(tokens_()), "labels": F.when(found, labels).otherwise(labels_())})


def delete(df: DataFrame, d) -> DataFrame:
    """A span of one or two tokens goes."""
    df = df.withColumn("_n", (F.pmod(d("n"), F.lit(2)) + 1).cast("int")).withColumn("_at", _pick(_places(F.col("_n")), d("at")))
    return _set(df, F.col("_at").isNotNull(), _without(tokens_(), F.col("_at"), F.col("_n")), _without(labels_(), F.col("_at"), F.col("_n"))).drop("_n", "_at")


def swap(df: DataFrame, d) -> DataFrame:
    """A span of two to four tokens is shuffled."""
    df = df.withColumn("_n", (F.pmod(d("n"), F.lit(3)) + 2).cast("int")).withColumn("_at", _pick(_places(F.col("_n")), d("at")))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.struct(d("order", i).alias("d"), i.alias("i"))))
    span = F.transform(order, lambda x: F.get(tokens_(), F.col("_at") + x["i"]))
    tokens = F.concat(F.slice(tokens_(), F.lit(1), F.col("_at")), span, F.slice(tokens_(), F.col("_at") + F.col("_n") + 1, F.size(tokens_())))
    return _set(df, F.col("_at").isNotNull(), tokens, labels_()).drop("_n", "_at")


def drop_len(df: DataFrame, d) -> DataFrame:
    """All tokens of one token's length go."""
    lengths = F.array_sort(F.array_distinct(F.transform(F.filter(F.arrays_zip(tokens_(), labels_()), lambda x: x["labels"] == "O"), lambda x: F.length(x["tokens"]))))
    return _kept(df, lambda t, i, n: F.length(t) != n, F.coalesce(_pick(lengths, d("len")), F.lit(-1)))


def drop_sym(df: DataFrame, d) -> DataFrame:
    """In a fifth of the tokens, everything but letters and digits becomes a space."""
    return df.withColumn("tokens", F.transform(tokens_(), lambda t, i: F.when((F.get(labels_(), i) == "O") & (F.pmod(d("sym", i), F.lit(5)) == 0), F.regexp_replace(t, r"[^\p{L}\p{N}]", " ")).otherwise(t)))


def drop_same(df: DataFrame, d) -> DataFrame:
    """One token that both sides of [SEP] have goes from both."""
    sep = F.array_position(tokens_(), "[SEP]").cast("int")
    own = lambda n: lambda a: F.transform(F.filter(F.arrays_zip(F.slice(tokens_(), *n(a)).alias("t"), F.slice(labels_(), *n(a)).alias("l")), lambda x: x["l"] == "O"), lambda x: x["t"])
    left, right = own(lambda a: (F.lit(1), F.greatest(a - 1, F.lit(0)))), own(lambda a: (a + 1, F.size(tokens_())))
    common = let(sep, lambda a: F.when(a > 0, F.array_sort(F.array_intersect(left(a), right(a)))).otherwise(F.array().cast("array<string>")))
    return _kept(df, lambda t, i, same: ~same.eqNullSafe(t), let(common, lambda c: _pick(c, d("same"))))


def drop_token(df: DataFrame, d) -> DataFrame:
    """A fifth of the tokens go."""
    return _kept(df, lambda t, i, _: F.pmod(d("token", i), F.lit(5)) != 0)


def insert(df: DataFrame, d) -> DataFrame:
    """A symbol is put before a token."""
    df = df.withColumn("_at", _pick(_places(F.lit(1)), d("at")))
    symbol = F.get(F.array(*map(F.lit, SYMBOLS)), F.pmod(d("symbol"), F.lit(len(SYMBOLS))).cast("int"))
    put = lambda a, x: F.concat(F.slice(a, F.lit(1), F.col("_at")), F.array(x), F.slice(a, F.col("_at") + 1, F.size(a)))
    return _set(df, F.col("_at").isNotNull(), put(tokens_(), symbol), put(labels_(), F.lit("O"))).drop("_at")


def _columns(left_only: bool) -> Column:
    """(start, end) of each column: from COL to the next COL, [SEP] or the end."""
    sep = F.coalesce(F.nullif(F.array_position(tokens_(), "[SEP]"), F.lit(0)).cast("int") - 1, F.size(tokens_()))
    starts = F.when(F.size(tokens_()) > 0, F.filter(F.sequence(F.lit(0), F.size(tokens_()) - 1), lambda i: (F.get(tokens_(), i) == "COL") & ((i < sep) if left_only else F.lit(True)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, k: F.struct(s.alias("s"), F.least(F.coalesce(F.get(starts, k + 1), F.size(tokens_())), F.when(s < sep, sep).otherwise(F.size(tokens_()))).alias("e")))


def drop_col(df: DataFrame, d) -> DataFrame:
    """A column of at most eight tokens goes."""
    df = df.withColumn("_c", _pick(F.filter(_columns(False), lambda c: c["e"] - c["s"] <= 8), d("col")))
    cut = lambda a: _without(a, F.col("_c.s"), F.col("_c.e") - F.col("_c.s"))
    return _set(df, F.col("_c").isNotNull(), cut(tokens_()), cut(labels_())).drop("_c")


def append_col(df: DataFrame, d) -> DataFrame:
    """The value of one column of the left record moves behind another one's."""
    df = df.withColumn("_cs", _columns(True)).withColumn("_i", F.pmod(d("from"), F.greatest(F.size("_cs"), F.lit(1))).cast("int")).withColumn("_j", F.pmod(F.col("_i") + 1 + F.pmod(d("to"), F.greatest(F.size("_cs") - 1, F.lit(1))), F.greatest(F.size("_cs"), F.lit(1))).cast("int"))
    part = lambda a, k: F.slice(a, F.get("_cs", k)["s"] + 1, F.get("_cs", k)["e"] - F.get("_cs", k)["s"])
    end = F.element_at("_cs", -1)["e"]

    def moved(a):
        value = F.slice(part(a, F.col("_i")), 4, F.greatest(F.size(part(a, F.col("_i"))) - 3, F.lit(0)))  # behind COL, name, VAL
        parts = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size("_cs") - 1), lambda k: k != F.col("_i")), lambda k: F.concat(part(a, k), F.when(k == F.col("_j"), value).otherwise(F.array().cast("array<string>")))))
        return F.concat(F.slice(a, F.lit(1), F.get("_cs", F.lit(0))["s"]), parts, F.slice(a, end + 1, F.size(a)))

    return _set(df, F.size("_cs") >= 2, moved(tokens_()), moved(labels_())).drop("_cs", "_i", "_j")


OPERATORS = {"del": delete, "swap": swap, "drop_len": drop_len, "drop_sym": drop_sym, "drop_same": drop_same, "drop_token": drop_token, "ins": insert, "append_col": append_col, "drop_col": drop_col}


def augment(df: DataFrame, op: str, keys: list[str], seed: int = 0) -> DataFrame:
    """Apply every operator whose name op contains, in the fixed order."""
    names = [n for n in ORDER if n in op]
    if not names:
        raise ValueError(f"unknown augmentation: {op}")
    for n in names:
        df = OPERATORS[n](df, lambda *parts, n=n: draw(F.lit(seed), F.lit(n), *map(F.col, keys), *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return df


def augment_pairs(df: DataFrame, keys: list[str], op: str = "all", seed: int = 0) -> DataFrame:
    """Texts 'left [SEP] right' augmented: sides change places for half of the rows, then op.

    all: three operators drawn with replacement, each row its own; corrupt: all four in order; cutoff: del.
    """
    sep = F.array_position(tokens_(), "[SEP]").cast("int")
    turned = lambda a: F.concat(F.slice(a, sep + 1, F.size(a)), F.slice(a, sep, F.lit(1)), F.slice(a, F.lit(1), sep - 1))
    df = _set(df, (sep > 0) & (F.pmod(draw(F.lit(seed), F.lit("side"), *map(F.col, keys)), F.lit(2)) == 0), turned(tokens_()), turned(labels_()))
    if op == "corrupt":
        for n in ALL:
            df = augment(df, n, keys, seed)
        return df
    if op != "all":
        return augment(df, "del" if op == "cutoff" else op, keys, seed)
    for turn in range(3):
        choice = F.pmod(draw(F.lit(seed), F.lit(f"op{turn}"), *map(F.col, keys)), F.lit(len(ALL)))
        df = df.withColumn("_op", choice)
        for i, n in enumerate(ALL):
            new = augment(df.select("*", tokens_().alias("_t"), labels_().alias("_l")), n, keys, seed + turn)
            df = new.withColumns({"tokens": F.when(F.col("_op") == i, tokens_()).otherwise(F.col("_t")), "labels": F.when(F.col("_op") == i, labels_()).otherwise(F.col("_l"))}).drop("_t", "_l")
        df = df.drop("_op")
    return df
