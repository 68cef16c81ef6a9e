"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of WINDOW words of a benchmark item (an item of fewer words is one window) must be found wherever a
document holds it. Documents and items keep, of each run of w = WINDOW - k + 1 consecutive k-gram hashes, the smallest
(the last one of equals); a shared span of WINDOW words holds a whole such run, so both sides keep the same k-gram in it.
Fingerprints that a Bloom filter of the items' ones passes are joined on the hash; each match names an alignment (item,
document, diagonal), which is extended word by word over the whole item, so results are exact. Items of fewer words
than WINDOW have one fingerprint, their whole text's hash, and documents all grams of those (at most 12) lengths.

One scan of the texts; texts move only for documents that the filter passes. Nothing grows with the documents on the
driver: it gets the filter's words, at most 2 ** MAX_BITS bits.

Defined cases: null, empty and wordless texts have no words and no hits; wordless items occur nowhere; repeated rows, and
rows with null or repeated ids, get a result each; items without an id count in n_hit, but are not named; repeated items count once
by id; a text may have up to 2 ** 26 words, more than a task's memory holds as an array; an empty table of documents gives an empty result and an empty
benchmark gives zeros; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomalign.llm.common import stored, words_of

POS_BITS = 26  # of a fingerprint: the position, turned round, so that the last of equal hashes is the smallest
TOP = (1 << POS_BITS) - 1
MAX_BITS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _grams(words: Column, k: int) -> Column:
    """Hash and position of every k-gram in one long each; positions from 1."""
    value = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(words, i, k)), POS_BITS), POS_BITS).bitwiseOR(F.lit(TOP) - i.cast("long"))
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), value)).otherwise(F.array().cast("array<bigint>"))


def winnow(words: Column, window: int, k: int) -> Column:
    """Fingerprints of a text's words: the smallest k-gram of each window."""
    w = window - k + 1
    least = lambda v: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - (w - 1)), lambda j: F.array_min(F.slice(v, j, w))))
    return F.when(F.size(words) >= window, let(_grams(words, k), least)).otherwise(F.array().cast("array<bigint>"))


def _hash(print_: Column) -> Column:
    return F.shiftrightunsigned(print_, POS_BITS)


def _place(print_: Column) -> Column:
    return F.lit(TOP) - print_.bitwiseAND(F.lit(TOP))


def _probes(h: Column, bits: int) -> list[Column]:
    mask = (1 << bits) - 1
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(mask)) for s in (0, 9, 18)]


def _bloom(prints: DataFrame) -> Callable[[Column], Column]:
    """A test for hashes that passes all of prints' ones; at most 2 ** MAX_BITS bits come to the driver."""
    n = prints.select("h").distinct().count()
    bits = min(MAX_BITS, max(12, (64 * n).bit_length()))
    places = prints.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("p"))
    words = places.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("m")).collect()
    table = [0] * ((1 << bits) // 64)
    for r in words:
        table[r["w"]] = r["m"]
    filled = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        out = F.lit(True)
        for p in _probes(h, bits):
            out = out & (F.getbit(F.get(filled, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    return test


def _runs(prints: DataFrame, by: list[str]) -> DataFrame:
    """by, from, to: runs of consecutive places of equal prints."""
    own = F.row_number().over(Window.partitionBy(*by).orderBy("at"))
    return prints.withColumn("_run", F.col("at") - own).groupBy(*by, "_run").agg(F.min("at").alias("from"), F.max("at").alias("to")).drop("_run")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5, tag: Column | None = None) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, item_ids (sorted strings of the items with windows in it); and the row's tag, if it is given."""
    tests = stored(items.select(F.col(item_key).cast("string").alias("item"), words_of(F.col(item_text)).alias("iw")).where(F.size("iw") > 0).distinct().withColumn("row", F.xxhash64("item", "iw")), "items")
    short = [r[0] for r in tests.where(F.size("iw") < window).select(F.size("iw")).distinct().collect()]  # below window, so few

    def prints_of(words: Column, whole: bool) -> Column:
        own = [winnow(words, window, k)]
        for n in short:
            grams = _grams(words, n)
            own.append(F.when(F.size(words) == n, grams).otherwise(F.array().cast("array<bigint>")) if whole else grams)
        return F.concat(*own) if short else own[0]

    prints = stored(tests.select("row", F.explode(let(F.col("iw"), lambda w: prints_of(w, True))).alias("p")).select("row", _hash(F.col("p")).alias("h"), _place(F.col("p")).alias("at")), "item-prints")
    passes = _bloom(prints)

    body = F.coalesce(F.col(text), F.lit(""))
    found = let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.filter(prints_of(w, False), lambda x: passes(_hash(x))).alias("hits")))
    base = docs.select(F.col(key).alias("id"), F.lit(0).cast("long").alias("tag") if tag is None else tag.alias("tag"), body.alias("t"), found.alias("f"))
    base = base.select("id", "tag", F.col("f.n_words").alias("n_words"), F.col("f.hits").alias("hits"), F.when(F.size("f.hits") > 0, F.col("t")).alias("t"))
    base = stored(base.withColumn("doc", F.monotonically_increasing_id()), "doc-prints")  # a number of the row's own: ids may repeat or be null

    hits = base.where(F.size("hits") > 0).select("doc", F.explode("hits").alias("p")).select("doc", _hash(F.col("p")).alias("h"), _place(F.col("p")).alias("at"))
    # Runs of one fingerprint at consecutive places (repeated words) meet as runs: a pair of runs names a range of diagonals.
    met = _runs(hits, ["doc", "h"]).join(_runs(prints, ["row", "h"]).withColumnsRenamed({"from": "item_from", "to": "item_to"}), "h")
    diagonals = F.sequence((F.col("from") - F.col("item_to")).cast("int"), (F.col("to") - F.col("item_from")).cast("int"))
    lines = met.select("doc", "row", F.explode(diagonals).alias("diagonal")).distinct()
    held = tests.select("row", F.size("iw").alias("n"))
    lines = lines.join(held, "row").groupBy("doc").agg(F.collect_list(F.struct("row", "diagonal", "n")).alias("lines"))

    # Each document is cut into words once; what leaves it is a slice as long as the item, where the alignment lies.
    texts = base.where(F.col("t").isNotNull()).select("doc", "t")
    piece = lambda w: F.transform("lines", lambda x: F.struct(x["row"].alias("row"), F.greatest(x["diagonal"], F.lit(0)).alias("from"), F.greatest(-x["diagonal"], F.lit(0)).alias("skip"), F.slice(w, F.greatest(x["diagonal"], F.lit(0)) + 1, x["n"] - F.greatest(-x["diagonal"], F.lit(0))).alias("words")))
    parts = texts.join(lines, "doc").select("doc", F.explode(let(words_of(F.col("t")), piece)).alias("x")).select("doc", "x.*")
    parts = parts.join(tests, "row")
    need = F.least(F.lit(window), F.size("iw"))
    equal = F.array_join(F.zip_with("words", F.slice("iw", F.col("skip") + 1, F.size("words")), lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.length(s) - need + 1), lambda p: s.substr(p, need) == F.repeat(F.lit("1"), need))
    runs = let(equal, lambda s: F.when(F.length(s) >= need, starts(s)).otherwise(F.array().cast("array<int>")))
    spans = parts.select("doc", "item", "from", need.alias("need"), runs.alias("starts")).where(F.size("starts") > 0)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(F.col("from") + p, F.col("from") + p + F.col("need") - 1))))
    spans = stored(spans.select("doc", "item", covered.alias("places")), "spans")
    n_hit = spans.select("doc", F.explode("places").alias("p")).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    named = spans.groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    out = base.select("id", "tag", "doc", "n_words").join(n_hit, "doc", "left").join(named, "doc", "left")
    return out.select(F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), *(["tag"] if tag is not None else []))


def contaminated() -> Column:
    """A document is contaminated if a twentieth of its words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
