"""Near-duplicates by Order MinHash.

A text is the sequence of its five-word shingles, each labelled with its occurrence number in the text. A sketch keeps,
of a random order of the labelled shingles, the smallest PICK ones and joins them in text order, so two texts share a
sketch the likelier the more shingles they have in common in the same order (edit similarity). Texts that share one of
BANDS sketches are candidates; a candidate pair is verified by a banded alignment of the two shingle sequences. Their
similarity is matches / (n1 + n2 - matches), with matches the longest common subsequence: Jaccard for texts in the same
order. The band is as wide as the insertions and deletions that a similarity of `least` leaves room for, so the
alignment is exact for all pairs that reach it. At 0.8 a sketch is shared with probability about 0.5, so a pair is missed
by all 20 with probability below 1e-6.

Texts with equal word sequences are one text from the start. Candidates are worked off in two steps that together cover
all of them, whatever a bucket's size:

1. Each text of a bucket (the texts that share a sketch) is compared with one stable leader, the text that shares most
   sketches with others. Members of one group meet the same few leaders in all their buckets, so pairs grow with texts.
   Links give components.
2. All pairs of texts in different components whose buckets still hold several are candidates, but for those that their
   lengths and shared shingles rule out exactly (see _groups). So classes are the closure over all candidate pairs. Where
   these are many more than the texts, one drawn pair of each two components comes first, as long as that finds many
   links; draws change the work, not the result.

Sums by bucket and by shingle are written before they are joined back, so that adaptive execution can split the join of a
hot bucket: no task holds one.

Rows have a number of their own, so ids may repeat or be null. Defined cases: texts without words (null, empty) are equal
only if their raw texts are (null counts as empty) and have no near copies; fewer than five words are one shingle; ties
in a sketch go to the earlier shingle; repeated rows are copies; of a class the row with the smallest id stays (ids before
null, then the first row read), one row exactly; class_id is null if all its ids are; texts of more than 2 ** 24 shingles
are sketched alone, with fewer bits of the random order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomalign.llm.common import slices_by_bytes, stored, tidy

BANDS, PICK, SHINGLE = 20, 3, 5
_C1, _C2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
WORTH = 4  # pairs a text that step 2 may leave (counted once for each shingle through which they meet); while there are more, draws come first
PAYS = 8  # a turn of draws is followed by another if one pair in so many is a link
BLOCK = 1024  # texts of one shingle that meet in one group


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_C2)
    return x ^ (x >> np.uint64(32))


def word_hashes(data, edges):
    """64-bit hashes of the words in a buffer of UTF-8 texts (lower-cased A-Z), and the number of words of each text.

    data: uint8 array; edges: offsets of the texts. A word is a run of ASCII letters, digits and non-ASCII bytes.
    """
    import numpy as np

    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    inside = table[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = edges[(edges > 0) & (edges < len(data))]
    begin[cut] = inside[cut]  # a text's end ends a word
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    inside_n = np.searchsorted(starts, edges)
    if not len(starts):
        return np.zeros(0, np.uint64), np.diff(inside_n)
    power = np.full(len(data), 0x100000001B3, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    inverse = np.full(len(starts), pow(0x100000001B3, -1, 1 << 64), np.uint64)
    gaps = np.diff(starts, prepend=0)
    # the inverse power of each start: powers of the inverse of the gaps, multiplied up
    step, base = np.ones(len(starts), np.uint64), inverse.copy()
    left = gaps.astype(np.int64)
    while left.any():
        step = np.where(left & 1, step * base, step)
        base = base * base
        left >>= 1
    return _mix((total[ends] - total[starts]) * np.multiply.accumulate(step) + (ends - starts).astype(np.uint64) * np.uint64(_C1)), np.diff(inside_n)


def shingles(words, counts, k: int = SHINGLE):
    """Shingle hashes of all texts one after the other, and their number for each text."""
    import numpy as np

    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, np.uint64), n
    odd = [np.uint64((_C1 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for j in range(k)]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    value = sum(padded[j : j + len(words)] * odd[j] for j in range(k))
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    for i in short.tolist():
        value[first[i]] = (words[first[i] : first[i] + counts[i]] * np.array(odd[: counts[i]])).sum(dtype=np.uint64) ^ np.uint64(counts[i])
    at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return _mix(value[at]), n


def labelled(values, counts):
    """Shingles made distinct by their occurrence number in the text."""
    import numpy as np

    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = values ^ _mix((doc + np.uint64(1)) * np.uint64(_C1))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    if not same.any():
        return values
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = values.copy()
    out[order] = _mix(values[order] + run.astype(np.uint64) * np.uint64(_C1 | 1)) * same + values[order] * ~same
    return out


def sketches(values, counts, bands: int = BANDS, pick: int = PICK):
    """A band key for each text with shingles and each band: (texts, bands) of int64. values: labelled shingles."""
    import numpy as np

    starts = (np.cumsum(counts) - counts).astype(np.int64)
    places = (1 << max(24, int(counts.max()).bit_length())) - 1  # the low bits hold the position
    position = (np.arange(len(values)) - np.repeat(starts, counts)).astype(np.uint64)
    out, top = np.empty((len(counts), bands), np.int64), np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(bands):
        y = _mix((values ^ np.uint64((b + 1) * _C1 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(_C1))
        y = (y & ~np.uint64(places)) | position
        found = np.empty((len(counts), pick), np.int64)
        for p in range(pick):
            at = (np.minimum.reduceat(y, starts) & np.uint64(places)).astype(np.int64)
            gone = counts <= p  # fewer shingles than picks
            found[:, p] = np.where(gone, places + 1 + p, at)
            y[starts[~gone] + at[~gone]] = top
        found.sort(axis=1)
        key = np.full(len(counts), (b + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for p in range(pick):
            real = found[:, p] <= places
            key = _mix((key ^ np.where(real, values[starts + np.where(real, found[:, p], 0)], np.uint64(7))) * np.uint64(_C1))
        out[:, b] = key.view(np.int64)
    return out


def read_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tag: Column | None = None) -> DataFrame:
    """(row, id, tag, digest of the word sequence, n shingles, band keys, shingles as 32-bit integers) of every row, stored."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        for batch in batches:
            for s in slices_by_bytes(batch, "_t", 1 << 19):
                raw = pc.fill_null(s.column("_t").cast(pa.large_string()), "")
                edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data = lower[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]]
                words, count = word_hashes(data, edges - edges[0])
                value, n = shingles(words, count)
                first, at = (np.cumsum(count) - count).tolist(), (np.cumsum(n) - n).tolist()
                some = n > 0
                keys = np.zeros((len(n), BANDS), np.int64)
                if some.any():
                    keys[some] = sketches(labelled(value, n), n[some])
                low = value.astype("<u4")
                digest = [hashlib.blake2b(words[a : a + c].tobytes(), digest_size=16).digest() if c else b"\0" + hashlib.sha256(raw[i].as_py().encode()).digest()[:15] for i, (a, c) in enumerate(zip(first, count.tolist(), strict=True))]
                yield pa.record_batch(
                    [s.column("_id"), s.column("_g"), pa.array(digest, pa.binary()), pa.array(n.astype(np.int64)), pa.array([k if x else [] for k, x in zip(keys.tolist(), some.tolist(), strict=True)], pa.list_(pa.int64())), pa.array([low[a : a + c].tobytes() for a, c in zip(at, n.tolist(), strict=True)], pa.binary())],
                    names=["id", "tag", "digest", "n", "bands", "shingles"],
                )
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("_id"), F.lit(0).cast("long").alias("_g") if tag is None else tag.alias("_g"), F.col(text).alias("_t"))
    read = rows.mapInArrow(run, "id long, tag long, digest binary, n long, bands array<long>, shingles binary")
    return stored(read.withColumn("row", F.monotonically_increasing_id()), "omh-texts")


def alignment(a, b, least: float) -> float:
    """Similarity of two shingle sequences by banded alignment; 0 if it is below least."""
    import math

    import numpy as np

    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return 0.0
    need = math.ceil(round(least * (n1 + n2) / (1 + least), 9))  # matches that least asks for
    room = n1 + n2 - 2 * need  # insertions and deletions
    if min(n1, n2) < need:
        return 0.0
    n = min(n1, n2)
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    done = head + tail
    if len(a) and len(b):
        x, c = np.unique(a, return_counts=True)
        y, d = np.unique(b, return_counts=True)
        _, i, k = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if done + int(np.minimum(c[i], d[k]).sum()) < need:
            return 0.0
        # Bit-parallel longest common subsequence; matches outside the band do not count.
        where: dict[int, int] = {}
        for i, s in enumerate(a.tolist()):
            where[s] = where.get(s, 0) | 1 << i
        full = (1 << len(a)) - 1
        v, band = full, (1 << (2 * room + 1)) - 1
        for j, s in enumerate(b.tolist()):
            m = where.get(s, 0)
            if m:
                m &= band << (j - room) if j >= room else band >> (room - j)
                u = v & m
                v = ((v + u) | (v - u)) & full
        done += len(a) - v.bit_count()
    return done / (n1 + n2 - done) if done >= need else 0.0


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches least."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column("sa"), batch.column("sb")
            found = [alignment(np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4"), least) for p, q in zip(x, y, strict=True)]
            keep = np.flatnonzero(found)
            yield pa.record_batch([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], names=["a", "b"])

    side = lambda c: texts.select(F.col("row").alias(c), F.col("shingles").alias(f"s{c}"))
    # The right side's texts are joined first, so that a leader's text is put beside each of its pairs only at the end.
    return pairs.hint("merge").join(side("b"), "b").hint("merge").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(row, part) of every linked row: the smallest row of its component. Min-label propagation with pointer jumping; each round is a written table."""
    both = stored(links.union(links.select(F.col("b"), F.col("a"))).toDF("a", "b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("part")).withColumnRenamed("a", "row"), "labels")
    while True:
        near = both.join(labels.select(F.col("row").alias("b"), F.col("part").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        new = labels.join(near, F.col("row") == F.col("a")).select("row", F.least("part", "other").alias("part"), F.col("part").alias("was"))
        up = labels.select(F.col("row").alias("p"), F.col("part").alias("up"))  # the last round's, which is written
        new = stored(new.join(up, F.col("part") == F.col("p")).select("row", F.least("part", "up").alias("part"), "was"), "labels")
        if new.where("part != was").isEmpty():
            return new.select("row", "part")
        labels = new.select("row", "part")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (row, part) after more links: components of the linked parts only, which are far fewer than the links so far."""
    part = lambda c: labels.select(F.col("row").alias(c), F.col("part").alias(f"p{c}"))
    between = links.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    between = stored(between.where("a != b").distinct(), "omh-between")
    if between.isEmpty():
        return labels
    more = components(between)
    old = labels.join(more.select(F.col("row").alias("part"), F.col("part").alias("to")), "part", "left").select("row", F.coalesce("to", "part").alias("part"))
    return stored(old.unionByName(more.join(labels.select("row"), "row", "left_anti")), "labels")


def _pairs(entries: DataFrame, lead: Column, least: float) -> DataFrame:
    """Pairs of a bucket's leader and its entries. entries: band, row, n, part (its component); lead: the leader's order, largest first.

    Entries of the leader's own component are not compared; the lengths must allow the similarity.
    """
    leaders = entries.groupBy("band").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.max_by(F.struct("row", "n", "part"), lead).alias("l")).where("p0 != p1").select("band", "l")
    leaders = stored(leaders, "omh-leaders")
    met = entries.join(leaders, "band").where((F.col("part") != F.col("l.part")) & (F.least("n", "l.n") >= least * F.greatest("n", "l.n")))
    return met.select(F.least("row", "l.row").alias("a"), F.greatest("row", "l.row").alias("b")).distinct()


def _groups(entries: DataFrame, texts: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Groups (i, j, xs) in which all pairs of different components meet that can reach least, of the texts whose buckets still hold several components.

    entries: band, row, n, part. Shingles are made distinct by their occurrence number, so what two texts share is at most
    the number of labelled shingles they share, and that has to reach least * (n1 + n2) / (1 + least). Labelled shingles
    have one order: those of a single component first, then the rarer first. Two texts that reach least share one of the
    first n - least * n + 1 of each, and no more lies behind the first shared one than both have left: an exact
    prefilter by shingle counts. The texts of one shingle meet in groups of about two blocks, whatever their number.
    """

    def units(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for s in slices_by_bytes(batch, "shingles", 1 << 20):
                n = s.column("n").to_numpy()
                values = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in s.column("shingles")]).astype(np.uint64)
                yield pa.record_batch([pa.array(np.repeat(s.column(c).to_numpy(), n)) for c in ("row", "part")] + [pa.array(labelled(values, n).view(np.int64))], names=["row", "part", "h"])

    mixed = entries.groupBy("band").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 != p1").select("band")
    mixed = stored(mixed, "omh-mixed")
    loose = entries.hint("merge").join(mixed, "band").select("row", "n", "part").distinct()
    loose = stored(loose.hint("merge").join(texts, "row").select("row", "n", "part", "shingles"), "omh-loose")
    tokens = loose.mapInArrow(units, "row long, part long, h long")
    common = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 != p1").select("h", "c")
    common = stored(common, "omh-common")
    shared = tokens.select("row", "h").hint("merge").join(common, "h").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    own = shared.join(loose.select("row", "n", "part"), "row")
    first = F.col("n") - F.size("s")  # the place of a text's first shingle that other components have as well
    width = F.col("n") - F.ceil(F.round(least * F.col("n"), 9)) + 1 - first
    heads = own.where(width > 0).select("row", "n", "part", first.alias("first"), F.posexplode(F.slice("s", F.lit(1), width.cast("int"))).alias("k", "e"))
    heads = heads.select("e.h", F.struct("row", "n", "part", (F.col("n") - F.col("first") - F.col("k")).alias("rest"), F.pmod(F.xxhash64("row"), F.ceil(F.col("e.c") / block)).alias("salt")).alias("x"), (F.ceil(F.col("e.c") / block) - 1).alias("last"))
    cells = heads.select("h", "x", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    groups = cells.groupBy("h", F.least("x.salt", "other").alias("i"), F.greatest("x.salt", "other").alias("j")).agg(F.min("x.part").alias("p0"), F.max("x.part").alias("p1"), F.collect_list("x").alias("xs")).where("p0 != p1")
    return stored(groups.select("i", "j", "xs"), "omh-groups")


def _meet(groups: DataFrame, least: float, turn: int | None = None) -> DataFrame:
    """The pairs (a, b) of _groups that lengths and shingle places allow: tested where they meet, so only those that pass leave a task.

    turn: one of them for each two components only, drawn anew every turn, with their number (n, counted once for each
    shingle through which they meet).
    """

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("xs")
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            row, n, part, rest, salt = (x.to_numpy() for x in lists.flatten().flatten())
            apart = np.repeat((batch.column("i").to_numpy() != batch.column("j").to_numpy()), size)
            end = np.repeat(np.cumsum(size), size)
            later = end - np.arange(len(row)) - 1  # members of the group behind each
            until = np.cumsum(later)
            at = 0
            while at < len(row):  # some hundred thousand pairs at a time, which bounds memory
                to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + (1 << 18), "right")))
                k = later[at:to]
                a = np.repeat(np.arange(at, to), k)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
                keep = (part[a] != part[b]) & ((salt[a] != salt[b]) | ~apart[a])  # pairs inside a block meet in its own group
                a, b = a[keep], b[keep]
                total = n[a] + n[b]
                need = np.ceil(np.round(least * total / (1 + least), 9))
                keep = np.minimum(np.minimum(n[a], n[b]), np.minimum(rest[a], rest[b])) >= need
                a, b = a[keep], b[keep]
                at = to
                if not len(a):
                    continue
                swap = row[a] > row[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                if turn is None:
                    pairs = np.unique(np.stack([row[a], row[b]], 1), axis=0)
                    yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                    continue
                drawn = _mix(row[a].astype(np.uint64) * np.uint64(_C1) + row[b].astype(np.uint64) * np.uint64(_C2) + np.uint64(turn)).view(np.int64)
                low, high = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
                order = np.lexsort((drawn, high, low))
                low, high, a, b, drawn = low[order], high[order], a[order], b[order], drawn[order]
                first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
                yield pa.record_batch([pa.array(x) for x in (low[first], high[first], drawn[first], row[a[first]], row[b[first]], np.diff(first, append=len(a)))], names=["low", "high", "drawn", "a", "b", "n"])

    if turn is None:
        return groups.mapInArrow(meet, "a long, b long").distinct()
    found = groups.mapInArrow(meet, "low long, high long, drawn long, a long, b long, n long")
    return found.groupBy("low", "high").agg(F.min_by(F.struct("a", "b"), "drawn").alias("p"), F.sum("n").alias("n")).select("p.a", "p.b", "n")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, tag: Column | None = None) -> DataFrame:
    """One row per row of docs: key, class_id (the smallest id of its class), class_size, n_texts (different texts in the class), kept; tag, if it is given, a long of the row's own."""
    spark = docs.sparkSession
    texts = read_texts(docs, key, text, tag)
    first = F.struct(F.col("id").isNull(), "id", "row")  # the order in which rows of a class stay
    groups = stored(texts.groupBy("digest").agg(F.min("row").alias("row"), F.min(first).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "omh-groups")
    entries = texts.select("row", "n", "bands").hint("merge").join(groups.select("row"), "row", "left_semi").select("row", "n", F.explode("bands").alias("band"))
    sizes = stored(entries.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "omh-sizes")
    entries = stored(entries.hint("merge").join(sizes, "band"), "omh-entries")
    weight = stored(entries.groupBy("row").agg(F.sum("c").alias("weight")), "omh-weight")
    # Only texts that share a sketch can be compared. Their rows grow with the input, so they are never broadcast.
    compared = stored(texts.select("row", "shingles").hint("merge").join(weight.select("row"), "row", "left_semi"), "omh-compared")

    labels = spark.createDataFrame([], "row long, part long")
    named = lambda: entries.hint("merge").join(labels, "row", "left").withColumn("part", F.coalesce("part", "row"))
    alone = entries.hint("merge").join(weight, "row").withColumn("part", F.col("row"))
    found = stored(verify(stored(_pairs(alone, F.struct("weight", -F.col("row")), least), "omh-pairs"), compared, least), "omh-links")
    if not found.isEmpty():
        labels = components(found)
    left, turn = _groups(named(), compared, least), 0
    while True:
        met = stored(_meet(left, least, turn), "omh-met")
        if (met.agg(F.sum("n")).first()[0] or 0) <= WORTH * weight.count():
            break
        # Many pairs of the same components: one of each two is aligned, which mostly makes them one.
        found = stored(verify(met.select("a", "b"), compared, least), "omh-links")
        if found.count() * PAYS < met.count():
            break
        labels, turn = merged(labels, found), turn + 1
        left = _groups(named(), compared, least)
    found = stored(verify(stored(_meet(left, least), "omh-rest"), compared, least), "omh-links")
    labels = merged(labels, found)
    own = groups.join(labels, "row", "left").withColumn("part", F.coalesce("part", "row"))
    classes = stored(own.groupBy("part").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n_texts"), F.min("first").alias("stays")), "omh-classes")
    named = own.select("digest", "part").join(classes, "part").select("digest", "class_size", "n_texts", F.col("stays.id").alias("class_id"), F.col("stays.row").alias("_stays"))
    out = texts.select("id", "tag", "row", "digest").join(named, "digest")
    return out.select(F.col("id").alias(key), "class_id", "class_size", "n_texts", (F.col("row") == F.col("_stays")).alias("kept"), *(["tag"] if tag is not None else []))
