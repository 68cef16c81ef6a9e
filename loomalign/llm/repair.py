"""Token ids in Re-Pair compressed shard files with random access.

A shard file holds the grammar (rules left, right, and the length each nonterminal expands to), an index of documents,
and the compressed symbols. A rule replaces a frequent pair of symbols by a new one; pairs are counted over the whole
shard. A round replaces together all pairs that are at least a sixteenth as frequent as the most frequent one, from left
to right; rounds go on until no pair occurs `least` times. No pair crosses a document's end, so a document, or a range
of its tokens, is decoded without the rest: a reader takes the header, the grammar and the index, then the symbols of
the documents asked for, by ranged reads.

Layout (little-endian): magic RPG1, u4 base, u4 rules, u4 documents, u8 symbols, u1 symbol width; rules as u4 left,
u4 right; expansion lengths u4; document ids i8, first symbols u8, token counts u4; the symbols. Symbols take two bytes
while all of them, nonterminals included, fit.

Defined cases: a null or empty text has the end id alone; a null document id is written as the smallest long; repeated
rows are kept each; equal ids keep the order that the sort gives; a text of any length lies in one shard; an empty table
gives an empty result and no files; other columns are ignored.
"""

from __future__ import annotations

import struct
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomalign.llm.common import file_store, put_file, shuffle_width, slices_by_bytes, stored, tokenizer

HEAD = struct.Struct("<4sIIIQB")
NO_ID = -(1 << 63)


def compress(ids, ends, base: int, least: int = 64, fall: int = 16, width: int = 20):
    """(symbols, rules, first symbol of each document). ids: integer array; ends: index after each document's last id.

    No pair with least occurrences (overlapping ones included) is left, but for pairs of one symbol with itself, of
    which every second place counts. Hashed cells of 2 ** width only bound counts from above; what is chosen is counted exactly.
    """
    import numpy as np

    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[np.asarray(ends) - 1] = True
    rules, size, floor = [np.zeros((0, 2), np.int64)], 0, 1 << 62
    while len(s) > 1:
        h = s[:-1] * np.uint32(0x9E3779B1) + s[1:] * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - width)
        h[last[:-1]] = 1 << width  # no pair over a document's end
        n = np.bincount(h, minlength=(1 << width) + 1)
        n[-1] = 0
        floor = max(least, min(floor, int(n.max()) // fall))
        at = np.flatnonzero((n >= floor)[h])
        pairs, which = np.unique((s[at].astype(np.uint64) << np.uint64(32)) | s[at + 1], return_inverse=True)
        start = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(which, prepend=-1) != 0))  # of runs of one pair
        rank = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
        count = np.bincount(which[rank % 2 == 0], minlength=len(pairs))
        best = np.flatnonzero(count >= floor)
        if not len(best):
            if floor == least:
                break
            floor //= fall
            continue
        best = best[np.argsort(-count[best], kind="stable")]
        number = np.full(len(pairs), -1, np.int64)
        number[best] = base + size + np.arange(len(best))
        new = number[which]
        at, new = at[new >= 0], new[new >= 0]
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of runs of pairs that overlap: every second one is taken
        rank = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
        at, new = at[rank % 2 == 0], new[rank % 2 == 0]
        rules.append(np.stack([pairs[best] >> np.uint64(32), pairs[best] & np.uint64(0xFFFFFFFF)], 1).astype(np.int64))
        size += len(best)
        s[at] = new
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, last = s[keep], last[keep]
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(s) else np.zeros(0, np.int64)
    return s, np.concatenate(rules), first


def expansions(rules, base: int):
    """Length of each nonterminal's expansion. A rule names earlier symbols only."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return out


def shard_bytes(ids, doc_ids, counts, base: int) -> tuple[bytes, int]:
    """A shard file, and the number of its rules."""
    import numpy as np

    counts = np.asarray(counts, np.int64)
    symbols, rules, first = compress(ids, np.cumsum(counts), base)
    wide = 2 if base + len(rules) <= 1 << 16 else 4
    return b"".join([HEAD.pack(b"RPG1", base, len(rules), len(counts), len(symbols), wide), rules.astype("<u4").tobytes(), np.array(expansions(rules, base), "<u4").tobytes(), np.asarray(doc_ids, "<i8").tobytes(), first.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), symbols.astype(f"<u{wide}").tobytes()]), len(rules)


class Shard:
    """Random access to the documents of a shard file by ranged reads: read_at(offset, length) -> bytes."""

    def __init__(self, read_at):
        import numpy as np

        magic, self.base, r, d, n, self.wide = HEAD.unpack(read_at(0, HEAD.size))
        if magic != b"RPG1":
            raise ValueError("not a shard file")
        at, data = 0, read_at(HEAD.size, 12 * r + 20 * d)

        def array(kind: str, size: int):
            nonlocal at
            out = np.frombuffer(data, kind, size, at)
            at += out.nbytes
            return out

        self.rules = array("<u4", 2 * r).reshape(r, 2).astype(np.int64)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), array("<u4", r).astype(np.int64)])
        self.doc_ids, self.first, self.counts = array("<i8", d), np.append(array("<u8", d).astype(np.int64), n), array("<u4", d)
        self.read_at, self.begin = read_at, HEAD.size + len(data)

    def symbols(self, i: int, j: int):
        """Symbols of documents i to j, j exclusive: one ranged read."""
        import numpy as np

        a, b = int(self.first[i]), int(self.first[j])
        return np.frombuffer(self.read_at(self.begin + a * self.wide, (b - a) * self.wide), f"<u{self.wide}").astype(np.int64)

    def expand(self, symbols):
        """Ids of some symbols: nonterminals are opened, all at once, until none is left."""
        import numpy as np

        while (open_ := symbols >= self.base).any():
            n = 1 + open_
            end = np.cumsum(n)
            out = np.empty(int(end[-1]), np.int64)
            out[end[~open_] - 1] = symbols[~open_]
            rules = self.rules[symbols[open_] - self.base]
            out[end[open_] - 2], out[end[open_] - 1] = rules[:, 0], rules[:, 1]
            symbols = out
        return symbols.astype("<u4")

    @cached_property
    def table(self):
        """All nonterminals' expansions, one after the other, and where each begins; for reading whole files."""
        import numpy as np

        flat = self.expand(np.arange(self.base, self.base + len(self.rules)))
        return np.concatenate([np.arange(self.base, dtype=np.uint32), flat]), np.cumsum(self.lengths) - self.lengths

    def documents(self, i: int, j: int):
        """The ids of each document from i to j, j exclusive."""
        import numpy as np

        flat, at = self.table
        symbols = self.symbols(i, j)
        n = self.lengths[symbols]
        ids = flat[np.arange(int(n.sum())) + np.repeat(at[symbols] - (np.cumsum(n) - n), n)]
        return np.split(ids, np.cumsum(self.counts[i:j].astype(np.int64))[:-1])

    def tokens(self, i: int, start: int, stop: int):
        """Tokens start to stop of document i; only the symbols that cover them are expanded."""
        import numpy as np

        own = self.symbols(i, i + 1)
        until = np.cumsum(self.lengths[own])
        a, b = np.searchsorted(until, start, "right"), np.searchsorted(until, stop, "left") + 1
        skip = start - (int(until[a - 1]) if a else 0)
        return self.expand(own[a:b])[skip : skip + stop - start]


def write_shards(docs: DataFrame, folder: str, path: str, mode: str = "drop", end: int = 1, vocabulary: int = 49408, shard_tokens: int = 3_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode docs in ascending order of key into shard files under folder (a place that all executors share).

    Returns the manifest (part, seq, file, n_docs, n_tokens, n_bytes, n_rules), already computed and stored. A partition's
    rows stream through; a file is closed at shard_tokens, which bounds memory.
    """
    spark = docs.sparkSession

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, tok = TaskContext.get().partitionId(), 0, tokenizer(path, mode)
        ids, names, counts, held = [], [], [], 0

        def close():
            data, rules = shard_bytes(np.concatenate(ids), [NO_ID if x is None else x for x in names], counts, vocabulary)
            file = put_file(folder, f"shard-{part:06d}-{seq:05d}.rpg", data)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([file]), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([rules], pa.int64())], names=["part", "seq", "file", "n_docs", "n_tokens", "n_bytes", "n_rules"])

        for batch in batches:
            for s in slices_by_bytes(batch, "_t"):
                own, n = tok.encode_arrow(s.column("_t"), end)
                until = np.cumsum(n)
                for name, a, b in zip(s.column("_id").to_pylist(), (until - n).tolist(), until.tolist(), strict=True):
                    ids.append(own[a:b])
                    names.append(name)
                    counts.append(b - a)
                    held += b - a
                    if held >= shard_tokens:
                        yield close()
                        ids, names, counts, held, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"))
    rows = rows.repartitionByRange(shuffle_width(spark), "_id").sortWithinPartitions("_id")
    return stored(rows.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long, n_rules long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (tokens before it in all files), n_tokens, ids (little-endian u4)."""
    files = manifest.select("part", "seq", "file", "n_tokens")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a partition of the writer
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = files.withColumn("own", own).join(before, "part").select("file", (F.col("before") + F.col("own")).alias("begin"))
    tasks = max(1, min(manifest.count(), 4 * shuffle_width(manifest.sparkSession)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                store, where = file_store(file)
                with store.open_input_file(where) as f:
                    shard = Shard(lambda a, n, f=f: f.read_at(n, a))
                    begin = at + np.cumsum(shard.counts.astype(np.int64)) - shard.counts
                    for a in range(0, len(shard.doc_ids), 256):
                        b = min(a + 256, len(shard.doc_ids))
                        ids = pa.array([x.astype("<u4").tobytes() for x in shard.documents(a, b)], pa.binary())
                        yield pa.record_batch([pa.array(shard.doc_ids[a:b], mask=shard.doc_ids[a:b] == NO_ID), pa.array(begin[a:b].astype(np.int64)), pa.array(shard.counts[a:b].astype(np.int64)), ids], names=["doc_id", "start", "n_tokens", "ids"])

    return starts.repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
