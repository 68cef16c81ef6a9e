"""Exact deduplication over a cuckoo-filter index of live digests.

The index has B buckets by digest. A bucket holds a cuckoo filter (16-bit fingerprints, 4 slots a cell) and, beside it,
the stored keys: full SHA-256 digest, byte length, the row that stays and the number of live rows. A filter miss is a
new digest for certain; a hit is verified against the bucket's stored keys; an insertion that finds no place makes the
filter twice as large and refills it from the stored keys. Deletion lowers the live count and removes the fingerprint
when no live row is left; where the row that stays is deleted, the smallest of the rows still live takes its place.
Buckets are as many as keep each near BUCKET_ROWS rows, whatever the input's size.

Defined cases: null text counts as empty, so null and empty rows form one group; of equal texts the smallest id stays;
ids may be null (they come after all others) or repeat; repeated rows count each, and `kept` holds for every row with the id
that stays; a text of any length is one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomalign.llm.common import shuffle_width, stored

SLOTS, KICKS = 4, 200
BUCKET_ROWS = 100_000
NO_ID = (1 << 63) - 1  # a null id in the index: after all others
INDEX_SCHEMA = "bucket int, keys binary, lengths binary, keep binary, live binary, cells binary, grown int"


class CuckooFilter:
    """Partial-key cuckoo filter; cells is a flat list with SLOTS places a cell, 0 is an empty place."""

    def __init__(self, n: int = 16, cells: list[int] | None = None):
        size = 1
        while size * SLOTS * 0.9 < n or size < 4:
            size *= 2
        self.cells = cells if cells is not None else [0] * (size * SLOTS)
        self.mask = len(self.cells) // SLOTS - 1
        self.turn = 1

    @staticmethod
    def mark(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:2], "little") or 1, int.from_bytes(digest[8:16], "little")

    def other(self, cell: int, mark: int) -> int:
        return (cell ^ (mark * 0x5BD1E995)) & self.mask

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark, h = self.mark(digest)
        one = h & self.mask
        return mark, one, self.other(one, mark)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.cells[a * SLOTS : a * SLOTS + SLOTS] or mark in self.cells[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, cell: int, mark: int) -> bool:
        for k in range(cell * SLOTS, cell * SLOTS + SLOTS):
            if not self.cells[k]:
                self.cells[k] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False: it overflowed; the filter then lacks one fingerprint and has to be rebuilt from the stored keys."""
        mark, a, b = self.places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        cell = b
        for _ in range(KICKS):
            self.turn = (self.turn * 1103515245 + 12345) & 0x7FFFFFFF
            k = cell * SLOTS + (self.turn >> 16) % SLOTS
            mark, self.cells[k] = self.cells[k], mark
            cell = self.other(cell, mark)
            if self._put(cell, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for cell in (a, b):
            for k in range(cell * SLOTS, cell * SLOTS + SLOTS):
                if self.cells[k] == mark:
                    self.cells[k] = 0
                    return True
        return False


class Bucket:
    """One bucket of the index: the filter and the stored keys that hits are verified against."""

    def __init__(self):
        self.filter, self.keys, self.grown, self.false_hits = CuckooFilter(), {}, 0, 0

    def insert(self, digest: bytes, length: int, row: int, n: int = 1) -> None:
        key = (digest, length)
        if digest in self.filter:
            if (old := self.keys.get(key)) is not None:  # verified
                self.keys[key] = (min(old[0], row), old[1] + n)
                return
            self.false_hits += 1
        self.keys[key] = (row, n)
        if not self.filter.insert(digest):
            self._grow()

    def _grow(self) -> None:
        size = 2 * len(self.filter.cells)
        while True:
            self.grown += 1
            self.filter = CuckooFilter(cells=[0] * size)
            if all(self.filter.insert(d) for d, _ in self.keys):
                return
            size *= 2

    def delete(self, digest: bytes, length: int, n: int = 1) -> bool:
        """False if there is no such key. The row that stays is set anew by heir(), if it is among the deleted ones."""
        key = (digest, length)
        if digest not in self.filter or key not in self.keys:
            return False
        row, live = self.keys[key]
        if live > n:
            self.keys[key] = (row, live - n)
        else:
            del self.keys[key]
            self.filter.delete(digest)
        return True

    def heir(self, digest: bytes, length: int, row: int) -> None:
        """The smallest row that is still live."""
        if (old := self.keys.get((digest, length))) is not None:
            self.keys[digest, length] = (row, old[1])

    def pack(self) -> dict:
        import numpy as np

        keys = sorted(self.keys)
        return {"keys": b"".join(d for d, _ in keys), "lengths": np.array([x for _, x in keys], "<i8").tobytes(), "keep": np.array([self.keys[k][0] for k in keys], "<i8").tobytes(), "live": np.array([self.keys[k][1] for k in keys], "<i8").tobytes(), "cells": np.array(self.filter.cells, "<u2").tobytes(), "grown": self.grown}

    @classmethod
    def unpack(cls, row: dict) -> Bucket:
        import numpy as np

        out = cls()
        n = [np.frombuffer(row[k], "<i8").tolist() for k in ("lengths", "keep", "live")]
        out.keys = {(row["keys"][32 * i : 32 * i + 32], a): (b, c) for i, (a, b, c) in enumerate(zip(*n, strict=True))}
        out.filter, out.grown = CuckooFilter(cells=np.frombuffer(row["cells"], "<u2").tolist()), row["grown"]
        return out


def normalised(text: Column) -> Column:
    """Texts that agree in this are equal: each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", tag: Column | None = None) -> DataFrame:
    """(id, digest in hex, bytes) of every row, without the text; and the row's tag, if it is given."""
    t = normalised(F.col(text))
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_id"), t.alias("_t"), *([tag.alias("_g")] if tag is not None else []))
    return own.select("_id", F.sha2("_t", 256).alias("_d"), F.octet_length("_t").cast("long").alias("_n"), *(["_g"] if tag is not None else []))


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 25, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def gathered(rows: DataFrame) -> DataFrame:
    """Per task and digest one row with the smallest id and the count: what is dealt out grows with tasks, not with copies."""

    def run(batches):
        import pyarrow as pa

        seen: dict[tuple, list] = {}
        kind = pa.schema([("_d", pa.string()), ("_n", pa.int64()), ("_id", pa.int64()), ("_c", pa.int64())])

        def out():
            k = list(seen)
            return pa.record_batch([pa.array([d for d, _ in k]), pa.array([n for _, n in k], pa.int64()), pa.array([seen[x][0] for x in k], pa.int64()), pa.array([seen[x][1] for x in k], pa.int64())], schema=kind)

        for b in batches:
            for i, d, n in zip(*(b.column(c).to_pylist() for c in ("_id", "_d", "_n")), strict=True):
                if (x := seen.get((d, n))) is None:
                    seen[d, n] = [i, 1]
                else:
                    x[0], x[1] = min(x[0], i), x[1] + 1
            if len(seen) >= 200_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return rows.mapInArrow(run, "_d string, _n long, _id long, _c long")


def update_index(rows: DataFrame, index: DataFrame | None = None, removed: DataFrame | None = None, live: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The index after inserting rows and then deleting removed (all from digests()); INDEX_SCHEMA, one row a bucket.

    live: digests() of all rows that are left; needed with removed, to find the next row to stay. buckets must stay the
    same over an index's life (default: by the number of rows; choose it for the size that the index will have).
    """
    if removed is not None and live is None:
        raise ValueError("rows can be removed only if the rows that are left are given")
    buckets = buckets or max(shuffle_width(rows.sparkSession), rows.count() // BUCKET_ROWS + 1)
    add = gathered(rows)
    if removed is not None:
        add = add.unionByName(gathered(removed).withColumn("_c", -F.col("_c")))
        left = live.join(removed.select("_d", "_n").distinct(), ["_d", "_n"], "left_semi").groupBy("_d", "_n").agg(F.min("_id").alias("_id"))
        add = add.unionByName(left.withColumn("_c", F.lit(0).cast("long")))
    add = add.withColumn("bucket", bucket_of(F.col("_d"), buckets))

    def merge(state, changes):
        import pandas as pd

        b = Bucket.unpack(state) if state else Bucket()
        for d, n, i, c in sorted(changes, key=lambda x: ((1, -1, 0).index((x[3] > 0) - (x[3] < 0)), x[2])):
            if c > 0:
                b.insert(bytes.fromhex(d), n, i, c)
            elif c < 0:
                b.delete(bytes.fromhex(d), n, -c)
            else:
                b.heir(bytes.fromhex(d), n, i)
        return pd.DataFrame([b.pack()])

    def fresh(key, new):
        out = merge(None, new[["_d", "_n", "_id", "_c"]].itertuples(index=False, name=None))
        out.insert(0, "bucket", key[0])
        return out

    def both(key, old, new):
        out = merge(old.iloc[0].to_dict() if len(old) else None, new[["_d", "_n", "_id", "_c"]].itertuples(index=False, name=None))
        out.insert(0, "bucket", key[0])
        return out

    if index is None:
        return add.groupBy("bucket").applyInPandas(fresh, INDEX_SCHEMA)
    return index.groupBy("bucket").cogroup(add.groupBy("bucket")).applyInPandas(both, INDEX_SCHEMA)


def index_keys(index: DataFrame) -> DataFrame:
    """(digest, bytes, row that stays, live rows) of every stored key."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                n = [np.frombuffer(row[k], "<i8") for k in ("lengths", "keep", "live")]
                hexes = row["keys"].hex()
                yield pa.record_batch([pa.array([hexes[64 * i : 64 * i + 64] for i in range(len(n[0]))], pa.string()), *[pa.array(x, pa.int64()) for x in n]], names=["_d", "_n", "_keep", "_live"])

    return index.mapInArrow(run, "_d string, _n long, _keep long, _live long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DataFrame | None = None, buckets: int | None = None, tag: Column | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256; and the row's tag, if it is given. The join on the digest is split by adaptive execution where a digest is hot."""
    rows = stored(digests(docs, key, text, tag), "digests")
    found = index_keys(update_index(rows.select("_id", "_d", "_n"), index, buckets=buckets))
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = rows.join(found, ["_d", "_n"])
    return out.select(id_of("_id").alias(key), id_of("_keep").alias("keep_id"), F.col("_live").alias("group_size"), (F.col("_id") == F.col("_keep")).alias("kept"), F.col("_d").alias("text_sha256"), *([F.col("_g").alias("tag")] if tag is not None else []))
