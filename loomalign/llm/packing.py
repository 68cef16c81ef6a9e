"""Packing by concatenate and cut.

Pass 1 encodes every text once and writes its ids with its offset inside the partition; the partitions' token totals are
summed up to global offsets (one number a partition). Pass 2 reads the ids, adds the offset and cuts at every multiple
of the window, so each sequence is full but the last, and a text that crosses a border leaves a boundary record (a piece)
on each side.

Defined cases: a null or empty text has the end id alone; repeated rows, and rows with null or repeated ids, are packed each;
a text of any length is cut into as many pieces as it needs; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.llm.common import slices_by_bytes, stored, tidy, tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode_rows(docs: DataFrame, path: str, mode: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, at, doc_id, n, ids): each row's ids with the end id, and its offset in tokens inside its partition."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, tok = TaskContext.get().partitionId(), 0, tokenizer(path, mode, 200_000)
        for batch in batches:
            for s in slices_by_bytes(batch, "_t", 6 << 20):
                ids, n = tok.encode_arrow(s.column("_t"), end)
                until = np.cumsum(n)
                starts = at + until - n
                at += int(n.sum())
                own = [ids[a:b].tobytes() for a, b in zip((until - n).tolist(), until.tolist(), strict=True)]
                del ids
                yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), s.column("_id"), pa.array(n), pa.array(own, pa.binary())], names=["part", "at", "doc_id", "n", "ids"])
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, "part int, at long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, path: str, mode: str = "lead", end: int = 1, window: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece (PIECES), with the piece's ids."""
    import numpy as np

    from loomalign.llm.common import ChunkTokenizer

    rows = stored(encode_rows(docs, path, mode, end, key, text), "pack-ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a partition
    base, bases = 0, {}
    for r in totals:
        bases[r["part"]] = base
        base += r["n"]
    size = ChunkTokenizer(path, mode).dtype.itemsize

    def cut(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for part, at, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "n", "ids")), strict=True):
                begin, done = bases[part] + at, 0
                while done < n:
                    sequence, offset = divmod(begin + done, window)
                    length = min(n - done, window - offset)
                    own = ids[done * size : (done + length) * size]
                    wide = own if size == 4 else np.frombuffer(own, "<u2").astype("<u4").tobytes()
                    for x, v in zip(out, (doc, done, length, zlib.crc32(wide), n, sequence, offset, own), strict=True):
                        x.append(v)
                    done += length
            yield pa.record_batch([*[pa.array(x, pa.int64()) for x in out[:7]], pa.array(out[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return rows.mapInArrow(cut, PIECES)
