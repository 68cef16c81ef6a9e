"""What the operators of this subpackage share: durable tables, file access, words and exact fast tokenisation."""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of these characters (everything but ASCII punctuation, controls and space).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; one of our own only where it is unset and all run on this machine."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file:///tmp/checkpoints/loomalign"
        os.makedirs("/tmp/checkpoints/loomalign", exist_ok=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; it is deleted when the application ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives lost executors and gives the optimiser real sizes."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def file_store(uri: str):
    """A pyarrow filesystem and the path in it, for any scheme that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a whole file under a temporary name, then move it into place, so that a lost or repeated task leaves no torn file."""
    store, base = file_store(folder)
    store.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as out:
        out.write(data)
    store.move(tmp, f"{base}/{name}")
    return f"{folder}/{name}"


def row_tag(docs: DataFrame) -> Column:
    """A 64-bit hash of all of a row's columns: tells rows that share or lack an id apart."""
    return F.xxhash64(*[docs[c] for c in docs.columns])


def rows_of(docs: DataFrame, keys: DataFrame, key: str = "doc_id", once: bool = False) -> DataFrame:
    """The rows of docs whose (key, tag) keys has, as they are; null is a key like any other. once: one of rows that agree in all columns.

    Adaptive execution splits the join, or broadcasts keys, by size.
    """
    own = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    chosen = keys.select(F.xxhash64("tag", own).alias("_loom_t"), own.alias("_loom_k"))
    found = docs.withColumns({"_loom_t": F.xxhash64(row_tag(docs), own), "_loom_k": own}).join(chosen, ["_loom_t", "_loom_k"], "left_semi")
    return (found.dropDuplicates(["_loom_t", "_loom_k"]) if once else found).drop("_loom_t", "_loom_k")  # dealt out by these already


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


_UPPER = {c: c + 32 for c in range(65, 91)}
_SPLIT = re.compile(NON_WORD)


def py_words(text: str | None) -> list[str]:
    """The same words in Python."""
    return [w for w in _SPLIT.split((text or "").translate(_UPPER)) if w]


class ChunkTokenizer:
    """Token ids of whole texts by the tokenizers library, with a bounded memo of the ids of words.

    A vocabulary whose pre-tokenizer never joins text across a word border encodes a text as the concatenation of its
    words' ids. A batch of texts is cut into words and these are numbered by Arrow; each distinct word of the batch is
    looked up, or encoded by the library once; NumPy puts the ids together. Punctuation at a word's end is a pre-token of
    its own after a letter or digit, so it is looked up by itself. A word that is one pre-token goes straight to the
    library's BPE model, any other one through the whole library.

    mode "drop": white space is dropped by the pre-tokenizer and text is lower-cased (word_bpe_49k); words are cut at
    ASCII white space.
    ordinary: special tokens' strings in a text are ordinary text; else, as by default in the library, they are the special
    tokens, and texts that hold one are encoded whole.
    mode "lead": a single space leads the word that follows and a single newline stands alone (byte_bpe_50k). Texts with
    two white-space characters in a row, or with other kinds of white space, are encoded whole by the library.
    """

    def __init__(self, path: str, mode: str, limit: int = 450_000, ordinary: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = ordinary
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.mode, self.limit, self.young, self.old = mode, limit, {}, {}
        self._odd = "[ \\n][ \\n]|[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
        self._one = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+|[!-&(-/:-@\[-^`{-~]+")
        self._solid = re.compile(r"[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]\Z")  # not U+0130, whose lower case is two characters
        self._special = "|".join(re.escape(x.content) for x in self.tok.get_added_tokens_decoder().values()) if not ordinary else ""
        self._bytes = _byte_letters()
        self._code = "H" if self.dtype.itemsize == 2 else "I"

    def _new(self, word: str, lead: bool) -> bytes:
        """Ids of a word (with its leading space, if lead) by the library."""
        if self._one.fullmatch(word):
            word = word.lower() if self.mode == "drop" else " " + word if lead else word
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self._bytes))]
        else:
            ids = self.tok.encode(" " + word if lead and word[:1] != "\n" else word, add_special_tokens=False).ids
        return array(self._code, ids).tobytes()

    def _known(self, word: str, lead: bool) -> bytes:
        key = word if lead else "\0" + word
        if (out := self.young.get(key)) is None:
            if (out := self.old.get(key)) is None:
                out = self._new(word, lead)
            self.young[key] = out
        return out

    def _word(self, word: str, lead: bool) -> bytes:
        core = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if len(core) == len(word) or not self._solid.search(core):
            return self._known(word, lead)
        return self._known(core, lead) + self._known(word[len(core) :], False)

    def encode_arrow(self, texts, end: int | None = None):
        """(ids of all texts in self.dtype, number of ids of each) of an Arrow array; null counts as empty. end is added to each text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        lead = self.mode == "lead"
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = {}
        if patterns := [x for x in (self._special, self._odd if lead else "") if x]:
            odd = pc.match_substring_regex(texts, "|".join(patterns))
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                whole[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
            if whole:
                texts = pc.if_else(odd, "", texts)
        if lead:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        numbered = lists.flatten().dictionary_encode()
        codes, words = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_pylist()
        out = [self._word(w, lead) if w or lead else b"" for w in words]
        counts = np.diff(offsets)
        if lead:  # the first word of a text has no space before it
            first = np.flatnonzero(counts)
            starts: dict[str, int] = {}
            for i in first.tolist():
                w = words[codes[offsets[i]]]
                if w not in starts:
                    starts[w] = len(out)
                    out.append(self._word(w, False) if w else b"")
                codes[offsets[i]] = starts[w]
        if end is not None:
            out.append(array(self._code, [end]).tobytes())
            codes = np.insert(codes, offsets[1:], len(out) - 1)
            counts = counts + 1
        size = np.fromiter(map(len, out), np.int64, len(out)) // self.dtype.itemsize
        flat, at = np.frombuffer(b"".join(out), self.dtype), np.cumsum(size) - size
        n = size[codes]
        begin = np.cumsum(n) - n
        ids = flat[np.arange(int(n.sum())) + np.repeat(at[codes] - begin, n)]
        total = np.add.reduceat(np.append(n, 0), np.append(0, np.cumsum(counts)[:-1])) * (counts > 0) if len(counts) else counts
        if whole:
            parts = np.split(ids, np.cumsum(total)[:-1])
            tail = [] if end is None else [end]
            for i, own in whole.items():
                parts[i] = np.append(own, np.array(tail, self.dtype))
            ids, total = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, total.astype(np.int64)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        import numpy as np
        import pyarrow as pa

        ids, n = self.encode_arrow(pa.array(list(texts), pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(other)}


_TOKENIZERS: dict[tuple[str, str], ChunkTokenizer] = {}


def tokenizer(path: str, mode: str, limit: int = 450_000) -> ChunkTokenizer:
    """One tokenizer and memo per worker process. limit: words in each of the memo's two generations."""
    if (path, mode) not in _TOKENIZERS:
        _TOKENIZERS[path, mode] = ChunkTokenizer(path, mode, limit)
    return _TOKENIZERS[path, mode]


def slices(batch, n: int = 256):
    """Parts of an Arrow batch, to bound what Python objects of a batch take."""
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def slices_by_bytes(batch, column: str, most: int = 16 << 20):
    """Parts of an Arrow batch with about most bytes in a text column, or one row if that is longer."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def tidy() -> None:
    """Give back what a task's end leaves unused: Python workers live on, and an executor's memory holds all of them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
