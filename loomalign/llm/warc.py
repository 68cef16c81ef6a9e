"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extraction.

A package is a ZIP file with stored (uncompressed) members: archive/data.warc.gz, where each record is a gzip member of
its own, and indexes/index.cdxj with one line a record (file name, offset and length inside that archive member); a
package may hold several archives and indexes. The reader parses the end record, the ZIP64 locator and end record, and the
central directory from the file's tail; finds the stored members' data behind their local headers; reads the indexes; and
deals out (file, offset, length) triples, each of which is one ranged read.

Of records with equal payloads of at least `least` bytes the one with the largest id is a response and the others are
revisits that refer to it. Defined cases: a null payload is empty; repeated ids with equal payloads are all responses;
null urls are written as urn:page:<id>, null ids as urn:page:null, which read back as null (equal payloads without an id are
all responses); a payload of any length is one record; an empty table gives no packages and an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.llm.common import file_store, put_file, shuffle_width, slices, stored

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest_text(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _line(value: str) -> str:
    return "".join(c for c in value if c >= " ")


def _name(page: int | None) -> str:
    return "null" if page is None else str(page)


def record(page: int | None, url: str | None, payload: bytes | None, length: int, digest: str, response: int | None) -> bytes:
    """One WARC record. response: the id it revisits, or None if it is a response itself."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_name(page)}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url) if url else f'urn:page:{_name(page)}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response",
    ]
    if response is not None:
        head += [f"WARC-Refers-To: <urn:page:{response}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP + (payload or b"" if response is None else b"")
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def package(records: list[tuple[int, str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP package of (page, url, record bytes)."""
    archive, index = io.BytesIO(), []
    for page, url, data in records:
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        part = z.compress(data) + z.flush()
        index.append(f"urn:page:{_name(page)} 20000101000000 " + json.dumps({"offset": archive.tell(), "length": len(part), "filename": "data.warc.gz", "url": url}))
        archive.write(part)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in (("archive/data.warc.gz", archive.getbuffer()), ("indexes/index.cdxj", "\n".join(index).encode()), ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


class ZipPackage:
    """Members of a ZIP file by ranged reads: read_at(offset, length) -> bytes."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        tail_at = max(0, size - 65_557)
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            mark, _, at = struct.unpack_from("<4sIQ", self._read(tail_at + end - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, count, length, start = struct.unpack_from("<4s28xQQQ", self._read(at, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
        self.members = {}
        directory, at = self._read(start, length), 0
        for _ in range(count):
            mark, method, packed, size_, n, extra, comment, where = struct.unpack_from("<4s6xH8xIIHHH8xI", directory, at)
            if mark != b"PK\x01\x02":
                raise ValueError("broken central directory")
            name = directory[at + 46 : at + 46 + n].decode("utf-8", "replace")
            more, k = directory[at + 46 + n : at + 46 + n + extra], 0
            while k + 4 <= len(more):
                kind, long = struct.unpack_from("<HH", more, k)
                if kind == 1:  # ZIP64: only the fields that overflowed, in this order
                    values = iter(struct.unpack_from(f"<{long // 8}Q", more, k + 4))
                    size_ = next(values) if size_ == 0xFFFFFFFF else size_
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    where = next(values) if where == 0xFFFFFFFF else where
                k += 4 + long
            self.members[name] = (method, where, packed)
            at += 46 + n + extra + comment

    def _read(self, at: int, n: int) -> bytes:
        out = self.read_at(at, n)
        if len(out) != n:
            raise ValueError("the file is cut off")
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data in the file."""
        method, where, packed = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        mark, n, extra = struct.unpack_from("<4s22xHH", self._read(where, 30))
        if mark != b"PK\x03\x04":
            raise ValueError("broken local header")
        return where + 30 + n + extra, packed

    def index(self) -> list[tuple[int, int]]:
        """Offset and length in the file of every record that an index names; an entry without a file name is of the only archive."""
        archives = {x.removeprefix("archive/"): self.locate(x) for x in sorted(self.members) if x.startswith("archive/")}
        out = []
        for name in sorted(x for x in self.members if x.startswith("indexes/")):
            at, n = self.locate(name)
            for line in self._read(at, n).decode().splitlines():
                entry = json.loads(line.split(" ", 2)[2])
                file = entry.get("filename") or (next(iter(archives)) if len(archives) == 1 else None)
                if file not in archives:
                    raise ValueError("an index entry names no archive of the package")
                base, size = archives[file]
                if int(entry["offset"]) + int(entry["length"]) > size:
                    raise ValueError("an index entry ends beyond its archive")
                out.append((base + int(entry["offset"]), int(entry["length"])))
        return out


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, package_bytes: int = 32_000_000) -> DataFrame:
    """Write a record for every row into packages under folder; the stored manifest (file, records, bytes) is returned."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).alias("_u"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("_p")).withColumn("_d", F.sha1("_p")).withColumn("_n", F.octet_length("_p").cast("long"))
    last = pages.select(F.col(key).cast("long").alias("_r"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("_p")).select("_r", F.sha1("_p").alias("_d"), F.octet_length("_p").cast("long").alias("_n"))
    last = stored(last.where(F.col("_n") >= least).groupBy("_d").agg(F.max("_r").alias("_r"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), "repeated")
    # Payloads stay where they are if the table of repeated digests is small enough for Spark to broadcast (its size is
    # known, since it is stored); else they are dealt out by digest, once.
    own = F.col("_r").isNull() | F.col("_r").eqNullSafe(F.col("_id"))
    rows = rows.join(last, "_d", "left").select("_id", "_u", F.when(own, F.col("_p")).alias("_p"), "_d", "_n", F.when(~own, F.col("_r")).alias("_r"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def close():
            data = package(held)
            file = put_file(folder, f"pages-{part:06d}-{seq:05d}.wacz", data)
            return pa.record_batch([pa.array([file]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["file", "n_records", "n_bytes"])

        for batch in batches:
            for s in slices(batch):
                for page, u, p, d, size, r in zip(*(s.column(c).to_pylist() for c in ("_id", "_u", "_p", "_d", "_n", "_r")), strict=True):
                    held.append((page, u, record(page, u, p, size, digest_text(d), r)))
                    n += len(held[-1][2])
                    if n >= package_bytes:
                        yield close()
                        held, n, seq = [], 0, seq + 1
        if held:
            yield close()

    return stored(rows.mapInArrow(run, "file string, n_records long, n_bytes long"), "packages")


def _ranged(path):
    store, where = file_store(path)
    f = store.open_input_file(where)
    return f, lambda at, n: f.read_at(n, at)


def read_packages(files: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORDS of every record of the packages named in column file, by ranged reads; payload null unless asked for."""
    tasks = shuffle_width(files.sparkSession)

    def locate(batches):
        import pyarrow as pa

        for batch in batches:
            for file in batch.column("file").to_pylist():
                f, read_at = _ranged(file)
                with f:
                    found = ZipPackage(read_at, f.size()).index()
                for a in range(0, len(found), 64):  # ranges of some neighbours travel together and are read one by one
                    part = found[a : a + 64]
                    yield pa.record_batch([pa.array([file]), pa.array([[x for x, _ in part]], pa.list_(pa.int64())), pa.array([[n for _, n in part]], pa.list_(pa.int64()))], names=["file", "at", "n"])

    ranges = files.select("file").repartition(tasks).mapInArrow(locate, "file string, at array<long>, n array<long>").repartition(tasks)

    def page_of(name):
        name = name.strip("<>").rpartition(":")[2]
        return None if name == "null" else int(name)

    def read(batches):
        import hashlib

        import pyarrow as pa

        kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
                f, read_at = _ranged(file)
                out = []
                with f:
                    for a, k in zip(at, n, strict=True):
                        head, payload = parse(zlib.decompress(read_at(a, k), 31))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        first = head["warc-type"] == "response"
                        if first and (digest != base64.b32encode(hashlib.sha1(payload).digest()).decode() or len(payload) != int(head["x-payload-length"])):
                            raise ValueError(f"{file}: the payload at {a} does not match its digest")
                        out.append((page_of(head["warc-record-id"]), int(head["x-payload-length"]), digest, head["warc-type"], None if first else page_of(head["warc-refers-to"]), head["warc-target-uri"], payload if payloads and first else None))
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return ranges.mapInArrow(read, RECORDS)
