"""Secret scans over an incremental blob ledger.

Every historical version of every path is addressed by the SHA-256 of its content. The ledger records which
(blob, rule, rule version) pairs have been scanned and what each rule version found; a scan touches only blobs with pairs
that the ledger lacks, and findings of the rule versions asked for are joined back to every path and version that holds
the blob. Findings of older rule versions stay in the ledger, but do not come back.

Defined cases: a null text is the empty blob; equal texts are scanned once, however many rows hold them; an empty input
gives an empty result; a text of any length is scanned whole, as one row; rows with null or repeated keys get a result
each; other columns of the input are ignored unless named as keys.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.llm.common import path_exists, slices, stored


@dataclass(frozen=True)
class Rule:
    """kind names the finding; a match counts if the given group has least characters. need: one of these must occur in a text."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    need: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)


@lru_cache(maxsize=256)
def _compiled(rule: Rule) -> re.Pattern:
    pattern = rule.pattern
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.kind == "hex":
        pattern = rule.pattern[:-1] + f"{{{rule.least},}}"  # runs are maximal, so shorter ones can be left out at once
    return re.compile(pattern, re.ASCII)


def find_spans(text: str, rules: Sequence[Rule] = RULES) -> list[tuple[Rule, int, int]]:
    """(rule, start, end) of each finding, by start, then in the order of the rules; offsets in code points."""
    out = []
    for n, rule in enumerate(rules):
        if rule.need and not any(x in text for x in rule.need):
            continue
        for m in _compiled(rule).finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), n, m.end()))
    return [(rules[n], a, b) for a, n, b in sorted(out)]


_LEDGER = "blob string, rules array<string>, spans array<struct<kind:string,version:int,start:int,end:int>>"


def read_ledger(spark, path: str) -> DataFrame:
    """Rows of all batches so far; none if there is no ledger yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(path)


def scan_unseen(versions: DataFrame, ledger: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the ledger's rows.

    Texts are deduplicated before and after the one shuffle that carries them (partial aggregation), so a blob with many
    copies costs one row per task. The ledger's batch is written by Spark's committer: a lost executor repeats its task only.
    """
    spark = versions.sparkSession
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).select(F.sha2("_t", 256).alias("blob"), "_t").dropDuplicates(["blob"])
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if path_exists(spark, ledger):
        seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    else:
        blobs = blobs.withColumn("rules", wanted)
    fixed = {r.key: r for r in rules}

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            for part in slices(batch, 512):
                found = []
                for t, todo in zip(part.column("_t").to_pylist(), part.column("rules").to_pylist(), strict=True):
                    found.append([{"kind": r.kind, "version": r.version, "start": a, "end": b} for r, a, b in find_spans(t, [fixed[x] for x in todo])])
                yield pa.record_batch([part.column("blob"), part.column("rules"), pa.array(found, kind.field("spans").type)], schema=kind)

    batch = f"{ledger}/{uuid.uuid4().hex}"
    blobs.select("blob", "rules", "_t").mapInArrow(run, _LEDGER).write.option("compression", "zstd").parquet(batch)
    return read_ledger(spark, ledger)


def findings(versions: DataFrame, ledger: str, keys: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of versions: its keys, blob and what the ledger has for these rule versions (array of kind, start, end), empty where there is nothing."""
    rank = F.create_map(*[x for n, r in enumerate(rules, 1) for x in (F.lit(r.key), F.lit(n))])
    found = read_ledger(versions.sparkSession, ledger).select("blob", F.explode("spans").alias("s"))
    found = found.withColumn("rank", rank[F.concat_ws("@", "s.kind", F.col("s.version").cast("string"))]).where(F.col("rank").isNotNull())
    found = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s.start", "rank", "s.end", "s.kind"))).alias("spans"))
    found = stored(found, "findings")  # written, so that the join of a blob with very many rows can be split
    rows = versions.select(*keys, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    return rows.join(found, "blob", "left").select(*keys, "blob", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("spans"))


def scan_secrets(versions: DataFrame, ledger: str, keys: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks of versions, then the findings of every row."""
    scan_unseen(versions, ledger, text, rules)
    return findings(versions, ledger, keys, text, rules)


def spans_digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of a scan with the three base kinds."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return scanned.select(key, *[count(k) for k in ("assign", "access", "hex")], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"), "blob")
