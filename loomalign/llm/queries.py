"""The queries of this subpackage: thin wrappers that apply an operator to its whole table and derive digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomalign.llm import cuckoo, decontam, extract, kdshard, omh, packing, quality, repair, secrets, warc
from loomalign.llm.common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of the ledger, which together are all rows; the second scans only blobs that the first has not seen."""
    docs, ledger = _table(spark, sf_dir, "documents"), shared_path(spark, "ledger")
    early = F.xxhash64("doc_id") < 0
    secrets.scan_unseen(docs.where(early), ledger)
    secrets.scan_unseen(docs.where(~early | early.isNull()), ledger)
    return secrets.spans_digest(secrets.findings(docs, ledger))


def op2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = repair.write_shards(_table(spark, sf_dir, "documents"), shared_path(spark, "shards"), tokenizer_path("word_bpe_49k.json"))
    return repair.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), named, decontam.contaminated().alias("contaminated"))


def op4_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_groups(_table(spark, sf_dir, "documents"))


def op5_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).drop("ids")


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdshard.kd_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_classes(_table(spark, sf_dir, "documents"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(_table(spark, sf_dir, "pages"), shared_path(spark, "wacz"))
    return warc.read_packages(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ledger": op1_secret_ledger,
    "op2_repair_ids": op2_repair_ids,
    "op3_winnow_decontam": op3_winnow_decontam,
    "op4_cuckoo_dedup": op4_cuckoo_dedup,
    "op5_concat_cut": op5_concat_cut,
    "op6_kd_shards": op6_kd_shards,
    "op7_order_minhash": op7_order_minhash,
    "op8_zip_warc": op8_zip_warc,
    "op9_bayes_quality": op9_bayes_quality,
    "op10_host_suffix": op10_host_suffix,
}

ORACLES: dict[str, str] = {
    # A match's place is that of its text behind the match before: an earlier place of the same text would have matched.
    "op1_secret_ledger": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS (SELECT '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS assign),
        m AS (SELECT doc_id, t, 'assign' AS kind, 1 AS rank, 6 AS least, regexp_extract_all(t, assign) AS ms, regexp_extract_all(t, assign, 2) AS gs FROM d, p
            UNION ALL SELECT doc_id, t, 'access', 2, 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
            UNION ALL SELECT doc_id, t, 'hex', 3, 24, regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') FROM d),
        w AS (SELECT *, 1 AS i, strpos(t, ms[1]) - 1 AS s FROM m WHERE len(ms) > 0
            UNION ALL SELECT doc_id, t, kind, rank, least, ms, gs, i + 1, s + length(ms[i]) + strpos(substr(t, s + length(ms[i]) + 1), ms[i + 1]) - 1 FROM w WHERE i < len(ms)),
        f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
            string_agg(kind || ':' || s || ':' || (s + length(ms[i])), ',' ORDER BY s, rank) AS spans FROM w WHERE length(gs[i]) >= least GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
        FROM d LEFT JOIN f USING (doc_id)""",
    "op3_winnow_decontam": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
        g AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
        h AS (SELECT doc_id, item_id, p, g.n FROM g JOIN i USING (n, g)),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
        s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM h GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op4_cuckoo_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_zip_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM pages),
        d AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last, list_transform(range(8), lambda i: ('0x' || substr(x, (5 * i + 1)::INTEGER, 5))::BIGINT) AS v FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
            array_to_string(list_transform(v, lambda y: a[(y >> 15) + 1] || a[(y >> 10) % 32 + 1] || a[(y >> 5) % 32 + 1] || a[y % 32 + 1]), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM d""",
    # For pages whose text is one article of h1, p, br and b, with the references that the given tables hold.
    "op10_host_suffix": r"""
        WITH b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>'),
            lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM pages),
        t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM b)
        SELECT page_id, url, text, length(text) AS n_chars, 0::BIGINT AS n_open, 0::BIGINT AS n_covered FROM t""",
}
