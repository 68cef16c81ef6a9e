"""A corpus pipeline of five operators: quality, exact and near duplicates, decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet to the shared folder and rereads as the next one's docs. All but the last return the columns of documents, for
the rows they keep. Operators judge rows, not ids: a row is known by its doc_id and a hash of all its columns, so rows
that share or lack an id are kept or dropped apart. Of texts that are equal for the exact stage, one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomalign.llm import cuckoo, decontam, omh, packing, quality
from loomalign.llm.common import row_tag, rows_of, stored
from loomalign.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier takes for junk or toxic go."""
    return quality.filter_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the smallest doc_id stays; of several such rows, the one with the smallest hash."""
    groups = cuckoo.exact_groups(docs, tag=row_tag(docs)).where("kept").groupBy("text_sha256")
    return rows_of(docs, groups.agg(F.min(F.struct("doc_id", "tag")).alias("k")).select("k.*"), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each near-duplicate class stays."""
    return rows_of(docs, omh.near_classes(docs, tag=row_tag(docs)).where("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents of which a twentieth or more is benchmark text go."""
    report = decontam.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tag=row_tag(docs))
    return rows_of(docs, report.where(~decontam.contaminated()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sequences of 2048 tokens, a row for each piece with its ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: The classifier, Order MinHash and the tokenizer are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
