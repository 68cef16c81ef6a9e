"""Encoders of column and record texts. An encoder maps (key, text) rows to embeddings; each row's vector depends on that row and the fitted statistics alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomalign.functions.similarity import EPS, unit
from loomalign.sources.durable import stored


class Encoder(Protocol):
    def fit(self, rows: DataFrame, key: str, text: str) -> Encoder: ...

    def transform(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


@dataclass
class HashedEncoder:
    """Words and character trigrams hashed to dim places, weighted by smooth idf, of unit length. Built-in functions only."""

    dim: int = 256
    idf: DataFrame | None = None
    max_words: int = 128

    def _counts(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        words = F.slice(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1), 1, self.max_words)
        grams = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.when(F.length(w) > 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3)))).otherwise(F.array().cast("array<string>")))))
        return rows.select(F.col(key), F.explode(grams).alias("g")).groupBy(key, F.pmod(F.xxhash64("g"), F.lit(self.dim)).alias("place")).agg(F.count(F.lit(1)).alias("tf"))

    def fit(self, rows: DataFrame, key: str = "node", text: str = "text") -> HashedEncoder:
        n = rows.count()
        df = self._counts(rows, key, text).groupBy("place").agg(F.count(F.lit(1)).alias("df"))
        return HashedEncoder(self.dim, stored(df.select("place", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "idf"), self.max_words)

    def transform(self, rows: DataFrame, key: str = "node", text: str = "text") -> DataFrame:
        w = self._counts(rows, key, text).join(F.broadcast(self.idf), "place").withColumn("w", F.col("tf") * F.col("idf"))  # dim rows at most
        vectors = w.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        out = rows.join(vectors, key, "left").withColumn("embedding", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), self.dim)).otherwise(unit(dense)))
        return out.drop("m")


@dataclass
class GivenVectors:
    """Vectors that are already there, joined by key."""

    vectors: DataFrame

    def fit(self, rows: DataFrame, key: str = "node", text: str = "text") -> GivenVectors:
        return self

    def transform(self, rows: DataFrame, key: str = "node", text: str = "text") -> DataFrame:
        return rows.join(self.vectors.select(key, unit(F.col("embedding")).alias("embedding")), key)


@dataclass
class FunctionEncoder:
    """Any batch function list[str] -> array (n, dim), loaded once a worker by load(); for language models given by the user."""

    load: Callable[[], Callable]

    def fit(self, rows: DataFrame, key: str = "node", text: str = "text") -> FunctionEncoder:
        return self

    def transform(self, rows: DataFrame, key: str = "node", text: str = "text") -> DataFrame:
        run = F.pandas_udf(_stream(self.load), "array<double>")
        return rows.withColumn("embedding", run(F.col(text)))


def _stream(load):
    def body(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out = []
            for x in model(s.fillna("").tolist()):
                n = sum(float(v) ** 2 for v in x) ** 0.5 + EPS
                out.append([float(v) / n for v in x])
            yield pd.Series(out)

    return body
