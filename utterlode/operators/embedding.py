"""Vectors of phrases from a pluggable fetcher, with a cache table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.durable import discard, saved
from ..sources.remote import post_json, required_env

Fetcher = Callable[[list[str]], list[list[float]]]
MOST_CHARS, BATCH, DIMENSIONS = 1000, 128, 1024
CACHE = "key string, vector array<float>"


class EmbeddingError(RuntimeError):
    pass


@dataclass(frozen=True)
class EmbeddingConfig:
    base_url: str
    api_key: str
    model: str
    dimensions: int = DIMENSIONS

    @classmethod
    def from_env(cls, prefix: str = "UTTERLODE_EMBEDDING") -> EmbeddingConfig:
        return cls(*required_env(prefix, ("base_url", "api_key", "model"), EmbeddingError))


def http_fetcher(config: EmbeddingConfig) -> Fetcher:
    """A fetcher for services with the usual ``/embeddings`` request; vectors come back in the order of the texts."""

    def fetch(batch: list[str]) -> list[list[float]]:
        request = {"model": config.model, "input": batch, "dimensions": config.dimensions, "encoding_format": "float"}
        reply = post_json(f"{config.base_url}/embeddings", config.api_key, request, EmbeddingError, attempts=4, timeout=120)
        return [row["embedding"] for row in sorted(reply["data"], key=lambda row: row["index"])]

    return fetch


def with_keys(texts: DataFrame, model: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds the text as sent and its cache key."""
    sent = texts.withColumn("sent", F.substring("text", 1, MOST_CHARS))
    return sent.withColumn("key", F.sha2(F.concat_ws("\0", F.lit(model), F.lit(str(dimensions)), F.col("sent")), 256))


def missing(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Each key that the cache lacks, once."""
    return keyed.select("key", "sent").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def fetch(rows: DataFrame, fetcher: Fetcher) -> DataFrame:
    """``key, vector, error`` of rows, a batch at a time. A batch that fails, or whose reply has another length, gives its
    error instead of vectors; the others stand."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                try:
                    vectors = fetcher(part["sent"].tolist())
                    error = None if len(vectors) == len(part) else f"{len(vectors)} vectors for {len(part)} texts"
                except Exception as failure:  # told to the driver, which keeps the other batches and then raises
                    error = f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": vectors if error is None else None, "error": error})

    return rows.mapInPandas(run, f"{CACHE}, error string")


def embed(texts: DataFrame, fetcher: Fetcher, model: str, cache_path: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``texts`` with their vectors, of norm 1 (J6, L2). Vectors that came are appended to the cache table before any error is
    raised, so a run that failed in part goes on where it stopped."""
    spark = texts.sparkSession
    keyed = with_keys(texts, model, dimensions)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    fetched = saved(fetch(missing(keyed, spark.read.schema(CACHE).parquet(cache_path)), fetcher), "fetched")
    fetched.where("error is null").select("key", "vector").write.mode("append").parquet(cache_path)
    failed = fetched.where("error is not null").orderBy("key").select("error").first()
    discard(fetched)
    if failed:
        raise EmbeddingError(failed["error"])
    cache = spark.read.schema(CACHE).parquet(cache_path).dropDuplicates(["key"])
    return keyed.join(cache, "key").drop("key", "sent").withColumn("vector", t.normalize_vector(F.col("vector")))
