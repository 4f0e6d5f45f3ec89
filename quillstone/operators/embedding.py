"""Embedding tables: cache keys, embedding of what a store lacks, version keys."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(model: str, text: Column) -> Column:
    """sha256 of the model's name, a zero byte, and the text."""
    return F.sha2(F.concat(F.lit(model.encode() + b"\x00"), F.encode(text, "UTF-8")), 256)


def embed_missing(texts: DataFrame, store: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """(key, vector) of the distinct (key, text) whose key ``store`` lacks; ``embed`` gets ``batch`` texts at a time (128 at most)."""
    batch = min(batch, 128)
    new = texts.groupBy("key").agg(F.min("text").alias("text")).join(store.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({"key": part.key.to_numpy(), "vector": list(np.asarray(embed(part.text.tolist()), np.float32))})

    return new.mapInPandas(run, "key string, vector array<float>")


STORE = "key string, vector array<float>, part string"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, vector) of a store, one row a key; a folder that isn't there yet is an empty store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STORE).select("key", "vector")
    return spark.read.schema(STORE).parquet(path).groupBy("key").agg(F.first("vector").alias("vector"))


def append_missing(texts: DataFrame, path: str, embed: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """Embeds the (key, text) whose key the store lacks, appends them by the first two digits of the key, and returns the store.

    Only keys that the store lacks are embedded, so a run again embeds nothing; a write commits whole or not at all, so a job that breaks off or a
    task that is lost is made good by running it again. Two jobs at once may both append a key: readers take one row of it.
    """
    spark = texts.sparkSession
    new = embed_missing(texts, read_store(spark, path), embed, batch)
    new.withColumn("part", F.substring("key", 1, 2)).write.partitionBy("part").mode("append").parquet(path)
    return read_store(spark, path)


def hashing_embedder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A model-free stand-in: counts of words by hash."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) % dim] += 1
        return out

    return embed


def version_key(corpus: Column, embedding: Column, tag: str) -> Column:
    return F.sha2(F.to_json(F.struct(corpus.alias("corpus"), embedding.alias("embedding"), F.lit(tag).alias("tag"))), 256)
