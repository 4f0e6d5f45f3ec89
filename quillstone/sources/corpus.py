"""Chunk corpora as JSON lines: reading with checks, atomic writing by source, and nested label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, source_id string, section_id string, heading string, text string, page_start int, page_end int, metadata map<string,string>"


def read_chunks(spark: SparkSession, folder: str, source_ids: list[str] | None = None, schema: str = CHUNK) -> DataFrame:
    """Chunks with text, and the stem of their file; a malformed line fails the read; ``source_ids`` picks sources (see ``corpus_violations``)."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
    rows = rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)).where(F.trim("text") != "")
    return rows if source_ids is None else rows.where(F.col("source_id").isin(source_ids))


def corpus_violations(chunks: DataFrame, source_ids: list[str] | None = None) -> DataFrame:
    """(rule, key): chunk ids that come twice, and sources asked for that have no chunk."""
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_chunk").alias("rule"), F.col("chunk_id").alias("key"))
    if not source_ids:
        return twice
    ask = chunks.sparkSession.createDataFrame([(s,) for s in source_ids], "source_id string")
    return twice.union(ask.join(chunks, "source_id", "left_anti").select(F.lit("unknown_source"), "source_id"))


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each source, replaced whole (files appear on commit only); other sources stay."""
    chunks.repartition("source_id").sortWithinPartitions("source_id", "chunk_id").write.option("partitionOverwriteMode", "dynamic").partitionBy("source_id").mode("overwrite").json(folder)


def remove_sources(spark: SparkSession, folder: str, source_ids: list[str]) -> None:
    """Removes the output of sources whose build failed."""
    jvm = spark._jvm
    for s in source_ids:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/source_id={s}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_nested(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """Rows of a file ``{field: [...]}``; a file without the list gives none. ``element``: fields of an entry."""
    rows = spark.read.schema(f"{field} array<struct<{element}>>").option("multiLine", True).json(path)
    return rows.select(F.inline(field))
