"""A corpus pipeline: toxic texts go, near duplicates and repeated strings go, secrets are masked, and the rest is packed.

Rows are known by doc_id and a hash of the text, so ids that are null or come several times do not multiply or lose rows. Columns
that the stages don't use are carried along whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import jaccard, packing, secrets, suffixes, toxicity
from quillstone.llm.common import Scratch, small


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with ``rows`` (id, hash), a written table; two whole numbers a row are broadcast, if few."""
    own = {c.lower() for c in docs.columns}
    i, h = (next(n for k in range(len(own) + 1) if (n := f"{c}_{k}") not in own) for c in ("id", "hash"))
    rows = rows.select(F.col("id").alias(i), F.col("hash").alias(h)).distinct()
    return docs.join(small(rows, rows.count()), F.col("doc_id").eqNullSafe(F.col(i)) & (_text_hash() == F.col(h)), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that score below 0.3; learns from those of ``docs`` that ``labels`` covers, outside the held-out fold.

    Null and empty texts have the lowest score there is, and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = docs.select(F.col("doc_id").alias("id"), _text_hash().alias("hash"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return _matched(docs, Scratch(spark).save(scored).where("score >= 0.3"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows with the smallest doc_id of each group, of rows that repeat id and text one.

    Texts without words are in no group. Rows without an id stay, unless their group has a document with one.
    """
    scratch = Scratch(spark)
    found = scratch.save(jaccard.near_duplicate_rows(docs.select("doc_id", "text")))
    named = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "component_id")
    out = _matched(docs, named.where("component_id is not null and not id <=> component_id"), "left_anti")
    again = scratch.save(named.where("id is not null").groupBy("id", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    if again.isEmpty():
        return out
    return _matched(out, again, "left_anti").unionByName(_matched(out, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated 50-byte strings; a character that loses some of its bytes goes whole. Every row stays, if maybe empty; null texts stay null."""
    cut = suffixes.cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; null texts stay null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their length bucket, batch and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("packing", pack_batches),
]

#: The first stage is a trained classifier and the third works on bytes: SQL can't state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written before the next reads it."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
