"""Exact nearest vectors of a stated query set, as blocked matrix products with a bounded best k in each task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import dot, top

#: Bytes of query vectors that a pass over the documents carries.
PASS_BYTES = 48 << 20
#: Products that a task holds at once.
CELLS = 2_000_000
UNIT = 1_000_000


def matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit rows) of the vectors of ``dim`` finite components that aren't all zero, in order of id."""
    size = vectors.value_lengths().fill_null(-1).to_numpy()
    at = np.flatnonzero(size == dim)
    if not len(at) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    rows = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    ids = ids.take(pa.array(at[good])).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[good[order]] / norm[good[order], None]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows of each column by score, then by id; ``ids`` rise down the rows."""
    if len(score) > k:
        key = score * len(score) + np.arange(len(score) - 1, -1, -1)[:, None]
        at = np.argpartition(key, len(score) - k, axis=0)[len(score) - k :]
    else:
        at = np.broadcast_to(np.arange(len(score))[:, None], score.shape)
    return np.take_along_axis(score, at, 0), ids[at]


def _search(queries, k: int):
    def run(batches):
        found = {dim: (np.zeros((0, len(ids)), np.int64), np.zeros((0, len(ids)), np.int64)) for dim, (ids, _) in queries.value.items()}
        for batch in batches:
            for dim, (_, wanted) in queries.value.items():
                ids, rows = matrix(batch.column(0), batch.column(1), dim)
                step = max(1, CELLS // max(1, len(wanted)))
                for b in range(0, len(ids), step):
                    score = np.floor(rows[b : b + step] @ wanted.T * UNIT + 0.5).astype(np.int64)
                    score, at = _best(score, ids[b : b + step], k)
                    score, at = (np.concatenate(x) for x in zip(found[dim], (score, at), strict=True))
                    order = np.lexsort((at, -score), axis=0)[:k]
                    found[dim] = np.take_along_axis(score, order, 0), np.take_along_axis(at, order, 0)
        for dim, (score, at) in found.items():
            row, column = np.nonzero(score > 0)
            yield pa.RecordBatch.from_arrays([pa.array(queries.value[dim][0][column]), pa.array(at[row, column]), pa.array(score[row, column] / UNIT)], ["query_id", "doc_id", "score"])

    return run


def nearest(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): for each (query_id, q) the ``k`` rows (doc_id, v) of largest cosine, in double precision, if it is above 0.

    Cosines are rounded to six digits; ties go by id. A zero vector scores 0, and vectors that are null, of another length or hold null or non-finite
    components score nothing. Ids are whole numbers. Each pass over the documents carries a slice of the queries of bounded size, and a
    task returns ``k`` rows a query at most, so work is queries times documents and what is shuffled is not.
    """
    spark = docs.sparkSession
    q = queries.select(F.col("query_id").cast("long"), "q").where("size(q) > 0")
    size = q.agg(F.sum(F.size("q").cast("long") * 8).alias("s")).collect()[0].s or 0
    passes = -(-size // PASS_BYTES)
    parts = []
    for p in range(passes):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow().combine_chunks()
        ids, vectors = (rows[c].combine_chunks() for c in ("query_id", "q"))
        sizes = {dim: found for dim in vectors.value_lengths().unique().to_pylist() if len((found := matrix(ids, vectors, dim))[0])}
        held = spark.sparkContext.broadcast(sizes)
        parts.append(docs.select(F.col("doc_id").cast("long"), "v").mapInArrow(_search(held, k), "query_id bigint, doc_id bigint, score double"))
    none = spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    return top(reduce(DataFrame.union, parts) if parts else none, k)


def similarities(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, similarity): the cosine of each (query_id, doc_id) whose vectors are both known and of one length; zero vectors give 0."""
    both = pairs.join(docs.select("doc_id", "v"), "doc_id").join(queries.select("query_id", "q"), "query_id").where(F.size("q") == F.size("v"))
    norm = F.sqrt(dot(F.col("q"), F.col("q"))) * F.sqrt(dot(F.col("v"), F.col("v")))
    return both.select("query_id", "doc_id", F.round(F.when(norm > 0, dot(F.col("q"), F.col("v")) / norm).otherwise(0.0), 6).alias("similarity"))
