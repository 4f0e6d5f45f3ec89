"""An inverted index as written tables, and exact searches that leave out what can't reach the best k.

``blocks`` has a row for up to 128 postings of a term, sorted by term and document over range partitions (a frequent term fills many of them), with the
largest BM25 part of the block; ``terms`` has the frequencies and the largest part of each term. Readers take the terms they need: files are sorted, so row groups of
other terms are skipped. ``rows`` has the postings in order of documents, for what is asked of documents that are known.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.store import Store
from .retrieval import BROADCAST_ROWS, checked_broadcast, idf, top

BLOCK = 128
#: So many postings of a query's rarest terms are scored first, to learn what its best k reach at least.
SEED = 2000
#: Scores are rounded to six digits; a document this far below the bound can't tie.
MARGIN = 1e-5


class Index(NamedTuple):
    rows: DataFrame
    blocks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    k1: float
    b: float


def _term_counts(among=None):
    """(doc_id, tokens) to (doc_id, dl, term, tf); the tokens of a document are together, so nothing is shuffled.

    ``among`` holds the terms that are asked for, if not all are; then a row without a term has the number of all tokens of a batch.
    """

    def run(batches):
        names = ["doc_id", "dl", "term", "tf"]
        for batch in batches:
            docs, tokens = batch.column(0), batch.column(1)
            coded = tokens.flatten().dictionary_encode()
            size = np.nan_to_num(tokens.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            of, code = np.repeat(np.arange(len(docs)), size), coded.indices.to_numpy()
            if not len(of):
                continue
            if among is not None:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, docs.type), pa.array([len(of)]), pa.nulls(1, pa.string()), pa.array([0], pa.int32())], names)
                wanted = pc.is_in(coded.dictionary, value_set=among.value).to_numpy(zero_copy_only=False)[code]
                of, code = of[wanted], code[wanted]
            keys, tf = np.unique(of * len(coded.dictionary) + code, return_counts=True)
            of = keys // len(coded.dictionary)
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(of)), pa.array(size[of]), coded.dictionary.take(pa.array(keys % len(coded.dictionary))), pa.array(tf.astype(np.int32))], names)

    return run


def term_counts(docs: DataFrame, among=None) -> DataFrame:
    """(doc_id, dl, term, tf) of (doc_id, tokens)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "tokens").mapInArrow(_term_counts(among), f"doc_id {kind}, dl bigint, term string, tf int")


#: Tokens that are counted at a time: it bounds what a task holds beside its batch.
COUNTED = 1 << 19


def _frequencies(batches):
    """(tokens) to (term, df, cf), partial counts of some documents each."""
    for batch in batches:
        tokens = batch.column(0)
        size = np.nan_to_num(tokens.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        piece = (np.cumsum(size) - size) // COUNTED
        cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(size) else np.zeros(1, np.int64)
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            coded = tokens.slice(at, end - at).flatten().dictionary_encode()
            code, width = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            pairs = np.unique(np.repeat(np.arange(end - at), size[at:end]) * width + code)
            counts = [np.bincount(x, minlength=len(coded.dictionary)).astype(np.int64) for x in (pairs % width, code)]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, counts)], ["term", "df", "cf"])


def frequencies(docs: DataFrame, store: Store) -> DataFrame:
    """(term, df, cf) of (doc_id, tokens): documents that hold each term, and its occurrences. Partial counts are written first, so that tasks get documents in batches of bounded size."""
    parts = store.save(docs.select("tokens").mapInArrow(_frequencies, "term string, df bigint, cf bigint"))
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _blocks(batches):
    """Rows (term, doc_id, dl, tf, part), sorted by term, to blocks of one term."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        rows = rows.combine_chunks()
        if rows.num_rows:
            cuts = _cuts(rows)
            held = rows.slice(cuts[-1])
            if len(cuts) > 1:
                yield _packed(rows.slice(0, cuts[-1]), cuts[:-1])
    if held is not None:
        yield _packed(held, np.zeros(1, np.int64))


def _cuts(rows: pa.Table) -> np.ndarray:
    """Where blocks begin."""
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    inside = np.arange(len(term)) - np.repeat(starts, np.diff(np.r_[starts, len(term)]))
    return np.flatnonzero(inside % BLOCK == 0)


def _packed(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    bounds = pa.array(np.r_[cuts, rows.num_rows].astype(np.int32))
    column = lambda c: rows[c].combine_chunks()
    packed = [pa.ListArray.from_arrays(bounds, column(c)) for c in ("doc_id", "tf", "dl")]
    best = np.maximum.reduceat(rows["part"].to_numpy(), cuts)
    return pa.RecordBatch.from_arrays([column("term").take(pa.array(cuts)), pa.array(best), *packed], ["term", "best", "docs", "tfs", "dls"])


def _part(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    """What a posting adds to a score for each unit of idf."""
    tf = tf.cast("double")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def build_index(docs: DataFrame, store: Store, k1: float = 1.5, b: float = 0.75, terms: DataFrame | None = None) -> Index:
    """The index of (doc_id, tokens), of all terms or of those in ``terms`` (term) only; statistics come from all documents either way.

    Documents without tokens count for n and the average length; an average of 0 counts as 1. Asked terms go to all tasks if a count says that they are few; else they are joined.
    """
    asked = terms.select("term").distinct() if terms is not None else None
    among = None
    if asked is not None and asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        among = docs.sparkSession.sparkContext.broadcast(asked.toArrow()["term"].combine_chunks())
    rows = store.save(term_counts(docs, among), "rows")
    n = docs.count()
    every = F.sum(F.when(F.col("term").isNull(), F.col("dl"))) if among is not None else F.sum("tf")
    words = rows.agg(every.alias("s")).collect()[0].s or 0
    rows = rows.where("term is not null")
    if asked is not None and among is None:
        rows = rows.join(asked, "term", "left_semi")
    avgdl = words / n if words else 1.0
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = rows.withColumn("part", _part(F.col("tf"), F.col("dl"), avgdl, k1, b))
    order = ["term", "doc_id"]
    ranges = parts.select("term", "doc_id", "dl", "tf", "part").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = store.save(ranges.mapInArrow(_blocks, f"term string, best double, docs array<{kind}>, tfs array<int>, dls array<bigint>"), "blocks")
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    terms = blocks.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(total).alias("cf"), F.max("best").alias("best"))
    return Index(rows, blocks, store.save(terms, "terms"), n, avgdl, k1, b)


def _postings(index: Index, wanted: DataFrame) -> DataFrame:
    """(doc_id, part, and the columns of ``wanted``) of the postings of the terms of ``wanted``: blocks are joined before they are opened."""
    blocks = index.blocks.join(checked_broadcast(wanted), "term")
    rows = blocks.select("term", *[c for c in wanted.columns if c != "term"], F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    part = _part(F.col("p.tfs"), F.col("p.dls"), index.avgdl, index.k1, index.b)
    return rows.select(F.col("p.docs").alias("doc_id"), part.alias("part"), "term", *[c for c in wanted.columns if c != "term"])


def _weighted(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, term, df, w, most): the idf of each query term, and the most that it adds to a score."""
    known = queries.select("query_id", "term").distinct().join(index.terms, "term")
    w = idf(F.lit(index.n), F.col("df"))
    return known.select("query_id", "term", "df", w.alias("w"), (w * F.col("best")).alias("most"))


def score_all(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query (query_id, term)."""
    rows = _postings(index, _weighted(queries, index).select("query_id", "term", "w"))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("part")), 6).alias("score"))


def search(queries: DataFrame, index: Index, k: int, store: Store) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each query (query_id, term), as ``top(score_all(...), k)`` has them.

    The rarest terms of a query are scored first; the k-th best of these sums is a bound that the result reaches. Terms whose largest parts together stay below it
    find nothing on their own: their postings, most often the long ones, are read for documents that the other terms have found, and only for
    those that can still reach the bound, which the k-th best of these sums raises once more.
    """
    terms = store.save(_weighted(queries, index))
    rare = W.partitionBy("query_id").orderBy("df", "term")
    seeds = terms.withColumn("before", F.coalesce(F.sum("df").over(rare.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < SEED)
    first = _summed(index, seeds)
    place = W.partitionBy("query_id").orderBy(F.desc("s"))
    bound = first.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", (F.col("s") - MARGIN).alias("bound"))
    weak = W.partitionBy("query_id").orderBy("most", "term")
    terms = terms.join(checked_broadcast(store.save(bound)), "query_id", "left").withColumn("upto", F.sum("most").over(weak))
    terms = store.save(terms.withColumn("late", F.coalesce(F.col("upto") < F.col("bound"), F.lit(False))))
    rest = terms.groupBy("query_id").agg(F.first("bound").alias("bound"), F.sum(F.when(F.col("late"), F.col("most")).otherwise(0.0)).alias("rest"))
    found = _summed(index, terms.where("not late")).join(checked_broadcast(store.save(rest)), "query_id")
    found = store.save(found.where(F.col("bound").isNull() | (F.col("s") + F.col("rest") >= F.col("bound"))).select("query_id", "doc_id", "s", "rest"))
    higher = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", (F.col("s") - MARGIN).alias("higher"))
    found = found.join(checked_broadcast(store.save(higher)), "query_id", "left").where(F.col("higher").isNull() | (F.col("s") + F.col("rest") >= F.col("higher")))
    found = store.save(found.select("query_id", "doc_id", "s"))
    late = terms.where("late").select("query_id", "term", "w")
    more = index.rows.join(found.select("query_id", "doc_id").join(checked_broadcast(late), "query_id"), ["doc_id", "term"])
    sums = found.union(more.select("query_id", "doc_id", F.col("w") * _part(F.col("tf"), F.col("dl"), index.avgdl, index.k1, index.b))).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))
    return top(sums, k)


def _summed(index: Index, terms: DataFrame) -> DataFrame:
    rows = _postings(index, terms.select("query_id", "term", "w"))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("s"))
