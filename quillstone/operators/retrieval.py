"""Ranking many queries against many documents: query terms, ranks, fusion, rerank, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

#: A side is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """A broadcast hint, if a bounded count says that the side is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))


def tokenised(docs: DataFrame, key: str, text: str, tokens: Column | None = None) -> DataFrame:
    """(doc_id, tokens, dl); ``tokens`` may be any array expression."""
    return docs.select(F.col(key).alias("doc_id"), (T.tokens(F.col(text)) if tokens is None else tokens).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top(ranked: DataFrame, limit: int, by: str = "query_id", score: str = "score", tie: str = "doc_id", keep_zero: bool = False) -> DataFrame:
    """The ``limit`` best of each query with their rank: score down, then id up; zero scores only if asked."""
    rows = ranked if keep_zero else ranked.where(F.col(score) > 0)
    over = W.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fuse(channels: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, channel, score, rank[, weight]) to the sum of weight / (k + rank), and maps of scores and ranks by channel."""
    weight = F.col("weight") if "weight" in channels.columns else F.lit(1.0)
    pair = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", c))))
    return channels.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), pair("score").alias("channel_scores"), pair("rank").alias("channel_ranks"))


def rerank(fused: DataFrame, similarity: DataFrame, limit: int) -> DataFrame:
    """Reorders the kept ``limit`` of each query by similarity, then fused rank; the set and the fused score stay. No similarity: last."""
    kept = fused.where(F.col("rank") <= limit).join(similarity.select("query_id", "doc_id", "similarity"), ["query_id", "doc_id"], "left")
    over = W.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), F.asc("rank"))
    return kept.withColumn("new_rank", F.row_number().over(over))


def expand_synonyms(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, tokens) with all terms of each group (grp, terms) that one of the original terms is in; groups of one term are left out."""
    hit = queries.join(F.broadcast(groups.where(F.size("terms") >= 2)), F.arrays_overlap("tokens", "terms"))  # a reviewed list
    more = hit.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("grp", "terms"))), lambda x: x["terms"])).alias("more"))
    return queries.join(more, "query_id", "left").select("query_id", F.array_distinct(F.concat("tokens", F.coalesce("more", F.array().cast("array<string>")))).alias("tokens"))


def expand_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, alias, expansion) for each alias that stands as whole tokens in the query's key, in order of alias."""
    q = queries.select("query_id", F.concat(F.lit(" "), "key", F.lit(" ")).alias("padded"))
    a = aliases.select("alias", "expansion", F.concat(F.lit(" "), "alias", F.lit(" ")).alias("probe"))
    return q.join(F.broadcast(a), F.col("padded").contains(F.col("probe"))).select("query_id", "alias", "expansion")  # a reviewed list


def alias_violations(aliases: DataFrame) -> DataFrame:
    """(alias, n): keys that several aliases have once they are written as tokens, which is an error."""
    return aliases.groupBy(T.alias_key(F.col("alias")).alias("alias")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
