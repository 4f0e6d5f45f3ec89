"""Metrics and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, accepted: DataFrame, k: int) -> DataFrame:
    """(system, queries, recall, mrr, misses): queries without an accepted hit count with 0."""
    hits = ranked.join(accepted, ["query_id", "doc_id"]).groupBy("system", "query_id").agg(F.min("rank").alias("first_hit"))
    every = ranked.select("system", "query_id").distinct().join(hits, ["system", "query_id"], "left")
    hit = F.coalesce((F.col("first_hit") <= k).cast("double"), F.lit(0.0))
    return every.groupBy("system").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(hit), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"), F.count_if(hit == 0).alias("misses"))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """Over answers: counts of published ones, of fabricated and unsupported claims, and rates over what was published; latencies and route accuracy.

    ``rows``: published, expected (booleans), claims, fabricated, unsupported, citations, sound_citations (counts), right_act (boolean, null where none is asked), latency. Only published
    answers count, but for the route accuracy. A rate over nothing is 0, of citations too; the correct-act rate is null if no published answer is asked for an act.
    """
    out = F.col("published")
    total = lambda c: F.coalesce(F.sum(F.when(out, F.col(c))), F.lit(0)).cast("long")
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(total(a).cast("double"), total(b)), F.lit(0.0)), 6)
    return rows.agg(
        F.count(F.lit(1)).alias("rows_all"), F.count_if(out).alias("published"), total("claims").alias("claims"), total("fabricated").alias("fabricated"), total("unsupported").alias("unsupported"),
        rate("fabricated", "claims").alias("fabricated_rate"), rate("unsupported", "claims").alias("unsupported_rate"), rate("sound_citations", "citations").alias("citation_precision"),
        F.round(F.avg(F.when(out, F.col("right_act").cast("int"))), 6).alias("correct_act_rate"), F.round(F.median(F.when(out, F.col("latency"))), 6).alias("median_latency"),
        F.max(F.when(out, F.col("latency"))).alias("max_latency"), F.round(F.avg((out == F.col("expected")).cast("int")), 6).alias("route_accuracy"),
    )


def missed(ranked: DataFrame, accepted: DataFrame, k: int) -> DataFrame:
    """(system, query_id, first_hit): queries of a system without an accepted hit among the first ``k``; first_hit is the rank of a later one, else null."""
    hits = ranked.join(accepted, ["query_id", "doc_id"]).groupBy("system", "query_id").agg(F.min("rank").alias("first_hit"))
    every = ranked.select("system", "query_id").distinct().join(hits, ["system", "query_id"], "left")
    return every.where(F.col("first_hit").isNull() | (F.col("first_hit") > k))


def canonical_row(columns: list[str], metadata: str | None = None) -> Column:
    """sha256 of a row as JSON: columns in order of name, nulls kept, the entries of the map ``metadata`` in order of key."""
    parts = [F.col(c).alias(c) for c in sorted(columns)]
    if metadata:
        parts.append(F.array_sort(F.map_entries(metadata)).alias(metadata))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def fingerprint_violations(rows: DataFrame, key: str, numbers: list[str] = (), metadata: str | None = None) -> DataFrame:
    """(rule, key): ids that come twice, and rows with a number that is not finite, in a column or as a value of ``metadata`` (nan, inf, infinity in any case)."""
    name = F.col(key).cast("string")
    twice = rows.groupBy(name.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), "key")
    odd = F.lit(False)
    for c in numbers:
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if metadata:
        odd = odd | F.coalesce(F.exists(F.map_values(metadata), lambda v: F.coalesce(F.lower(F.trim(v.cast("string"))).rlike("^[+-]?(nan|inf|infinity)$"), F.lit(False))), F.lit(False))
    return twice.union(rows.where(odd).select(F.lit("not_finite"), name))


#: Digests that one group of ``digest_levels`` holds on average at most.
GROUP = 4096


def digest_levels(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, digest, n) of row digests (h, hexadecimal), in any order: levels by prefixes of h, the longest as the count asks for.

    Equal digests are counted first, so copies fill no group. A level joins at most 256 digests, the first one about ``GROUP``;
    prefixes have an even length, 2 at least.
    """
    by, k = list(by), 2
    count = rows.count()
    while count > GROUP * 16**k:
        k += 2
    level = rows.groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    level = level.select(*by, F.col("h").alias("p"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("d"), "n")
    for size in range(k, -1, -2):
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "")
        level = level.groupBy(*by, F.substring("p", 1, size).alias("p")).agg(F.sha2(whole, 256).alias("d"), F.sum("n").alias("n"))
    return level.select(*by, F.col("d").alias("digest"), "n")
