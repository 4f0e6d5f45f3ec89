"""Queries of evaluation metrics and fingerprints."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import query, table

RANKED = "r as (select doc_id % 40 as query_id, doc_id, row_number() over (partition by doc_id % 40 order by md5(doc_id::varchar), doc_id) as rank from documents)"


@query(f"""with {RANKED}, h as (select query_id, min(rank) filter (quality = 1) as first_hit from r left join labels using (doc_id) group by query_id)
 select 'md5' as system, count(*) as queries, round(avg(case when first_hit <= 5 then 1.0 else 0.0 end), 6) as recall, round(avg(coalesce(1.0::double / first_hit, 0)), 6) as mrr, count(*) filter (first_hit is null or first_hit > 5) as misses from h""")
def recall_mrr(spark, sf):
    """Recall at 5 and mean reciprocal rank of a ranking against accepted labels."""
    from pyspark.sql import Window as W

    q = F.col("doc_id") % 40
    ranked = table(spark, sf, "documents").select(q.alias("query_id"), "doc_id", F.row_number().over(W.partitionBy(q).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")).alias("rank"), F.lit("md5").alias("system"))
    accepted = table(spark, sf, "labels").where("quality = 1").select((F.col("doc_id") % 40).alias("query_id"), "doc_id")
    return E.retrieval_metrics(ranked, accepted, 5)


@query("""with a as (select event_type = 'purchase' as pub, user_id % 4 as claims, case when user_id % 5 = 0 then 1 else 0 end as fab, case when user_id % 4 > 1 then 1 else 0 end as uns, user_id % 4 * 2 as cit, case when user_id % 3 = 0 then 0 else user_id % 4 end as sound, case when event_id % 3 <> 0 then event_id % 2 = 0 end as act, value, user_id from events)
 select count(*) as rows_all, count(*) filter (pub) as published, cast(sum(claims) filter (pub) as bigint) as claims, cast(sum(fab) filter (pub) as bigint) as fabricated, cast(sum(uns) filter (pub) as bigint) as unsupported,
 round(coalesce(sum(fab) filter (pub)::double / nullif(sum(claims) filter (pub), 0), 0), 6) as fabricated_rate, round(coalesce(sum(uns) filter (pub)::double / nullif(sum(claims) filter (pub), 0), 0), 6) as unsupported_rate, round(coalesce(sum(sound) filter (pub)::double / nullif(sum(cit) filter (pub), 0), 0), 6) as citation_precision,
 round(avg(act::int) filter (pub), 6) as correct_act_rate, round(median(value) filter (pub), 6) as median_latency, max(value) filter (pub) as max_latency, round(avg((pub = (user_id % 2 = 0))::int), 6) as route_accuracy from a""")
def answer_metrics(spark, sf):
    """A5: claims, rates, citation precision, right acts, latencies and routes over answers (events as answers)."""
    u, n = F.col("user_id"), F.col("user_id") % 4
    e = table(spark, sf, "events").select(
        (F.col("event_type") == "purchase").alias("published"), n.alias("claims"), (u % 5 == 0).cast("int").alias("fabricated"), (n > 1).cast("int").alias("unsupported"), (n * 2).alias("citations"), F.when(u % 3 == 0, 0).otherwise(n).alias("sound_citations"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0).alias("right_act"), F.col("value").alias("latency"), (u % 2 == 0).alias("expected"),
    )
    return E.answer_metrics(e)


@query("""with r as (select sha256(doc_id || chr(1) || lang || chr(1) || source || chr(1) || text) as h from documents), u as (select h, count(*) as n from r group by h),
 p as (select substr(h, 1, 2) as p, sha256(string_agg(h || ':' || n, '' order by h)) as d, sum(n) as n from u group by 1)
 select sha256(string_agg(d, '' order by p)) as fingerprint, cast(sum(n) as bigint) as n from p""")
def corpus_fingerprint(spark, sf):
    """An order-independent digest of all rows, in levels that follow the count (the SQL has the two of up to 1,048,576 rows)."""
    row = F.concat_ws("\u0001", F.col("doc_id").cast("string"), "lang", "source", "text")
    return E.digest_levels(table(spark, sf, "documents").select(F.sha2(row, 256).alias("h"))).select(F.col("digest").alias("fingerprint"), "n")


@query("select c_custkey, sha256(c_custkey || '|' || c_name || '|' || c_nationkey) as digest from customer")
def case_fingerprint(spark, sf):
    """A7."""
    row = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", F.sha2(row, 256).alias("digest"))


@query("select distinct lower(hex(encode('m1'))) || '00' as prefix, sha256(unhex(hex(encode('m1')) || '00' || hex(encode(text)))) as key from documents")
def embed_key(spark, sf):
    """Cache keys of texts for a model."""
    from ..operators.embedding import cache_key

    d = table(spark, sf, "documents").select(F.lit("6d3100").alias("prefix"), cache_key("m1", F.col("text")).alias("key"))
    return d.distinct()


@query("select distinct sha256(unhex(hex(encode('m1')) || '00' || hex(encode(text)))) as key, 16 as dim, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) as words from documents")
def incremental_embed(spark, sf):
    """A store of vectors filled in two steps, the second for what it lacks, by a hashing embedder in batches; each text is embedded once."""
    from ..operators.embedding import append_missing, cache_key, hashing_embedder
    from ..sources.store import Store

    d = table(spark, sf, "documents").select("doc_id", cache_key("m1", F.col("text")).alias("key"), "text")
    path = f"{Store(spark).path}/vectors"
    append_missing(d.where("doc_id % 2 = 0").select("key", "text"), path, hashing_embedder(16), 32)
    store = append_missing(d.select("key", "text"), path, hashing_embedder(16), 32)
    return store.select("key", F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0).cast("double"), lambda s, x: s + x).cast("long").alias("words"))


@query("select doc_id, sha256('7:' || doc_id) as draw from documents order by draw, doc_id limit 25")
def sample_seeded(spark, sf):
    """A seeded sample of 25 documents without replacement (the sample is the feature)."""
    draw = F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)
    return table(spark, sf, "documents").select("doc_id", draw.alias("draw")).orderBy("draw", "doc_id").limit(25)


@query("""select doc_id, cast(contains(text, 'the') as int) + cast(contains(text, 'der') as int) + cast(contains(text, 'que') as int) as score from documents order by score desc, doc_id limit 40""")
def priority_rank(spark, sf):
    """The 40 documents with most of the listed terms (a top-n report)."""
    score = F.contains("text", F.lit("the")).cast("int") + F.contains("text", F.lit("der")).cast("int") + F.contains("text", F.lit("que")).cast("int")
    return table(spark, sf, "documents").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)
