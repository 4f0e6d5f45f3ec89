"""Queries of text functions and row filters."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as P
from .registry import query, table

TRIMMED = "trim(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'))"


@query(f"""select doc_id, case when {TRIMMED} = '' then 'blank' when length({TRIMMED}) > 20000 then 'too_long' when regexp_matches({TRIMMED}, '[\\x00-\\x08\\x0b-\\x1f\\x7f]') then 'control'
 when regexp_matches({TRIMMED}, '[\\x{{061c}}\\x{{200e}}\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]') then 'bidi' end as problem, length({TRIMMED}) as n_chars from documents""")
def intake_normalise(spark, sf):
    """T8."""
    return table(spark, sf, "documents").select("doc_id", T.intake_problem(F.col("text")).alias("problem"), F.length(T.intake_text(F.col("text"))).cast("long").alias("n_chars"))


@query("""with c as (select doc_id, length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) as latin, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['the','der','les'])) as known from documents)
 select doc_id, cast(latin as bigint) as latin, case when latin > 0 and known >= 2 then 'mixed' when latin > 0 then 'en' else 'und' end as language from c""".replace("[^\\p{Latin}]", "[^\\p{Latin}]|[ªº]|[Ⅰ-ↈ]"))
def lang_script(spark, sf):
    """Language by script and romanised markers."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.script_counts(F.col("text"))[1].cast("long").alias("latin"), T.language_by_script(F.col("text"), ["the", "der", "les"]).alias("language"))


@query("""with w as (select doc_id, text, substr(text, 1, 1200) as h from documents)
 select doc_id, length(text) > 1200 as truncated, md5(case when length(text) <= 1200 then text
  when instr(h, ' ') > 0 and 1200 - instr(reverse(h), ' ') > 600 then rtrim(substr(h, 1, 1200 - instr(reverse(h), ' '))) else rtrim(h) end) as excerpt_md5 from w""")
def excerpt_bounded(spark, sf):
    """P6."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", (F.length("text") > 1200).alias("truncated"), F.md5(T.bounded(F.col("text"), 1200)).alias("excerpt_md5"))


@query("""with w as (select doc_id, text, substr(text, 1, 79) as h from documents)
 select doc_id, case when length(text) <= 80 then text else regexp_replace(case when instr(h, ' ') > 0 then substr(h, 1, length(h) - instr(reverse(h), ' ')) else h end, '[ ,.;:]+$', '') || '…' end as short,
 case when length(trim(split_part(trim(text), chr(10), 1))) <= 80 then trim(split_part(trim(text), chr(10), 1)) else rtrim(substr(trim(split_part(trim(text), chr(10), 1)), 1, 80)) || '…' end as title from w""")
def ellipsis(spark, sf):
    """P7."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.ellipsis(F.col("text"), 80).alias("short"), T.title_line(F.col("text")).alias("title"))


@query("select doc_id, cast(floor(strlen(text) / 3) as bigint) + 1 as tokens, floor(strlen(text) / 3) + 1 + 400 + 600 + 256 <= 4096 as fits from documents")
def token_budget(spark, sf):
    """P12."""
    n = T.token_estimate(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", n.cast("long").alias("tokens"), (n + 400 + 600 + 256 <= 4096).alias("fits"))


@query("""select source, lang, cast(doc_id // 1000 as bigint) as run, count(*) as n_evidence, md5(string_agg(doc_id || ':' || (length(text) > 300), ',' order by doc_id)) as fields_md5 from documents group by all""")
def grounding_export(spark, sf):
    """P20: records of all documents, one for each source, language and run of 1,000 ids; here their fields."""
    out = P.grounding_runs(table(spark, sf, "documents"), ["source", "lang"], "doc_id", "text", 300, 1000)
    got = F.from_json("record", "case_key string, evidence array<struct<id:bigint,excerpt:string,shortened:boolean>>").getField("evidence")
    return out.select("source", "lang", "run", F.size(got).cast("long").alias("n_evidence"), F.md5(F.array_join(F.transform(got, lambda e: F.concat_ws(":", e["id"].cast("string"), e["shortened"].cast("string"))), ",")).alias("fields_md5"))


@query("""select doc_id, lower(lang) = lower('EN') as by_lang, list_contains(['src1','src2'], lower(source)) as by_source, doc_id % 3 <> 1 or list_contains(['p0','p2'], 'p' || (doc_id % 4)) as approved from documents""")
def metadata_filter(spark, sf):
    """Metadata equality in any case, lists of values, and the profile gate."""
    profile = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("p"), (F.col("doc_id") % 4).cast("string")))
    return table(spark, sf, "documents").select(
        "doc_id", P.matches(F.col("lang"), "EN").alias("by_lang"), P.any_matches(F.array("source"), ["SRC1", "src2"]).alias("by_source"), P.profile_allowed(profile, ["p0", "p2"]).alias("approved")
    )


EFFECTIVE = """case when {f} is null then {u} when not regexp_matches({f}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') or try_cast({f} as date) is null then false
 when {t} is not null and (not regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') or try_cast({t} as date) is null) then false
 else cast({f} as date) <= date '1996-06-15' and ({t} is null or cast({t} as date) >= date '1996-06-15') end"""
FROM_SQL = "case o_orderkey % 10 when 0 then null when 1 then '1996-6-1' else strftime(o_orderdate, '%Y-%m-%d') end"
TO_SQL = "case o_orderkey % 7 when 0 then null when 1 then 'soon' else strftime(o_orderdate + interval 90 day, '%Y-%m-%d') end"


@query(f"""with o as (select o_orderkey, {FROM_SQL} as f, {TO_SQL} as t from orders)
 select o_orderkey, {EFFECTIVE.format(f='f', t='t', u='false')} as in_force, case when f is null then t is null or (regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_cast(t as date) is not null) else {EFFECTIVE.format(f='f', t='t', u='true')} end as or_undated from o""")
def effective_filter(spark, sf):
    """In force on a day, both ends inclusive, with open, missing and malformed dates."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    start = F.when(key % 10 == 0, None).when(key % 10 == 1, "1996-6-1").otherwise(F.date_format(day, "yyyy-MM-dd"))
    end = F.when(key % 7 == 0, None).when(key % 7 == 1, "soon").otherwise(F.date_format(F.date_add(day, 90), "yyyy-MM-dd"))
    o = table(spark, sf, "orders").select("o_orderkey", start.alias("f"), end.alias("t"))
    on = F.lit("1996-06-15").cast("date")
    return o.select("o_orderkey", P.in_force(F.col("f"), F.col("t"), on, False).alias("in_force"), P.in_force(F.col("f"), F.col("t"), on, True).alias("or_undated"))


PREFIXES = [("civil", "src1"), ("labour", "src2"), ("labour", "src3"), ("empty", "zzz")]
PREFIX_SQL = "p(domain, prefix) as (values ('civil','src1'),('labour','src2'),('labour','src3'),('empty','zzz'))"


@query(f"with {PREFIX_SQL} select distinct domain, doc_id from documents join p on starts_with(source, prefix)")
def scoped_prefix(spark, sf):
    """Documents of each domain, by prefixes of their source."""
    return P.scoped(table(spark, sf, "documents"), spark.createDataFrame(PREFIXES, "domain string, prefix string"), "source").select("domain", "doc_id")


@query(f"""with {PREFIX_SQL}, d as (select distinct domain from p), s as (select distinct domain, doc_id from documents join p on starts_with(source, prefix))
 select d.domain, count(doc_id) as n, count(doc_id) = 0 as unrouted from d left join s using (domain) group by d.domain""")
def domain_counts(spark, sf):
    """A15."""
    prefixes = spark.createDataFrame(PREFIXES, "domain string, prefix string")
    n = P.scoped(table(spark, sf, "documents"), prefixes, "source").groupBy("domain").agg(F.count(F.lit(1)).alias("c"))
    return prefixes.select("domain").distinct().join(n, "domain", "left").select("domain", F.coalesce("c", F.lit(0)).cast("long").alias("n"), F.col("c").isNull().alias("unrouted"))


@query("""select doc_id, case when lang = 'es' then 'no_jurisdiction' when doc_id % 9 = 4 then 'no_retrieved_at' end as rejected, coalesce(nullif(lang, 'fr'), 'en') as language, case when doc_id % 2 = 0 then 'in_force' else 'unknown' end as status, cast(case when doc_id % 5 = 0 then doc_id % 3 + 1 else 3 end as int) as priority, md5(trim(substr(trim(text), 1, 500))) as text_md5 from documents""")
def evidence_projection(spark, sf):
    """Required provenance, defaults, and capped optional text."""
    d = table(spark, sf, "documents")
    key = F.col("doc_id")
    rows = d.select(
        key, F.col("source").alias("act"), F.when(F.col("lang") != "es", F.col("lang")).alias("jurisdiction"), F.concat(F.lit("https://x/"), key.cast("string")).alias("url"), F.sha2("text", 256).alias("sha"),
        F.when(key % 9 == 4, "yesterday").otherwise("2024-01-01T00:00:00Z").alias("retrieved_at"), F.nullif("lang", F.lit("fr")).alias("language"), F.when(key % 2 == 0, "in_force").alias("status"),
        F.when(key % 5 == 0, key % 3 + 1).cast("int").alias("priority"), "text",
    )
    out = P.evidence(rows)
    return out.select("doc_id", "rejected", "language", "status", "priority", F.md5("text").alias("text_md5"))


@query("""with e as (select event_id, json_extract_string(props, '$.k') as k, event_type, value from events)
 select event_id, case when lower(trim(event_type)) in ('', 'click', 'none') then null else trim(event_type) end as kind, value is not null and value > 50 as over from e""")
def cleaned_fields(spark, sf):
    """P10: sentinel strings become null; trimmed values stay."""
    e = table(spark, sf, "events")
    return e.select("event_id", P.without_sentinels(F.col("event_type"), ["click", "none"]).alias("kind"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("over"))


@query("""select conv_id, string_agg(trim(text), ' ' order by turn, trim(text)) as query_text, count(*) as n_facts from conversations where role = 'user' and trim(text) <> '' group by conv_id""")
def case_query_text(spark, sf):
    """Summary and facts of a case as one query."""
    c = table(spark, sf, "conversations").where("role = 'user' and trim(text) <> ''")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("x"))))
    return c.groupBy("conv_id").agg(parts.alias("p"), F.count(F.lit(1)).alias("n_facts")).select("conv_id", F.concat_ws(" ", F.transform("p", lambda x: x["x"])).alias("query_text"), "n_facts")


@query("""select p_partkey, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) as place, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') as mapping_key,
 trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, trim(lower(regexp_replace(p_name, '\\s+', ' ', 'g'))) as quote from part""")
def name_keys(spark, sf):
    """Keys of names."""
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", T.place_key(n).alias("place"), T.ascii_key(n).alias("mapping_key"), T.slug(n).alias("slug"), T.quote_key(n).alias("quote"))


@query("""with m as (select doc_id, list_distinct(regexp_extract_all(lower(text), '(?:section|article|rule|order)\\s+\\d+[a-z]{0,2}')) as refs, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as mails from documents)
 select doc_id, cast(len(refs) as int) as n_refs, cast(len(mails) as int) as n_mails from m""")
def prose_refs(spark, sf):
    """Provision references and e-mail addresses in prose."""
    mails = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0))
    return table(spark, sf, "documents").select("doc_id", F.size(T.provision_refs(F.col("text"))).alias("n_refs"), F.size(mails).alias("n_mails"))


@query("""with c as (select conv_id, turn, list_filter(str_split(text, ' '), lambda x: x <> '') as w from conversations)
 select conv_id, turn, len(w) > 0 and len(w) <> len(list_distinct(w)) as has_duplicates, len(w) = 0 as is_blank from c""")
def list_checks(spark, sf):
    """Blank members and duplicates of a list field."""
    w = F.filter(F.split("text", " "), lambda x: x != "")
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.size(w) != F.size(F.array_distinct(w))).alias("has_duplicates"), (F.size(w) == 0).alias("is_blank"))


@query("select conv_id, turn, 'claim-' || row_number() over (partition by conv_id order by turn, text) as claim_id from conversations")
def renumbered_claims(spark, sf):
    """Claims of an answer as claim-1, claim-2 ... in order."""
    return P.renumber(table(spark, sf, "conversations"), "conv_id", ["turn", "text"]).select("conv_id", "turn", "claim_id")


@query("""select lang, bool_or(length(text) > 1200) as any_truncated, array_to_string(list_sort(list_distinct(list(case when doc_id % 3 = 0 then source end))), ',') as undated from documents group by lang""")
def bundle_warnings(spark, sf):
    """Truncation and the acts without a date, of each bundle."""
    d = table(spark, sf, "documents")
    undated = F.sort_array(F.collect_set(F.when(F.col("doc_id") % 3 == 0, F.col("source"))))
    return d.groupBy("lang").agg(F.bool_or(F.length("text") > 1200).alias("any_truncated"), F.array_join(undated, ",").alias("undated"))
