"""Queries of builds, traces, directories, worksheets and guards; small reviewed lists are made of the star schema's rows."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as B
from ..operators import chunks as C
from ..operators import embedding as V
from ..operators import evaluation as E
from ..operators import filters as P
from ..operators import gazette as G
from ..operators import mappings as M
from ..operators import records as R
from ..operators import rules as U
from ..sources import corpus as S
from ..sources.store import Store, dealt_out
from .corpus import PAGES_SQL, _pages
from .registry import query, table

key = F.col


@query(f"""with {PAGES_SQL}, s as (select source, page_number, case when length(regexp_replace(text, '[\\s\\x0b]', '', 'g')) = 0 then 'none' when length(regexp_replace(text, '[\\s\\x0b]', '', 'g')) < 20 and length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 5 then 'insufficient' else 'digital' end as status, trim(text) <> '' as filled from pages_),
 p as (select source, count(*) as pages, count(*) filter (status = 'none') as empty_pages, count(*) filter (status <> 'digital') as scan_pages, string_agg(page_number, ',' order by page_number) filter (status <> 'digital') as scan_review, count(*) filter (filled) as chunks from s group by source)
 select doc_id as source_id, doc_id % 5 <> 0 as required, case when reason is null then 'succeeded' else 'failed' end as status, reason, pages, empty_pages, scan_pages, coalesce(scan_review, '') as scan_review, chunks
 from (select doc_id, p.*, case when doc_id % 7 = 3 then 'not_checked' when doc_id % 11 = 5 then 'byte_count' when pages = empty_pages then 'no_text' when chunks = 0 then 'no_chunks' end as reason from documents join p on p.source = doc_id)""")
def source_report(spark, sf):
    """Each document as a source, with its pages, chunks, pages to review, and the first failure."""
    docs = table(spark, sf, "documents").select("doc_id")
    manifest = docs.select(key("doc_id").alias("source_id"), key("doc_id").alias("position"), (key("doc_id") % 5 != 0).alias("required"))
    checks = docs.where("doc_id % 7 <> 3").select(key("doc_id").alias("source_id"), F.when(key("doc_id") % 11 == 5, "byte_count").otherwise("ok").alias("reason"))
    pages = _pages(spark, sf).select(key("source").alias("source_id"), "page_number", "text", T.page_status(key("text"), F.lit(False)).alias("status"))
    out = B.source_report(manifest, checks, pages, pages.select("source_id", "text"))
    return out.select("source_id", "required", "status", "reason", "pages", "empty_pages", "scan_pages", F.array_join("scan_review", ",").alias("scan_review"), "chunks")


@query("""select 'all' as manifest, count(*) as selected, count(*) filter (not bad) as succeeded, count(*) filter (bad) as failed, count(*) filter (bad and doc_id % 5 <> 0) as required_failures
 from (select doc_id, doc_id % 7 = 3 or doc_id % 11 = 5 or length(regexp_replace(text, '[\\s\\x0b]', '', 'g')) = 0 as bad from documents)""")
def build_summary(spark, sf):
    """Sources selected, succeeded, failed, and failures of required ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    manifest = docs.select(key("doc_id").alias("source_id"), key("doc_id").alias("position"), (key("doc_id") % 5 != 0).alias("required"))
    checks = docs.where("doc_id % 7 <> 3").select(key("doc_id").alias("source_id"), F.when(key("doc_id") % 11 == 5, "byte_count").otherwise("ok").alias("reason"))
    pages = docs.select(key("doc_id").alias("source_id"), F.lit(1).alias("page_number"), "text", T.page_status(key("text"), F.lit(False)).alias("status"))
    return B.build_summary(B.source_report(manifest, checks, pages, pages.select("source_id", "text"))).withColumn("manifest", F.lit("all"))


FILTERS = [(1, None, "en", None, None, "1996-06-15", False), (2, "src1", None, "IN_FORCE", None, None, True), (3, None, None, None, "de", "1995-01-01", True)]
START_SQL = "case doc_id % 6 when 0 then null when 1 then 'soon' else cast(date '1994-01-01' + cast(doc_id % 900 as int) as varchar) end"
END_SQL = "case doc_id % 5 when 0 then null else cast(date '1995-01-01' + cast(doc_id % 900 as int) as varchar) end"
DATED_SQL = "case when t is not null and try_cast(t as date) is null then false when f is null then undated when try_cast(f as date) is null then false else cast(f as date) <= day and (t is null or cast(t as date) >= day) end"


@query(f"""with q(filter_id, jurisdiction, language, status, act, day, undated) as (values (1, null, 'en', null, null, date '1996-06-15', false), (2, 'src1', null, 'IN_FORCE', null, null, true), (3, null, null, null, 'de', date '1995-01-01', true)),
 d as (select doc_id, source, lang, case when doc_id % 4 <> 0 then 'in_force' end as st, {START_SQL} as f, {END_SQL} as t, case when doc_id % 3 = 1 then 'p' || (doc_id % 4) end as profile from documents)
 select * from (select filter_id, doc_id, case when jurisdiction is not null and source <> jurisdiction then 'jurisdiction' when language is not null and lang <> language then 'language'
  when status is not null and (st is null or st <> lower(status)) then 'status' when act is not null and lang <> act then 'act' when profile is not null and profile <> 'p0' then 'profile'
  when day is not null and not ({DATED_SQL}) then 'date' end as reason from d, q) where reason is not null""")
def exclusion_events(spark, sf):
    """Every document that a filter removes, and the first rule that it fails."""
    k, day = key("doc_id"), lambda d: F.date_add(F.lit(d).cast("date"), (F.col("doc_id") % 900).cast("int")).cast("string")
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.when(k % 4 != 0, "in_force").alias("st"), F.when(k % 6 == 0, None).when(k % 6 == 1, "soon").otherwise(day("1994-01-01")).alias("f"),
        F.when(k % 5 != 0, day("1995-01-01")).alias("t"), F.when(k % 3 == 1, F.concat(F.lit("p"), (k % 4).cast("string"))).alias("profile"),
    )
    wanted = spark.createDataFrame(FILTERS, "filter_id int, jurisdiction string, language string, status string, act string, day string, undated boolean").withColumn("day", key("day").cast("date"))
    doc = {"jurisdiction": key("source"), "language": key("lang"), "status": key("st"), "act": key("lang"), "effective_from": key("f"), "effective_to": key("t"), "profile": key("profile")}
    asked = {c: key(c) for c in ("jurisdiction", "language", "status", "act")}
    renamed = wanted.select("filter_id", *[key(c).alias(f"q_{c}") for c in asked], "day", "undated")
    why = B.failing_filter(doc, {c: key(f"q_{c}") for c in asked}, key("day"), key("undated"), F.array(F.lit("p0")))
    return B.exclusion_events(docs, renamed, why)


@query("select chunk_id, file_source, n_chars from (select source || ':' || doc_id as chunk_id, source as file_source, length(text) as n_chars from documents where trim(text, ' ') <> '')")
def chunk_files(spark, sf):
    """Chunks written as JSON lines, a folder for each source, and read again."""
    store = Store(spark)
    docs = table(spark, sf, "documents")
    S.write_chunks(docs.select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("chunk_id"), key("source").alias("source_id"), "text"), f"{store.path}/chunks")
    back = S.read_chunks(spark, f"{store.path}/chunks", schema="chunk_id string, text string, source_id string")
    return back.select("chunk_id", key("source_id").alias("file_source"), F.length("text").alias("n_chars"))


@query("""with m as (select p_partkey as k, 's' || (p_partkey % 1500) as id, lower('F' || (p_partkey % 1900) || '.pdf') as file, case when p_size % 7 = 0 then 'bad.org' else 'h.org' end as host, p_size % 9 = 0 as late,
  case when p_partkey % 3 = 0 then 'amendment' else 'principal' end as rel, case when p_partkey % 3 = 0 then case when p_partkey % 2 = 0 then 's' || (p_partkey % 1600) end end as target from part),
 e as (select id, target from m where target is not null)
 select 'duplicate_id' as rule, id as key from m group by id having count(*) > 1 union all select 'duplicate_filename', file from m group by file having count(*) > 1 union all select 'host', id from m where host <> 'h.org'
 union all select 'date_order', id from m where late union all select 'amends_nothing', id from m where rel = 'amendment' and target is null union all select 'amends_itself', id from e where id = target
 union all select 'unknown_target', id from e where target not in (select id from m) union all select 'target_not_principal', e.id from e join m on m.id = e.target where m.rel <> 'principal'""")
def manifest_violations(spark, sf):
    """Every constraint of a source manifest, broken by some rows."""
    k = key("p_partkey")
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    target = F.when((k % 3 == 0) & (k % 2 == 0), F.array(name(k % 1600))).otherwise(F.array().cast("array<string>"))
    m = table(spark, sf, "part").select(
        name(k % 1500).alias("source_id"), F.concat(F.lit("F"), (k % 1900).cast("string"), F.lit(".PDF")).alias("filename"), F.when(key("p_size") % 7 == 0, "https://bad.org/x").otherwise("https://h.org/x").alias("url"), F.array(F.lit("h.org")).alias("allowed_hosts"),
        F.lit("2024-02-01").cast("date").alias("effective_from"), F.when(key("p_size") % 9 == 0, "2024-01-01").cast("date").alias("effective_to"), F.when(k % 3 == 0, "amendment").otherwise("principal").alias("relationship"), target.alias("modifies_source_ids"),
    )
    return R.manifest_violations(m).select("rule", "key")


@query("select source_id, position from (select source as source_id, cast(substr(source, 4) as int) as position from documents group by source) where source_id in ('src7', 'src2', 'src1')")
def selected_sources(spark, sf):
    """The sources asked for, trimmed and once each, with their place in the manifest."""
    m = table(spark, sf, "documents").select(key("source").alias("source_id")).distinct().withColumn("position", F.substring("source_id", 4, 9).cast("int"))
    return R.selected_sources(m, [" src7", "src2", "src1 ", "src2", "none"])[0].select("source_id", "position")


@query("""with w as (select event_id, user_id % 4 as d, case when user_id % 5 = 0 then 'soon' when user_id % 5 = 1 then '2024-01-09' else strftime(ts, '%Y-%m-%d') end as day, event_type, props from events)
 select event_id, case when try_cast(day as date) <= date '2024-01-05' then cast(day as date) end as day, case d when 0 then 'civil' when 1 then 'labour' else 'other' end as domain, nullif(trim(substr(trim(' ' || props || ' '), 1, 7)), '') as capped, case when d = 0 then 'x' else 'x,' || event_type end as listed from w""")
def cleaned_record(spark, sf):
    """P10: malformed and future dates, unknown domains, capped text, cleaned lists."""
    u = key("user_id")
    e = table(spark, sf, "events").select("event_id", "event_type", "props", (u % 4).alias("d"), F.when(u % 5 == 0, "soon").when(u % 5 == 1, "2024-01-09").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    domain = F.get(F.array(*[F.lit(x) for x in (" Civil", "LABOUR", "tax", "")]), key("d").cast("int"))
    listed = F.array(F.lit(" x"), F.lit(" "), F.lit("x"), F.when(key("d") == 0, "x ").otherwise(key("event_type")))
    return e.select("event_id", P.past_day(key("day"), F.lit("2024-01-05").cast("date")).alias("day"), P.known_domain(domain, ["civil", "labour"]).alias("domain"), P.capped(F.concat(F.lit(" "), "props", F.lit(" ")), 7).alias("capped"), F.array_join(P.clean_list(listed), ",").alias("listed"))


@query("""select c_custkey, case c_custkey % 3 when 0 then c_name else c_mktsegment end as name, case c_custkey % 4 when 0 then 'civil' when 1 then lower(c_mktsegment) when 2 then lower(c_mktsegment) else 'other' end as domain from customer""")
def typed_fields(spark, sf):
    """Typed values before extracted ones; a typed domain only if it is not ``other``."""
    k, segment = key("c_custkey"), F.lower("c_mktsegment")
    typed = F.when(k % 3 == 0, key("c_name")).when(k % 3 == 1, "  ")
    domain = F.get(F.array(F.lit("civil"), F.lit("other"), F.lit(" "), F.lit("other")), (k % 4).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", P.typed_or_extracted(typed, key("c_mktsegment")).alias("name"), P.typed_domain(domain, F.when(k % 4 != 3, segment)).alias("domain"))


@query("""with w as (select conv_id * 1000 + turn as key, list_transform(list_append(string_split(text, ' '), case when turn % 3 = 0 then ' ' else 'zz' end), lambda x: trim(x)) as w, case when conv_id % 7 = 0 then ' ' else role end as s from conversations)
 select distinct * from (select 'blank_member' as rule, key, 'words' as field from w where list_contains(w, '') union all select 'duplicate_member', key, 'words' from w where len(w) <> len(list_distinct(w)) union all select 'blank', key, 'role' from w where trim(s) = '')""")
def list_violations(spark, sf):
    """Blank and repeated members, and blank scalars."""
    words = F.concat(F.split("text", " "), F.array(F.when(key("turn") % 3 == 0, " ").otherwise("zz")))
    c = table(spark, sf, "conversations").select((key("conv_id") * 1000 + key("turn")).alias("k"), words.alias("words"), F.when(key("conv_id") % 7 == 0, " ").otherwise(key("role")).alias("role"))
    return P.list_violations(c, "k", ["words"], ["role"]).distinct()


@query("select domain, doc_id from documents, (values ('civil', 'src1'), ('other', 'none')) p(domain, prefix) where domain = 'other' or starts_with(source, prefix)")
def scoped_other(spark, sf):
    """The domain ``other`` has everything."""
    return P.scoped(table(spark, sf, "documents"), spark.createDataFrame([("civil", "src1"), ("other", "none")], "domain string, prefix string"), "source").select("domain", "doc_id")


LINES = r"""l0 as (select doc_id as source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos, len(string_split(text, chr(10))) as n from documents), l1 as (select source, pos - 1 as line_no, line from l0 where not (pos = n and line = '')),
 s as (select *, sum(case when regexp_matches(line, '^\p{Lu}\p{L}* ') then 1 else 0 end) over (partition by source order by line_no rows between unbounded preceding and current row) as segment from l1),
 g as (select source, segment, first(line order by line_no) as line, string_agg(rtrim(line, ' '), chr(10) order by line_no) as text from s group by all)"""


@query(f"""with {LINES}, h as (select source, segment, case when segment = 0 then 'preamble' else trim(regexp_replace(lower(regexp_extract(line, '^\\p{{L}}+')), '[^a-z0-9]+', '-', 'g'), '-') end as slug from g where trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '')
 select source, cast(segment as bigint) as segment, source || ':section-' || slug || case when row_number() over (partition by source, slug order by segment) > 1 then '-' || row_number() over (partition by source, slug order by segment) else '' end as chunk_id from h""")
def section_ids(spark, sf):
    """The id of each section; a slug that comes again gets a number."""
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[\u000b\u000c\r\u001c-\u001e\u0085  ]", " ").alias("text"))
    rows = C.boundaries(C.lines(C.pages(docs, "doc_id", "text")), r"^\p{Lu}\p{L}* ", "^\u0001", "^\u0001", leader=r"\u0000")
    return C.sections(rows, F.regexp_extract("line", r"^\p{L}+", 0)).select("source", "segment", "chunk_id")


@query()
def gazette_rules(spark, sf):
    """Each document as a gazette: an opening rule, then its lines as numbered rules with notes between, and running heads."""
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 3 == 1, x).when(k % 7 == 5, F.concat(F.lit("THE GAZETTE OF INDIA : EXTRAORDINARY "), x)).otherwise(F.concat((F.floor(k / 2) + 2).cast("string"), F.lit(". "), x)))
    opening = F.concat(F.lit("1. Short title and commencement.—(1) These rules may be called the "), "source", F.lit(" Rules."))
    docs = dealt_out(table(spark, sf, "documents").select("doc_id", "source", "text"))
    pages = docs.select(key("doc_id").alias("source"), F.lit(1).alias("page_number"), F.array_join(F.concat(F.array(opening), lines), "\n").alias("text"))
    return G.gazette_rules(C.lines(pages)).select("source", "chunk_id", "heading", F.md5("text").alias("text_md5"), "instrument_title")


@query("""with w as (select conv_id, turn, unnest(string_split(text, ' ')) as x, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from conversations where turn < 4), v as (select conv_id % 50 as page_num, conv_id as block_num, turn, pos // 8 as line_num, pos as word_num, (pos * 37 + turn) % 140 - 20 as conf, x from w where trim(x) <> '')
 select page_num, block_num, turn as par_num, line_num, md5(string_agg(x, ' ' order by word_num, x)) as text_md5, round(avg(case when conf between 0 and 100 then conf end), 6) as confidence from v group by all""")
def ocr_lines(spark, sf):
    """Words to lines, with the mean of confidences from 0 to 100."""
    c = table(spark, sf, "conversations").where("turn < 4").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    pos = key("pos")
    words = c.select((key("conv_id") % 50).alias("page_num"), key("conv_id").alias("block_num"), key("turn").alias("par_num"), F.floor(pos / 8).alias("line_num"), pos.alias("word_num"), ((pos * 37 + key("turn")) % 140 - 20).alias("conf"), "text")
    return C.ocr_lines(words).select("page_num", "block_num", "par_num", "line_num", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"))


@query("""with k as (select s_nationkey as n, list(distinct right('0000000' || (s_suppkey * 7919 % 100), 6)) as tails from supplier where s_nationkey % 5 <> 0 group by 1)
 select c_custkey, case when tails is null then 'not_in_snapshot' when c_custkey % 9 = 0 then 'no_phone' when list_contains(tails, right('0000000' || (c_custkey % 100), 6)) then 'agrees' else 'conflicts' end as verdict from customer left join k on n = c_nationkey""")
def phone_check(spark, sf):
    """contacts' numbers against any known number of the state, by the last six digits."""
    number = lambda x: F.concat(F.lit("011-0000000"), x.cast("string"))
    known = table(spark, sf, "supplier").where("s_nationkey % 5 <> 0").select(key("s_nationkey").alias("state"), number(key("s_suppkey") * 7919 % 100).alias("phone"))
    mine = table(spark, sf, "customer").select("c_custkey", key("c_nationkey").alias("state"), F.when(key("c_custkey") % 9 != 0, number(key("c_custkey") % 100)).alias("phone"))
    return R.phone_check(mine, known).select("c_custkey", "verdict")


@query("""select p_partkey, cast(len(list_filter([cast(p_partkey as varchar), p_size || '0', '', '9'], lambda x: x <> '')) as int) as n_phones, p_partkey || ',' || p_size || '0,9' as phones, lower(p_size || case when p_partkey % 2 = 0 then 'A' else '' end) as section from part""")
def phone_lists(spark, sf):
    """Numbers of a list, and section keys."""
    text = F.concat(F.lit("tel "), key("p_partkey").cast("string"), F.lit(" / "), key("p_size").cast("string"), F.lit("-0 and x; 9"))
    phones = T.phone_numbers(text)
    section = F.concat(F.lit(" "), key("p_size").cast("string"), F.when(key("p_partkey") % 2 == 0, "A").otherwise(""), F.lit("(5)"))
    return table(spark, sf, "part").select("p_partkey", F.size(phones).alias("n_phones"), F.array_join(phones, ",").alias("phones"), T.section_key(section).alias("section"))


@query("""with l as (select doc_id, unnest(['x The Gazette of India: Extraordinary', left(text, 30), case when doc_id % 3 = 0 then chr(57345) || 'y' else '[PART II—SEC. 3' end, 'भारत  का राजपत्र', 'plain ' || doc_id]) as line from documents)
 select doc_id, count(*) filter (not regexp_matches(line, '(?i)the gazette of india\\s*:\\s*extraordinary|\\[?part\\s+ii[—-]sec\\.|भारत\\s+का\\s+रा\\S*पत्र|\\[?भाग\\s*ii|[\\x{E000}-\\x{F8FF}]')) as kept from l group by doc_id""")
def noise_lines(spark, sf):
    """Lines without running heads and private-use marks."""
    lines = F.array(F.lit("x The Gazette of India: Extraordinary"), F.left("text", F.lit(30)), F.when(key("doc_id") % 3 == 0, "y").otherwise("[PART II—SEC. 3"), F.lit("भारत  का राजपत्र"), F.concat(F.lit("plain "), key("doc_id").cast("string")))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.transform(lines, lambda x: F.split(x, "\n")[0])).alias("line"))
    return G.without_noise(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""with m as (select 'm' || (p_partkey % 1800) as id, p_size % 3 as n, p_size % 4 as m, ['exact', 'split', 'merged', 'omitted', 'no_direct_equivalent', 'partial'][1 + p_partkey % 6] as kind, p_partkey % 13 = 0 as swapped, p_partkey % 17 = 0 as open from part)
 select 'duplicate_id' as rule, id as key from m group by id having count(*) > 1
 union all select 'shape', id from m where not ((case when kind in ('omitted', 'no_direct_equivalent') then m = 0 else m >= 1 end) and case kind when 'exact' then n = 1 and m = 1 when 'split' then n = 1 and m >= 2 when 'merged' then n >= 2 else true end)
 union all select 'code_side', id from m where swapped and n > 0 union all select 'placeholder', id from m where open""")
def mapping_violations(spark, sf):
    """The shape of each mapping type, codes of each side, unset fields of reviewed ones, unique ids."""
    k, size = key("p_partkey"), key("p_size")
    side = lambda n, code: F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= n), lambda i: F.struct(code.alias("code"), i.cast("string").alias("section")))
    kind = F.get(F.array(*[F.lit(x) for x in ("exact", "split", "merged", "omitted", "no_direct_equivalent", "partial")]), (k % 6).cast("int"))
    maps = table(spark, sf, "part").select(
        F.concat(F.lit("m"), (k % 1800).cast("string")).alias("mapping_id"), side(size % 3, F.when(k % 13 == 0, "BNS").otherwise("IPC")).alias("source_provisions"), side(size % 4, F.lit("BNS")).alias("target_provisions"),
        kind.alias("mapping_type"), F.lit("reviewed").alias("review_status"), F.when(k % 17 == 0, "REVIEWER_MUST_SET").otherwise("someone").alias("reviewed_by"),
    )
    return M.mapping_violations(maps).select("rule", "key")


@query("select doc_id as case_id, 'section ' || (doc_id % 50) as ref from documents where doc_id % 4 = 3")
def stage_text_guard(spark, sf):
    """References of a stage's text that no evidence of the case holds."""
    d, section = table(spark, sf, "documents"), (key("doc_id") % 50).cast("string")
    texts = d.select(key("doc_id").alias("case_id"), F.concat(F.lit("As Section "), section, F.lit(" says. "), F.when(key("doc_id") % 4 == 2, F.concat(F.lit("See s:"), key("doc_id").cast("string"))).otherwise("")).alias("text"))
    held = F.when(key("doc_id") % 4 == 0, section).otherwise("none")
    evidence = d.select(key("doc_id").alias("case_id"), F.when(key("doc_id") % 4 == 2, F.concat(F.lit("s:"), key("doc_id").cast("string"))).otherwise("\u0001").alias("source_id"), held.alias("section"), F.when(key("doc_id") % 4 == 1, F.concat(F.lit("by section "), section)).otherwise("").alias("excerpt"))
    return U.stage_text_violations(texts, evidence)


@query("""with e as (select l_orderkey as case_id, l_partkey as source_id, l_returnflag <> 'N' as in_force, l_suppkey % 3 <> 0 as official, l_linenumber = 7 as zeros from lineitem), u as (select o_orderkey as case_id, o_custkey as source_id from orders where o_orderkey % 10 = 0)
 select case_id, 'not_in_force' as rule, source_id from e where not in_force union all select case_id, 'host', source_id from e where not official union all select case_id, 'digest', source_id from e where zeros
 union all select case_id, 'duplicate', source_id from e group by all having count(*) > 1 union all select case_id, 'missing', source_id from u where not exists (select 1 from e where e.case_id = u.case_id and e.source_id = u.source_id)""")
def evidence_gate(spark, sf):
    """Evidence that is not in force, of no official host, without a digest, or given twice; used ids that are missing."""
    e = table(spark, sf, "lineitem").select(
        key("l_orderkey").alias("case_id"), key("l_partkey").alias("source_id"), F.when(key("l_returnflag") == "N", "repealed").otherwise("in_force").alias("status"),
        F.when(key("l_suppkey") % 3 == 0, "https://x.org/").otherwise("https://a.gov.in/b").alias("official_url"), F.when(key("l_linenumber") == 7, F.repeat(F.lit("0"), 64)).otherwise(F.sha2(key("l_partkey").cast("string"), 256)).alias("sha256"),
    )
    used = table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(key("o_orderkey").alias("case_id"), key("o_custkey").alias("source_id"))
    return U.evidence_problems(e, used, [])


def _directory(spark, sf):
    """Table rows made of suppliers: state rows and district rows."""
    k = key("s_suppkey")
    state = F.concat(F.lit("Nation "), key("s_nationkey").cast("string"))
    phone = F.when(k % 4 != 0, F.concat(F.lit("011-"), k.cast("string"), F.lit(" and 7"))).otherwise("")
    mail = F.when(k % 3 != 0, F.concat(F.lit("n"), k.cast("string"), F.lit(" [at] gov [dot] in"))).otherwise("")
    states = table(spark, sf, "supplier").select(k.alias("row_no"), F.array(state, F.lit("SLSA"), phone, mail).alias("cells"))
    title = F.concat(F.lit("Secretary,  "), F.when(k % 5 == 0, "New ").otherwise(""), F.lit("North  "), k.cast("string"), F.lit(", DLSA"))
    districts = table(spark, sf, "supplier").select(F.array(key("s_name"), F.when(k % 7 != 0, title).otherwise("Clerk"), mail, phone).alias("cells"))
    return states, districts


@query("""with s as (select *, s_suppkey % 4 <> 0 as phone, s_suppkey % 3 <> 0 as mail, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier where s_nationkey < 20)
 select 'Nation ' || s_nationkey as state, case when phone then '011' || s_suppkey || ',7' else '' end as phones, case when mail then 'n' || s_suppkey || '@gov.in' else '' end as email from s where k = 1 and (phone or mail)""")
def directory_rows(spark, sf):
    """The first row of each listed state that can be reached."""
    out = R.directory_rows(_directory(spark, sf)[0], [f"Nation {k}" for k in range(20)])
    return out.select("state", F.array_join("phones", ",").alias("phones"), "email")


@query("""select 'delhi-dlsa-' || case when s_suppkey % 5 = 0 then 'new-' else '' end || 'north-' || s_suppkey as contact_id, case when s_suppkey % 5 = 0 then 'New ' else '' end || 'North ' || s_suppkey as district, s_name as officer_name, 'n' || s_suppkey || '@gov.in' as email, '011-' || s_suppkey || ' and 7' as phone
 from supplier where s_suppkey % 7 <> 0 and s_suppkey % 4 <> 0 and s_suppkey % 3 <> 0""")
def district_contacts(spark, sf):
    """Contacts of districts from rows with a secretary."""
    return R.district_contacts(_directory(spark, sf)[1]).select("contact_id", "district", "officer_name", "email", "phone")


@query("""with c as (select 'c' || (c_custkey % 1400) as id, case when c_nationkey = 3 then 'Goa' else 'Delhi' end as state, case when c_custkey % 10 < 8 then 'north ' || (c_custkey % 1300) end as district from customer)
 select 'duplicate_contact' as rule, id as key from c group by id having count(*) > 1 union all select 'duplicate_district', district from c where district is not null group by district having count(*) > 1
 union all select 'foreign_district', id from c where district is not null and state <> 'Delhi' union all select 'missing_fallback', 'f3' union all select 'missing_fallback', 'f3' union all select 'unreviewed_fallback', 'f2'""")
def directory_violations(spark, sf):
    """Unique contacts and districts, home districts only, required fallbacks with their phones."""
    k = key("c_custkey")
    contacts = table(spark, sf, "customer").select(F.concat(F.lit("c"), (k % 1400).cast("string")).alias("contact_id"), F.when(key("c_nationkey") == 3, "Goa").otherwise("Delhi").alias("state"), F.when(k % 10 < 8, F.concat(F.lit(" North, "), (k % 1300).cast("string"))).alias("district"))
    fallbacks = spark.createDataFrame([("f1", "15100", "India"), ("f2", "1", "India")], "fallback_id string, phone string, scope string")
    out = R.directory_violations(contacts, fallbacks, ["f1", "f3"]).unionByName(R.fallback_violations(fallbacks, {"f1": "15100", "f2": "14454", "f3": "3"}))
    return out.select("rule", "key")


@query("""select lower(replace(r_name, ' ', '-')) || '-' || row_number() over (partition by r_name order by n_nationkey) as candidate_id, r_name as state, n_name as district from nation join region on r_regionkey = n_regionkey""")
def district_candidates(spark, sf):
    """Districts of nested states, with ids by position."""
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), key("n_regionkey") == key("r_regionkey"))
    nested = both.groupBy(key("r_name").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("districts"))
    return R.district_candidates(nested)


def _table_rows(spark, sf):
    k, n = key("p_partkey"), (key("p_partkey") % 4).cast("int")
    refs = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.concat((i + k % 400).cast("string"), F.lit("(a)"))), ", ")
    old = F.when(n > 0, refs).when(k % 8 == 0, "New Section").otherwise("Deleted")
    cells = F.when(k % 10 == 9, F.array(key("p_name"), old, F.lit("x"))).when(k % 10 == 8, F.array(F.lit(""), old)).otherwise(F.array(key("p_name"), old))
    row = F.when(k % 6 != 5, F.concat(k.cast("string"), F.when(k % 5 == 0, ".2").otherwise("")))
    return table(spark, sf, "part").select(row.alias("row_id"), cells.alias("cells"))


ROWS_SQL = """t as (select p_partkey as k, p_partkey % 4 as n, p_name, case when p_partkey % 4 > 0 then list_transform(range(1, 1 + p_partkey % 4), lambda i: (i + p_partkey % 400) || '(a)') else [] end as refs from part where p_partkey % 10 < 8 and p_partkey % 6 <> 5),
 r as (select k || case when k % 5 = 0 then '.2' else '' end as row_id, k || case when k % 5 = 0 then '(2)' else '' end as reference, cast(k as varchar) as target, p_name as new_text, refs, case when n = 0 and k % 8 = 0 then 'new' when n = 0 then 'deleted' when n = 1 then 'corresponding' else 'possible_merge' end as hint from t)"""


@query(f"with {ROWS_SQL} select row_id, reference, new_text, array_to_string(refs, ',') as old_refs, hint from r")
def mapping_candidates(spark, sf):
    """Candidates from table rows with a row id and two cells."""
    return R.mapping_candidates(_table_rows(spark, sf)).select("row_id", "reference", "new_text", F.array_join("old_refs", ",").alias("old_refs"), "hint")


@query(f"""with {ROWS_SQL}, s as (select *, contains(lower(new_text), 'red')::int + contains(lower(new_text), 'ring')::int + contains(lower(new_text), 'small')::int as score from r where len(refs) > 0 and hint <> 'new' order by score desc, row_id limit 40)
 select cast(row_number() over (order by score desc, row_id) as int) as number, 'ipc-' || array_to_string(refs, '-') || '-bns-' || target as mapping_id, row_id, cast(score as int) as score, hint, target, target in (select cast(doc_id % 300 as varchar) from documents where lang = 'en') as text_held from s""")
def worksheet(spark, sf):
    """The 40 candidate pairs with most of the listed terms, for a reviewer (a top-n report)."""
    candidates = R.mapping_candidates(_table_rows(spark, sf)).withColumn("old_text", F.array_join("old_refs", " "))
    chunks = table(spark, sf, "documents").where("lang = 'en'").select(F.lit("bns_2023_en").alias("source_id"), (key("doc_id") % 300).cast("string").alias("section"))
    return R.worksheet(candidates, chunks, ["red", "ring", "small"], 40).drop("old_refs")


@query("""select p_partkey, 'candidate-' || lpad(cast(row_number() over (order by p_partkey) as varchar), 4, '0') as candidate_id, 'pending' as review_status, case when p_partkey % 3 = 0 then 'not_in_snapshot' when p_size % 5 = p_partkey % 5 then 'agrees' else 'conflicts' end as cross_check from part where p_partkey < 900""")
def stamped_candidates(spark, sf):
    """Imported rows with ids by position, their status, and the verdict of another source."""
    part = table(spark, sf, "part").where("p_partkey < 900")  # an import is a reviewed list of hundreds of rows
    snapshot = part.where("p_partkey % 3 <> 0").select(key("p_partkey").alias("left_key"), (key("p_size") % 5).alias("right_key"))
    checked = R.cross_check(part.select("p_partkey", key("p_partkey").alias("left_key"), (key("p_partkey") % 5).cast("int").alias("right_key"), F.lit(False).alias("no_ancestor")), snapshot)
    return R.stamped(checked, "p_partkey", "2024-01-01T00:00:00Z", "0").select("p_partkey", "candidate_id", "review_status", key("verdict").alias("cross_check"))


@query("""with d(deadline_id, domain, n, unit, dated, ok) as (values ('d1', 0, 30, 'day', true, true), ('d2', 0, 1, 'month', false, true), ('d3', 1, 2, 'year', true, false)),
 c as (select o_orderkey as case_id, o_custkey % 3 as domain, case when o_orderkey % 6 <> 0 then cast(o_orderdate as date) end as start from orders),
 j as (select case_id, deadline_id, start, dated, ok, cast(case unit when 'day' then start + to_days(n) when 'month' then start + to_months(n) else start + to_years(n) end as date) as due from c left join d on d.domain = c.domain)
 select case_id, deadline_id, due, date_diff('day', date '1996-01-31', due) as days_remaining, concat_ws(',', case when deadline_id is null then 'sources_silent' end, case when deadline_id is not null and start is null then 'no_start' end, case when not dated then 'unverified_commencement' end, case when not ok then 'unreviewed' end, case when due < date '1996-01-31' then 'expired' end) as notes from j""")
def consequences(spark, sf):
    """Due dates and notes of each case by the deadlines of its domain; silent sources too."""
    rows = [("d1", 0, 30, "day", "1990-01-01", "reviewed"), ("d2", 0, 1, "month", None, "reviewed"), ("d3", 1, 2, "year", "1990-01-01", "pending")]
    deadlines = spark.createDataFrame(rows, "deadline_id string, domain bigint, count int, unit string, effective_from string, review_status string")
    cases = table(spark, sf, "orders").select(key("o_orderkey").alias("case_id"), (key("o_custkey") % 3).alias("domain"), F.when(key("o_orderkey") % 6 != 0, F.to_date("o_orderdate")).alias("start"))
    out = R.consequences(cases, deadlines, F.lit("1996-01-31").cast("date"))
    return out.select("case_id", "deadline_id", "due", key("days_remaining").cast("long").alias("days_remaining"), F.array_join("notes", ",").alias("notes"))


@query("""with d as (select 'd' || (p_partkey % 1900) as id, p_size % 2 = 0 as risk, p_partkey % 3 as n from part) select 'duplicate_id' as rule, id as key from d group by id having count(*) > 1 union all select 'depends_on_nothing', id from d where risk and n = 0""")
def deadline_violations(spark, sf):
    """Deadlines whose practical risk depends on nothing that is stated."""
    k = key("p_partkey")
    d = table(spark, sf, "part").select(F.concat(F.lit("d"), (k % 1900).cast("string")).alias("deadline_id"), F.when(key("p_size") % 2 == 0, "practical_risk").otherwise("legal_bar").alias("consequence_kind"), F.when(k % 3 == 1, F.array(F.lit("x"))).when(k % 3 == 2, F.array(F.lit("x"), F.lit("y"))).alias("depends_on"))
    return R.deadline_violations(d).select("rule", "key")


@query("""select case_domain, doc_id as right_id from documents, (values ('de'), ('fr'), ('zz')) c(case_domain) where lang = case_domain or lang = 'es'""")
def rights_by_domain(spark, sf):
    """The entries of each domain and those that hold for all."""
    return R.rights(table(spark, sf, "documents").select(key("doc_id").alias("right_id"), key("lang").alias("domain")), ["de", "fr", "zz"], "es")


@query("""select doc_id, sha256('{"corpus":"' || sha256(text) || '","embedding":"m' || (doc_id % 3) || '","tag":"v1"}') as version from documents""")
def version_keys(spark, sf):
    """The version of an index over a corpus digest, an embedding key and a schema tag."""
    return table(spark, sf, "documents").select("doc_id", V.version_key(F.sha2("text", 256), F.concat(F.lit("m"), (key("doc_id") % 3).cast("string")), "v1").alias("version"))


@query("""select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || case when lang = 'fr' then 'null' else '"' || lang || '"' end || ',"source":"' || source || '","meta":[{"key":"a","value":"' || n_chars || '"},{"key":"b","value":"x"}]}') as digest from documents""")
def row_digests(spark, sf):
    """Canonical digests of rows with their metadata, whatever the order of its entries; nulls count."""
    meta = F.when(key("doc_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), key("n_chars").cast("string"))).otherwise(F.create_map(F.lit("a"), key("n_chars").cast("string"), F.lit("b"), F.lit("x")))
    d = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), "source", meta.alias("meta"))
    return d.select("doc_id", E.canonical_row(["doc_id", "source", "lang"], "meta").alias("digest"))


@query("""select 'duplicate_id' as rule, cast(user_id as varchar) as key from events group by user_id having count(*) > 1 union all select 'not_finite', cast(user_id as varchar) from events where event_id % 50 = 0 or event_id % 70 = 1""")
def fingerprint_violations(spark, sf):
    """Ids that come twice, and numbers that are not finite, in columns and in metadata."""
    value = F.when(key("event_id") % 50 == 0, float("inf")).otherwise(key("value"))
    meta = F.create_map(F.lit("k"), F.when(key("event_id") % 70 == 1, "NaN").otherwise(key("props")))
    return E.fingerprint_violations(table(spark, sf, "events").select("user_id", value.alias("value"), meta.alias("meta")), "user_id", ["value"], "meta")


RANKED_SQL = "r as (select doc_id % 400 as query_id, doc_id, row_number() over (partition by doc_id % 400 order by md5(doc_id::varchar), doc_id) as rank from documents)"


@query(f"""with {RANKED_SQL}, h as (select query_id, min(rank) filter (quality = 1) as first_hit from r left join labels using (doc_id) group by query_id)
 select 'md5' as system, query_id, cast(first_hit as int) as first_hit from h where first_hit is null or first_hit > 1""")
def missed_queries(spark, sf):
    """The queries without an accepted hit in the first place."""
    from pyspark.sql import Window as W

    q = key("doc_id") % 400
    ranked = table(spark, sf, "documents").select(q.alias("query_id"), "doc_id", F.row_number().over(W.partitionBy(q).orderBy(F.md5(key("doc_id").cast("string")), "doc_id")).alias("rank"), F.lit("md5").alias("system"))
    accepted = table(spark, sf, "labels").where("quality = 1").select(q.alias("query_id"), "doc_id")
    return E.missed(ranked, accepted, 1)


@query("""with r as (select doc_id, sha256(text) as sha, strlen(text) as n from documents where doc_id % 7 <> 3), x as (select d.doc_id, r.doc_id as rid, case when d.doc_id % 13 = 2 then false else true end as ok, d.doc_id % 11 = 5 as longer, d.doc_id % 17 = 4 as unzoned from documents d left join r using (doc_id))
 select doc_id as source_id, case when rid is null then 'missing_receipt' when not ok then 'sha256' when longer then 'byte_count' when unzoned then 'downloaded_at' else 'ok' end as reason from x""")
def receipt_reasons(spark, sf):
    """The first check that each document fails against its receipt."""
    from ..sources.receipts import verify

    d, k = table(spark, sf, "documents"), key("doc_id")
    sha = F.when(k % 13 == 2, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.upper(F.sha2("text", 256)))
    receipts = d.where("doc_id % 7 <> 3").select(
        k.alias("source_id"), sha.alias("sha256"), (F.octet_length("text") + F.when(k % 11 == 5, 1).otherwise(0)).cast("long").alias("byte_count"), F.when(k % 17 == 4, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("downloaded_at")
    )
    return verify(d.select(k.alias("source_id"), F.encode("text", "UTF-8").alias("content")), receipts)


@query(f"""with {LINES} select source, cast(segment as bigint) as segment, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) as text_md5 from g where trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def section_texts(spark, sf):
    """The text of each section."""
    docs = dealt_out(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace("text", "[\u000b\u000c\r\u001c-\u001e\u0085\u2028\u2029]", " ").alias("text"))
    rows = C.boundaries(C.lines(C.pages(docs, "doc_id", "text")), r"^\p{Lu}\p{L}* ", "^\u0001", "^\u0001", leader=r"\u0000")
    return C.sections(rows, F.regexp_extract("line", r"^\p{L}+", 0)).select("source", "segment", F.md5("text").alias("text_md5"))


@query("select source as folder, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes from documents where source <> 'src0' group by source")
def file_totals(spark, sf):
    """Files and bytes of each folder, without an excluded one."""
    return table(spark, sf, "documents").where("source <> 'src0'").groupBy(key("source").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("select p_name as alias, count(*) as n from part group by p_name having count(*) > 1")
def alias_violations(spark, sf):
    """T4: aliases that are one key, whatever their case and marks."""
    from ..operators.retrieval import alias_violations as found

    marked = F.when(key("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("  "), F.regexp_replace("p_name", " ", ", ")))
    return found(table(spark, sf, "part").select(marked.alias("alias")))


@query("""select doc_id, case when doc_id % 5 = 0 then 'hi' when doc_id % 5 = 1 then 'mixed' when doc_id % 5 = 2 then 'und' when doc_id % 5 = 3 then 'mixed' else 'en' end as language, cast(case when doc_id % 5 in (0, 1) then 3 else 0 end as bigint) as devanagari from documents""")
def devanagari_script(spark, sf):
    """Devanagari, both scripts, neither, romanised markers, and Latin."""
    k = key("doc_id") % 5
    text = F.when(k == 0, "हिन्दी 12").when(k == 1, "हिन्दी text").when(k == 2, "12 ?").when(k == 3, "The car and DER of").otherwise("the cat")
    d = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return d.select("doc_id", T.language_by_script(key("text"), ["the", "der", "les"]).alias("language"), T.script_counts(key("text"))[0].cast("long").alias("devanagari"))


@query("""select c_custkey, sha256('{"acctbal":' || case when c_custkey % 5 = 0 then 'null' else '"' || c_mktsegment || '"' end || ',"case":' || c_custkey || ',"name":"' || c_name || '"}') as digest from customer""")
def case_json_fingerprint(spark, sf):
    """The digest of a case as canonical JSON: names in order, nulls kept."""
    c = table(spark, sf, "customer").select("c_custkey", key("c_custkey").alias("case"), key("c_name").alias("name"), F.when(key("c_custkey") % 5 != 0, key("c_mktsegment")).alias("acctbal"))
    return c.select("c_custkey", E.canonical_row(["name", "case", "acctbal"]).alias("digest"))


@query("""with e as (select doc_id, source, lang, doc_id // 1000 as run, case when length(text) <= 300 then text when instr(substr(text, 1, 300), ' ') > 0 and 300 - instr(reverse(substr(text, 1, 300)), ' ') > 150 then rtrim(substr(text, 1, 300 - instr(reverse(substr(text, 1, 300)), ' '))) else rtrim(substr(text, 1, 300)) end as excerpt from documents)
 select source, lang, cast(run as bigint) as run, md5(string_agg(doc_id || ':' || md5(excerpt) || ':' || case when doc_id % 3 = 0 then 'true' else 'false' end, ',' order by doc_id)) as excerpts_md5 from e group by all""")
def grounding_excerpts(spark, sf):
    """The excerpts of each record, and whether the commencement of each is proven."""
    d = table(spark, sf, "documents").withColumn("since", F.when(key("doc_id") % 3 == 0, F.lit("2024-01-01").cast("date")))
    out = P.grounding_runs(d, ["source", "lang"], "doc_id", "text", 300, 1000, "since")
    got = F.from_json("record", "case_key string, evidence array<struct<id:bigint,excerpt:string,shortened:boolean,commencement_proven:boolean>>").getField("evidence")
    line = F.transform(got, lambda e: F.concat_ws(":", e["id"].cast("string"), F.md5(e["excerpt"]), e["commencement_proven"].cast("string")))
    return out.select("source", "lang", "run", F.md5(F.array_join(line, ",")).alias("excerpts_md5"))


@query(f"""with {PAGES_SQL}, s as (select source, page_number, case when (source + page_number) % 4 = 0 then 'ocr' when (source + page_number) % 7 = 0 then 'none' else 'digital' end as status from pages_),
 d as (select source, string_agg(page_number, ',' order by page_number) filter (status = 'ocr') as ocr, string_agg(page_number, ',' order by page_number) filter (status = 'none') as review from s group by source),
 c as (select source, (page_number - 1) // 3 as chunk, bool_or(status = 'ocr') as ocr_used, bool_or(status = 'none') as scan_review, string_agg(page_number || status, ',' order by page_number) as pages from s group by all)
 select c.source, cast(chunk as int) as chunk, ocr_used, scan_review, pages, ocr is not null as document_ocr_used, coalesce(ocr, '') as ocr_pages, coalesce(review, '') as scan_review_pages from c join d on d.source = c.source""")
def chunk_facts(spark, sf):
    """Page facts of each chunk of three pages, and of its whole document."""
    pages = _pages(spark, sf).select("source", "page_number")
    status = F.when((key("source") + key("page_number")) % 4 == 0, "ocr").when((key("source") + key("page_number")) % 7 == 0, "none").otherwise("digital")
    chunk = F.floor((key("page_number") - 1) / 3).cast("int")
    spans = pages.select("source", chunk.alias("chunk")).distinct().select("source", key("chunk").cast("string").alias("chunk_id"), (key("chunk") * 3 + 1).alias("page_start"), (key("chunk") * 3 + 3).alias("page_end"))
    facts, whole = C.page_facts(spans, pages, status), C.document_facts(pages, status)
    listed = F.array_join(F.transform("pages", lambda p: F.concat(p["page_number"].cast("string"), p["status"])), ",")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return facts.join(whole, "source").select("source", key("chunk_id").cast("int").alias("chunk"), "ocr_used", "scan_review", listed.alias("pages"), "document_ocr_used", joined("ocr_pages"), joined("scan_review_pages"))


@query("""with m as (select source, 'Act ' || source as title, case when source in ('src3', 'src4') then 'unknown' else 'in_force' end as status, cast(substr(source, 4) as int) % 5 + 1 as priority from documents group by source),
 r as (select source, sha256('file of ' || source) as sha, case when source <> 'src5' then '2024-01-01T00:00:00Z' end as downloaded_at from m where source <> 'src6')
 select d.doc_id, title, status, cast(priority as int) as priority, sha as sha256, downloaded_at, 'pending' as audit_status from documents d join m on m.source = d.source left join r on r.source = d.source""")
def chunk_metadata(spark, sf):
    """Manifest and receipt facts on each chunk."""
    d = table(spark, sf, "documents").select("doc_id", key("source").alias("source_id"))
    ids = d.select("source_id").distinct()
    manifest = ids.select("source_id", F.concat(F.lit("Act "), "source_id").alias("title"), F.when(key("source_id").isin("src3", "src4"), "unknown").otherwise("in_force").alias("status"), (F.substring("source_id", 4, 9).cast("int") % 5 + 1).alias("priority"))
    receipts = ids.where("source_id <> 'src6'").select("source_id", F.sha2(F.concat(F.lit("file of "), "source_id"), 256).alias("sha256"), F.when(key("source_id") != "src5", "2024-01-01T00:00:00Z").alias("downloaded_at"))
    return B.with_source_metadata(d, manifest, receipts).drop("source_id")


@query("select item_id as id, md5(text) as query_md5, [item_id % 7, item_id % 11] as accepted from benchmark".replace("[item_id % 7, item_id % 11]", "(item_id % 7) || ',' || (item_id % 11)"))
def nested_queries(spark, sf):
    """Query files, each ``{queries: [...]}``, written and read as rows."""
    store = Store(spark)
    item = F.struct(key("item_id").alias("id"), key("text").alias("query"), F.array((key("item_id") % 7).cast("string"), (key("item_id") % 11).cast("string")).alias("also_acceptable"))
    files = table(spark, sf, "benchmark").groupBy((key("item_id") % 50).alias("file")).agg(F.to_json(F.struct(F.collect_list(item).alias("queries"))).alias("value"))
    files.repartition("file").write.partitionBy("file").text(f"{store.path}/queries")
    back = S.read_nested(spark, f"{store.path}/queries", "queries", "id:bigint,query:string,also_acceptable:array<string>")
    return back.select("id", F.md5("query").alias("query_md5"), F.array_join("also_acceptable", ",").alias("accepted"))
