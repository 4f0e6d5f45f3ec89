"""Queries over pages, chunks, files and provenance."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import evaluation as E
from ..sources.store import dealt_out
from .registry import query, table

SIZE = 500
PAGES_SQL = f"""pages_ as (select doc_id as source, cast(p as int) as page_number, substr(text, cast((p - 1) * {SIZE} + 1 as bigint), {SIZE}) as text
 from documents, lateral (select unnest(generate_series(1, greatest(1, cast(ceil(length(text) / {SIZE}.0) as bigint)))) as p))"""


def _pages(spark, sf):
    return C.sized_pages(dealt_out(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", SIZE)


@query("select doc_id as source, cast(len(string_split(text, chr(12))) as bigint) as n_pages from documents")
def form_feed_pages(spark, sf):
    """S3."""
    return C.pages(table(spark, sf, "documents"), "doc_id", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))


@query(f"""with {PAGES_SQL}, c as (select source, page_number, length(regexp_replace(text, '[\\s\\x0b]', '', 'g')) as n_full, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as n_alnum from pages_)
 select source, count(*) as n_pages, count(*) filter (n_full = 0) as n_none, count(*) filter (n_full > 0 and n_full < 20 and n_alnum < 5) as n_insufficient from c group by source""")
def page_status(spark, sf):
    """Extraction status of the pages of each document."""
    p = _pages(spark, sf).select("source", T.page_status(F.col("text"), F.lit(False)).alias("status"))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("status") == "none").alias("n_none"), F.count_if(F.col("status") == "insufficient").alias("n_insufficient"))


LINES_SQL = r"""l0 as (select doc_id as source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos, len(string_split(text, chr(10))) as n from documents),
 l1 as (select source, pos - 1 as line_no, line from l0 where not (pos = n and line = '')),
 m as (select *, case when line like 'A %' then false when line like 'The %' then true end as mark from l1),
 b as (select *, coalesce(last_value(mark ignore nulls) over (partition by source order by line_no rows between unbounded preceding and current row), false) as inside from m),
 s as (select *, sum(case when regexp_matches(line, '^\p{Lu}\p{L}* ') and not inside then 1 else 0 end) over (partition by source order by line_no rows between unbounded preceding and current row) as segment from b)"""


def _segments(spark, sf):
    docs = dealt_out(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace("text", "[\u000b\u000c\r\u001c-\u001e\u0085  ]", " ").alias("text"))
    rows = C.boundaries(C.lines(C.pages(docs, "doc_id", "text")), r"^\p{Lu}\p{L}* ", "^The ", "^A ", leader=r"\u0000")
    return C.sections(rows, F.regexp_extract("line", r"^\p{L}+", 0))


@query(LINES_SQL.join(["with ", """, t as (select source, segment, string_agg(rtrim(line, ' '), chr(10) order by line_no) as text from s group by all)
 select source, count(*) as n_chunks, cast(max(segment) as bigint) as last_segment, cast(sum(length(trim(text, ' ' || chr(10) || chr(9) || chr(13)))) as bigint) as n_chars from t where trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' group by source"""]))
def section_chunks(spark, sf):
    """Sections of each document at lines that start with a capital, outside "contents" (after The ..., until A ...)."""
    out = _segments(spark, sf)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("segment").alias("last_segment"), F.sum(F.length("text")).alias("n_chars"))


def _chunk_facts(spark, sf, docs):
    spans = docs.select("source", F.col("chunk").cast("string").alias("chunk_id"), (F.col("chunk") * 2 + 1).alias("page_start"), (F.col("chunk") * 2 + 3).alias("page_end"))
    few = F.when(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]")) < 5, "insufficient").otherwise("digital")
    return C.page_facts(spans, _pages(spark, sf), few).select("source", F.col("chunk_id").cast("int").alias("chunk"), "n_pages", "scan_review")


@query(f"""with {PAGES_SQL}, k as (select source, cast((page_number - 1) // 2 as int) as c from pages_ where page_number % 2 = 1),
 r as (select source, c, c * 2 + 1 as s, c * 2 + 3 as e from k)
 select r.source, cast(r.c as int) as chunk, count(*) as n_pages, bool_or(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 5) as scan_review
 from r join pages_ p on p.source = r.source and p.page_number between s and e group by all""")
def chunk_pages(spark, sf):
    """Pages in the span of each chunk; overlapping spans of three pages, as many as a document's pages ask for."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / SIZE).cast("int"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int"))).alias("chunk"))
    return _chunk_facts(spark, sf, docs)


@query(f"""with {PAGES_SQL}, s as (select source, string_agg(page_number, ',' order by page_number) as scanned from pages_ where page_number <= 9 and length(regexp_replace(text, '[\\s\\x0b]', '', 'g')) < 20 and (length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 5 or length(regexp_replace(text, '[\\s\\x0b]', '', 'g')) = 0) group by source)
 select doc_id as source, cast(least(9, greatest(1, ceil(length(text) / 500.0))) as bigint) as n_pages, md5(substr(text, 1, 4200)) as text_md5, length(text) > 4200 as truncated, coalesce(scanned, '') as scanned from documents left join s on s.source = doc_id""")
def page_budget(spark, sf):
    """C11: the first pages within 4,200 characters, and which of them need a review."""
    out = C.page_budget(_pages(spark, sf), 30, 4200, T.page_status(F.col("text"), F.lit(False)))
    return out.select("source", "n_pages", F.md5("text").alias("text_md5"), "truncated", F.array_join("scanned_pages", ",").alias("scanned"))


@query("""with p as (select conv_id, turn, trim(text) as part from conversations where trim(text) <> '')
 select conv_id, count(*) as n_segments, sum(length(part) + 1) - 1 > 2000 as too_long, md5(case when sum(length(part) + 1) - 1 <= 2000 then string_agg(part, ' ' order by turn, part) end) as text_md5 from p group by conv_id""")
def transcript_join(spark, sf):
    """The turns of each conversation as one text."""
    out = C.joined_segments(table(spark, sf, "conversations"), "conv_id", "turn", "text", 2000)
    return out.select("conv_id", "n_segments", "too_long", F.md5("text").alias("text_md5"))


@query("select doc_id, md5(concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, ''))) as search_md5 from documents")
def searchable_text(spark, sf):
    """S2."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws(" ", part("source"), part("lang"), part("text"))).alias("search_md5"))


@query("""with r as (select doc_id, sha256(text) as sha, strlen(text) as n from documents where doc_id % 7 <> 3),
 x as (select d.doc_id, r.doc_id as rid, r.sha = sha256(d.text) as ok, case when d.doc_id % 11 = 5 then r.n + 1 else r.n end = strlen(d.text) as size_ok from documents d left join r using (doc_id))
 select case when rid is null then 'missing_receipt' when not ok then 'sha256' when not size_ok then 'byte_count' else 'ok' end as reason, count(*) as n from x group by all""")
def receipt_check(spark, sf):
    """Documents as artifacts against receipts (some missing, some with a wrong size); the first failure is the reason."""
    from ..sources.receipts import verify

    d = table(spark, sf, "documents")
    artifacts = d.select(F.col("doc_id").alias("source_id"), F.encode("text", "UTF-8").alias("content"))
    wrong = F.when(F.col("doc_id") % 11 == 5, 1).otherwise(0)
    receipts = d.where("doc_id % 7 <> 3").select(F.col("doc_id").alias("source_id"), F.upper(F.sha2("text", 256)).alias("sha256"), (F.octet_length("text") + wrong).cast("long").alias("byte_count"), F.lit("2024-01-01T00:00:00Z").alias("downloaded_at"))
    return verify(artifacts, receipts).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("select source || '/' || doc_id as path, strlen(text) as bytes, sha256(text) as sha256 from documents where source <> 'src0'")
def file_inventory(spark, sf):
    """Path, size and digest of each file, without an excluded folder."""
    d = table(spark, sf, "documents").where("source <> 'src0'")
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("""with m as (select distinct source from documents) select source, count(*) as documents, cast(sum(strlen(text)) as bigint) as bytes, count(*) filter (trim(text) = '') as blank,
 cast(count(*) < 300 as boolean) as too_few from documents group by source""")
def build_report(spark, sf):
    """Documents, bytes and blanks of each source, and the size guard."""
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count_if(F.trim("text") == "").alias("blank"), (F.count(F.lit(1)) < 300).alias("too_few"))


@query("""select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host,
 regexp_matches(url, '^https://') and not contains(url, '#') and not contains(regexp_extract(url, '^https://([^/?#]*)', 1), '@') and (ends_with(lower(regexp_extract(url, '^https://([^/?#]*)', 1)), '.example.org')) as official from pages""")
def host_check(spark, sf):
    """Https pages of official hosts."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), T.is_official(F.col("url"), [], (".example.org",)).alias("official"))


@query("""select page_id, regexp_matches(lower(substr(html, 1, 4096)), '<!doctype html|<html') as is_html, array_to_string(list_filter(['<title', 'copyright', 'the '], lambda m: not contains(lower(html), m)), ',') as missing from pages""")
def marker_check(spark, sf):
    """HTML prefix and the reviewed markers that are missing."""
    marks = F.array(*[F.lit(m) for m in ("<title", "copyright", "the ")])
    missing = F.filter(marks, lambda m: ~F.contains(F.lower("html"), m))
    return table(spark, sf, "pages").select("page_id", F.lower(F.substring("html", 1, 4096)).rlike("<!doctype html|<html").alias("is_html"), F.array_join(missing, ",").alias("missing"))


@query("""with u as (select source, sha256(text) as h, count(*) as n from documents group by all),
 p as (select source, substr(h, 1, 2) as p, sha256(string_agg(h || ':' || n, '' order by h)) as d, sum(n) as n from u group by 1, 2),
 r as (select source, sha256(string_agg(d, '' order by p)) as sha, cast(sum(n) as bigint) as n from p group by source)
 select doc_id, sha as source_digest, n as source_documents, 'pending' as audit_status from documents join r using (source)""")
def source_metadata(spark, sf):
    """Facts of the source on each of its rows, digested in levels (the SQL has the two of up to 1,048,576 rows)."""
    d = table(spark, sf, "documents")
    facts = E.digest_levels(d.select("source", F.sha2("text", 256).alias("h")), ["source"])
    return d.select("doc_id", "source").join(facts, "source").select("doc_id", F.col("digest").alias("source_digest"), F.col("n").alias("source_documents"), F.lit("pending").alias("audit_status"))
