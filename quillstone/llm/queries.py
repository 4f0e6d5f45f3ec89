"""The registered queries of this subpackage: thin projections of the operators onto the result contracts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, lines, mpegts, packing, phrases, pieces, secrets, sharding, suffixes, toxicity, urltree, variants, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_file() -> str:
    """The model file: QUILLSTONE_PIECES, or the public one of this machine."""
    return os.environ.get("QUILLSTONE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.secret_spans(F.col("text")).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("s", lambda x: x["kind"] != "novel")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("s")).alias("spans"), count("novel").alias("n_novel"),
    )


def op2_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(F.coalesce("text", F.lit("")))
    padded = F.greatest(F.lit(64), F.ceil(n / 64).cast("int") * 64)
    rows = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.rpad(raw, padded, F.lit(b"\x00")).alias("payload"))
    rows = rows.select("doc_id", "n_bytes", mpegts.to_stream(F.col("payload")).alias("media"))
    rows = rows.select("doc_id", "n_bytes", "media", mpegts.from_stream(F.col("media")).alias("got"))
    back = F.col("got.payload")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "+")
    feature = F.concat_ws(
        "|", F.concat(F.lit("programs="), F.col("got.programs")), F.concat(F.lit("packets="), F.col("got.packets")), F.concat(F.lit("cc_errors="), F.col("got.cc_errors")),
        F.concat(F.lit("pts="), join("got.pts")), F.concat(F.lit("random_access="), join("got.random_access")), F.concat(F.lit("unit_bytes="), join("got.unit_bytes")),
    )
    return rows.select(
        "doc_id", "n_bytes", F.length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring(back, -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    dealt = sharding.shuffle_into_shards(docs, "doc_id", shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.drop("text")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~fold)
    scored = docs.select("doc_id", fold.alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = piece_file()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", pieces.encode_ids(F.col("text"), path).alias("ids"))
    back = docs.select("doc_id", "text", "ids", pieces.decode_ids(F.col("ids"), path).alias("decoded"))
    in_bytes = F.size(F.filter("ids", lambda i: (i >= 3) & (i < 259)))  # the file's byte pieces
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), in_bytes.cast("long").alias("n_bytes_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.keep_bitmaps(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = F.coalesce(lines.kept_text(F.col("text"), F.col("keep")), F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(whole, "UTF-8"), 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_mpeg_ts": op2_mpeg_ts,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filters": op10_url_filters,
    "op11_phrases": op11_phrases,
    "op12_line_dedup": op12_line_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
def _url_sql(levels: int = urltree.LEVELS) -> str:
    """The rules and the template tree, a few common table expressions for each level."""
    name = "case " + " ".join(f"when {{fits[{k}]}} then {{out[{k}]}}" for k in range(4)) + " end"
    rules = sorted(urltree.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in rules]
    rule, said = (name.format(fits=fits, out=[f"'{x}'" for x in out]) for out in ([h + p for _, h, p in rules], [v for v, _, _ in rules]))
    text = f"""with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
 v as (select page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{urltree.UPPER}', '{urltree.LOWER}'), '') as host, coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') as path from u),
 g as (select *, {rule} as rule, {said} as said, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(regexp_replace(s, '[0-9a-f]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g')) as full_ from v),
 rows_ as (select *, case when len(full_) > {levels} then list_append(full_[1:{levels - 1}], array_to_string(full_[{levels}:], '/')) else full_ end as seg from g),
 t0 as (select host, seg, count(*) as n, count(said) as lab, count(*) filter (said = 'block') as bad, '' as template from rows_ group by host, seg)"""
    for k in range(levels):
        text += f""",
 k{k} as (select host, template, seg[{k + 1}] as child, sum(n) as n, sum(lab)::double as lab, sum(bad)::double as bad from t{k} where len(seg) > {k} group by all),
 a{k} as (select *, count(*) over w as kids, sum(n) over w as all_n, sum(lab) over w as all_lab, sum(bad) over w as all_bad from k{k} window w as (partition by host, template)),
 b{k} as (select *, all_bad / nullif(all_lab, 0) as p, abs(bad / nullif(lab, 0) - (all_bad - bad) / nullif(all_lab - lab, 0)) as gap from a{k}),
 c{k} as (select host, template, child, case when kids >= 9 and kids > 0.2::double * all_n then '*' when coalesce(gap <= 1.96::double * sqrt(p * (1 - p) * (1 / nullif(lab, 0) + 1 / nullif(all_lab - lab, 0))), false) then '~' else child end as node from b{k}),
 t{k + 1} as (select t.host, seg, n, lab, bad, case when node is null then t.template else t.template || '/' || node end as template from t{k} t left join c{k} c on c.host = t.host and c.template = t.template and c.child = t.seg[{k + 1}])"""
    return text + f""",
 j as (select host, template, (sum(bad) + 2)::double / (sum(lab) + 4)::double as purity from t{levels} group by all)
 select page_id, r.host, path, rule, coalesce(said, case when purity >= 0.8::double then 'block' else 'allow' end) as verdict, r.host || t.template as template, purity
 from rows_ r join t{levels} t on t.host = r.host and t.seg = r.seg join j on j.host = t.host and j.template = t.template"""


_REACH = """
 twoway as (select a, b from e union all select b, a from e),
 reach(a, b) as (select a, b from twoway union select reach.a, twoway.b from reach join twoway on reach.b = twoway.a),
 root as (select a, min(b) as b from reach group by a)"""

ORACLE_SQL: dict[str, str] = {
    "op11_phrases": """with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
 w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
 t as (select lang, sum(len(w)) as n from w group by lang),
 k as (select unnest([1, 2, 3, 4, 5]) as k),
 g as (select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from w, k where len(w) >= k),
 f as (select lang, k, w[i:i + k - 1] as phrase, count(*) as a from g group by all having count(*) >= 100),
 c as (select f.*, unnest(range(1, k)) as cut from f where k > 1),
 s as (select c.lang, c.k, c.phrase, c.a, c.cut, x.a as l, y.a as r, t.n, (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
       from c join f x on x.lang = c.lang and x.phrase = c.phrase[1:cut] join f y on y.lang = c.lang and y.phrase = c.phrase[cut + 1:] join t on t.lang = c.lang),
 b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
 m as (select *, ' ' || array_to_string(phrase, ' ') || ' ' as s from b),
 d as (select * from m where not exists (select 1 from m y where y.lang = m.lang and y.a = m.a and y.k > m.k and contains(y.s, m.s)))
 select lang, row_number() over (partition by lang order by score desc, a desc, trim(s, ' ')) as rank, trim(s, ' ') as phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
 from d qualify rank <= 2000""",
    "op12_line_dedup": """with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
 k as (select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
 f as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key),
 d as (select k.*, coalesce(doc_id > owner, false) as gone from k left join f using (key))
 select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from d group by doc_id""",
    "op10_url_filters": _url_sql(),
    "op5_embedding_dedup": f"""with recursive x as (select vec_id, [c::double for c in embedding] as v from embeddings
  where embedding is not null and len(embedding) > 0 and not list_has_any([c is not null and isfinite(c) for c in embedding], [false]) and list_has_any([c <> 0 for c in embedding], [true])),
 e as (select x.vec_id as a, y.vec_id as b from x join x y on x.vec_id < y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.9::double),{_REACH}
 select vec_id, (select count(*) from twoway where twoway.a = vec_id) as n_links, least(vec_id, coalesce(root.b, vec_id)) as component_id, vec_id <= coalesce(root.b, vec_id) as kept
 from embeddings left join root on root.a = vec_id""",
    "op6_suffix_dedup": """with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
 w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from t, lateral (select unnest(generate_series(0, n - 50)) as i)),
 f as (select s, min(doc_id) as m from w group by s),
 c as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from w join f using (s) where m < doc_id),
 r as (select doc_id, i, sum(case when gap is null or gap > 50 then 1 else 0 end) over (partition by doc_id order by i) as run from c),
 p as (select doc_id, run, min(i) as lo, max(i) + 50 as hi from r group by all),
 q as (select *, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as back from p),
 k as (select q.doc_id, sum(hi - lo) as removed, count(*) as spans, string_agg(substr(h, 2 * back + 1, 2 * (lo - back)), '' order by lo) as head, max(hi) as last from q join t using (doc_id) group by q.doc_id)
 select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from t left join k using (doc_id)""",
    "op8_jaccard_join": f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 d as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
 n as (select doc_id, count(*) as n from d group by doc_id),
 p as (select x.doc_id as a, y.doc_id as b, count(*) as c from d x join d y on x.g = y.g and x.doc_id < y.doc_id group by all),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),{_REACH}
 select documents.doc_id, coalesce(n.n, 0) as n_shingles, least(documents.doc_id, coalesce(root.b, documents.doc_id)) as component_id
 from documents left join n using (doc_id) left join root on root.a = documents.doc_id""",
}
