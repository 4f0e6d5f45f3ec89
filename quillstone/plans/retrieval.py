"""Queries over tokens, postings, vectors and ranks."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as B
from ..operators import index as I
from ..operators import nearest as N
from ..operators import overlap as O
from ..operators import retrieval as R
from ..operators import scores as S
from ..sources.store import Store, dealt_out
from .registry import query, table

W_SQL = r"[\p{L}\p{M}\p{N}]"
TOKENS_SQL = rf"regexp_extract_all(lower(text), '{W_SQL}+(?:[./_:\-]{W_SQL}+|\({W_SQL}+\){W_SQL}*)*')"


def _bm25_sql(asked: str, docs: str = "d") -> str:
    """BM25 scores (bm) of all documents for the queries (query_id, text) that ``asked`` selects; ``docs`` names the table of tokens."""
    return f"""
 {docs} as (select doc_id, {TOKENS_SQL} as toks from documents),
 s as (select count(*) as n, avg(len(toks)) as avgdl from {docs}),
 q as (select distinct query_id, unnest({TOKENS_SQL}) as term from ({asked})),
 w as (select doc_id, len(toks) as dl, unnest(toks) as term from {docs}),
 tf as (select doc_id, dl, term, count(*) as tf from w where term in (select term from q) group by all),
 df as (select term, count(*) as df from tf group by term),
 bm as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
        from q join tf using (term) join df using (term) cross join s group by all)"""


ITEMS = "select item_id as query_id, text from benchmark"
BM25_SQL = _bm25_sql(ITEMS)


def _terms(spark, sf):
    return R.query_terms(table(spark, sf, "benchmark"), "item_id", "text")


def _docs(spark, sf):
    return R.tokenised(dealt_out(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


def _foreign_docs(spark, sf):
    """Documents with ``extra``: those that the language filter excludes."""
    d = dealt_out(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return d.select("doc_id", (F.col("lang") != "en").alias("extra"), T.tokens(F.col("text")).alias("tokens"))


def _searched(spark, sf, terms, k):
    """The ``k`` best documents of each query, by an index that goes when they are written."""
    store = Store(spark)
    asked = S.asked(_docs(spark, sf), terms, store)
    found = Store(spark).save(I.search(terms, I.build_index(_docs(spark, sf), store, terms=terms), k, store) if asked is None else S.best(asked, k))
    store.drop()
    return found


@query(f"with {BM25_SQL} select query_id, doc_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm where score > 0) where rank <= 5")
def bm25_topk(spark, sf):
    """The five best documents of each benchmark item."""
    return _searched(spark, sf, _terms(spark, sf), 5)


@query(f"select doc_id, cast(len({TOKENS_SQL}) as bigint) as n_tokens, cast(len(list_distinct({TOKENS_SQL})) as bigint) as n_terms from documents")
def token_stats(spark, sf):
    """T1."""
    return _docs(spark, sf).select("doc_id", F.col("dl").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


@query(f"""with d as (select doc_id, {TOKENS_SQL} as toks from documents), s as (select count(*) as n from d),
 t as (select term, count(*) as df, sum(tf) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from d) group by all) group by term)
 select term, df, cast(cf as bigint) as cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from t cross join s""")
def doc_freq(spark, sf):
    """A1: document and collection frequency and idf of every term."""
    df = I.frequencies(_docs(spark, sf), Store(spark))
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))  # one row


SYNONYMS = [(1, ["the", "that"]), (2, ["of", "from"]), (3, ["der", "die", "das"]), (4, ["alone"])]


@query(f"""with q as (select item_id as query_id, {TOKENS_SQL} as toks from benchmark),
 g(grp, terms) as (values (1, ['the','that']), (2, ['of','from']), (3, ['der','die','das'])),
 x as (select query_id, unnest(toks) as term from q union all select query_id, unnest(terms) from q join g on list_has_any(toks, terms))
 select query_id, cast(count(distinct term) as bigint) as n_terms, md5(string_agg(distinct term, ' ' order by term)) as terms_md5 from x group by query_id""")
def query_expand(spark, sf):
    """Queries with the terms of the synonym groups that they touch."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens"))
    groups = spark.createDataFrame(SYNONYMS, "grp int, terms array<string>")
    out = R.expand_synonyms(q, groups).where(F.size("tokens") > 0)
    return out.select("query_id", F.size("tokens").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("terms_md5"))


@query(rf"""with a(alias, expansion) as (values ('of the', 'des'), ('in', 'inside'), ('le', 'the')),
 q as (select item_id as query_id, ' ' || array_to_string(regexp_extract_all(lower(regexp_replace(text, '([A-Za-z])[-_:]([0-9])', '\1 \2', 'g')), '{W_SQL}+(?:[./_:\-]{W_SQL}+|\({W_SQL}+\){W_SQL}*)*'), ' ') || ' ' as padded from benchmark)
 select query_id, alias, expansion from q join a on contains(padded, ' ' || alias || ' ')""")
def alias_expand(spark, sf):
    """Reviewed aliases that stand in a query as whole tokens."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.alias_key(F.col("text")).alias("key"))
    aliases = spark.createDataFrame([("of the", "des"), ("in", "inside"), ("le", "the")], "alias string, expansion string")
    return R.expand_aliases(q, aliases)


#: Documents that each channel hands to the fusion.
DEPTH = 200
VECTORS_SQL = "v as (select vec_id, [x::double for x in embedding] as e from embeddings)"
KNN_SQL = f"""{VECTORS_SQL},
 kn as (select a.vec_id as query_id, b.vec_id as doc_id, round(list_cosine_similarity(a.e, b.e), 6) as score from v a join v b on a.vec_id % 50 = 0)"""


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


@query(f"with {KNN_SQL} select query_id, doc_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from kn where score > 0) where rank <= 10")
def knn_cosine(spark, sf):
    """The ten nearest vectors of the query set (ids divisible by 50)."""
    return N.nearest(*_vectors(spark, sf), 10)


@query("""select vec_id, cast(len(embedding) as int) as dim, not list_has_any([isfinite(x) for x in embedding], [false]) and len(embedding) > 0 as valid,
 len(embedding) = (select mode(len(embedding)) from embeddings) as usual_dim from embeddings""")
def vector_check(spark, sf):
    """Dimension and finiteness of each vector."""
    v = table(spark, sf, "embeddings")
    usual = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.crossJoin(F.broadcast(usual)).select("vec_id", F.size("embedding").alias("dim"), (~bad & (F.size("embedding") > 0)).alias("valid"), (F.size("embedding") == F.col("d")).alias("usual_dim"))


FIRST_LINES = "select doc_id as query_id, split_part(text, chr(10), 1) as text from documents where doc_id % 50 = 0 and doc_id in (select vec_id from embeddings)"
FUSED_SQL = f"""{_bm25_sql(FIRST_LINES)}, {KNN_SQL},
 r as (select 'bm25' as channel, query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm where score > 0
  union all select 'vector', query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) from kn where score > 0 and query_id in (select doc_id from documents)),
 f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, count(*) as channels, max(score) filter (channel = 'bm25') as bm25_score, max(rank) filter (channel = 'bm25') as bm25_rank,
  max(score) filter (channel = 'vector') as vector_score, max(rank) filter (channel = 'vector') as vector_rank from r where rank <= {DEPTH} group by all),
 fr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f)"""


def _fused(spark, sf):
    """Queries with a text (a document's first line) and a vector: documents whose id is divisible by 50 and has a vector."""
    queries, vectors = _vectors(spark, sf)
    docs = table(spark, sf, "documents")
    queries = queries.join(docs.select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    asked = docs.where("doc_id % 50 = 0").join(queries.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    terms = R.query_terms(asked.withColumn("text", F.split("text", "\n")[0]), "doc_id", "text")
    bm = _searched(spark, sf, terms, DEPTH).withColumn("channel", F.lit("bm25"))
    kn = N.nearest(queries, vectors, DEPTH).withColumn("channel", F.lit("vector"))
    return R.top(R.fuse(bm.unionByName(kn)), 20), queries, vectors


@query(f"with {FUSED_SQL} select query_id, doc_id, score, cast(rank as int) as rank, cast(channels as int) as channels, bm25_score, cast(bm25_rank as int) as bm25_rank, vector_score, cast(vector_rank as int) as vector_rank from fr where rank <= 20")
def hybrid_rrf(spark, sf):
    """Reciprocal-rank fusion of text and vector over the same documents, with each channel's score and rank."""
    fused = _fused(spark, sf)[0]
    parts = [F.col(f"channel_{x}s")[c].alias(f"{c}_{x}") for c in ("bm25", "vector") for x in ("score", "rank")]
    return fused.select("query_id", "doc_id", "score", "rank", F.size("channel_ranks").alias("channels"), *parts)


@query(f"""with {FUSED_SQL} select query_id, doc_id, score, cast(rank as int) as rank,
 cast(row_number() over (partition by query_id order by sim desc nulls last, rank) as int) as new_rank
 from (select fr.query_id, fr.doc_id, fr.score, fr.rank, kn.score as sim from fr left join kn on kn.query_id = fr.query_id and kn.doc_id = fr.doc_id where fr.rank <= 10)""")
def rerank(spark, sf):
    """The ten best by fusion, reordered by cosine."""
    fused, queries, vectors = _fused(spark, sf)
    kept = Store(spark).save(fused.where("rank <= 10"))
    return R.rerank(kept, N.similarities(kept, queries, vectors), 10).select("query_id", "doc_id", "score", "rank", "new_rank")


BLOCK = ["lang", "source"]
OVERLAP_SQL = f"""t as (select doc_id, lang, source, list_sort(list_distinct({TOKENS_SQL})) as terms, array_to_string({TOKENS_SQL}, ' ') as x from documents),
 r as (select * from t where len(terms) > 0 qualify doc_id = min(doc_id) over (partition by lang, source, x)),
 pairs as (select a.doc_id as a, b.doc_id as b from r a join r b on a.lang = b.lang and a.source = b.source and a.doc_id < b.doc_id
  where least(len(a.terms), len(b.terms)) >= 4 and len(list_intersect(a.terms, b.terms)) >= 0.8 * least(len(a.terms), len(b.terms)))"""


def _rows(spark, sf, among=None):
    """Documents with their tokens, all or those whose ids are in ``among``: only these are tokenised."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    d = dealt_out(d if among is None else d.join(R.checked_broadcast(among.select("doc_id").distinct()), "doc_id", "left_semi"))
    return d.select("doc_id", "lang", "source", T.tokens(F.col("text")).alias("tokens"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))


@query(f"with {OVERLAP_SQL} select a, b from pairs")
def overlap_pairs(spark, sf):
    """U4: documents of one language and source that share four fifths of their terms; copies stand for each other."""
    return O.overlapping(_rows(spark, sf), BLOCK)


@query(f"with {OVERLAP_SQL} select count(*) as n_groups, cast(sum(n) as bigint) as n_rows, max(n) as largest from (select x, count(*) as n from t group by x having count(*) > 1)")
def exact_dups(spark, sf):
    """Groups of documents with equal token text."""
    g = _rows(spark, sf).groupBy(F.sha2(F.array_join("tokens", " "), 256)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"))


@query(f"""with t as (select doc_id, array_to_string({TOKENS_SQL}, ' ') as x from documents)
 select doc_id, min(doc_id) over (partition by x) as kept_id from t""")
def first_copies(spark, sf):
    """U5 (whole corpus), W5: each document's representative, the smallest id with its token text."""
    rows = _rows(spark, sf).select("doc_id", F.sha2(F.array_join("tokens", " "), 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("doc_id").alias("kept_id")), "h").select("doc_id", "kept_id")


@query(f"""with {BM25_SQL}, c as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm where score > 0),
 x as (select query_id, doc_id, lang <> 'en' as out from c join documents using (doc_id) where rank <= 20)
 select query_id, count(*) as candidates, count(*) filter (out) as excluded, count(*) filter (not out) < 5 as underfilled from x group by query_id""")
def trace_counts(spark, sf):
    """The 20 best candidates of each query, those that a language filter excludes, and whether under five stay."""
    c = _searched(spark, sf, _terms(spark, sf), 20).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    out = F.count_if(F.col("lang") != "en")
    return c.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), out.alias("excluded"), (F.count_if(F.col("lang") == "en") < 5).alias("underfilled"))


@query(f"""with {BM25_SQL}, x as (select query_id, lang <> 'en' as out from bm join documents using (doc_id) where score > 0)
 select query_id, count(*) as scored, count(*) filter (out) as excluded, count(*) filter (not out) < 5 as underfilled, (select count(*) from documents where lang <> 'en') as excluded_all from x group by query_id""")
def exclusion_counts(spark, sf):
    """Of each query's scored documents, without a cap, those that a language filter excludes; and all documents that it excludes."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    terms = _terms(spark, sf)
    every = d.agg(F.count_if(F.col("lang") != "en").alias("excluded_all"))
    store = Store(spark)
    asked = S.asked(_foreign_docs(spark, sf), terms, store)
    if asked is not None:
        c = Store(spark).save(S.counts(asked))
        store.drop()
        out = c.select("query_id", "scored", "excluded", (F.col("kept") < 5).alias("underfilled"))
    else:
        c = I.score_all(terms, I.build_index(_docs(spark, sf), store, terms=terms)).where("score > 0").join(d, "doc_id")
        out = c.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("lang") != "en").alias("excluded"), (F.count_if(F.col("lang") == "en") < 5).alias("underfilled"))
    return out.crossJoin(F.broadcast(every))  # one row


GREEDY_SQL = f"""{OVERLAP_SQL}, {_bm25_sql(ITEMS, "bd")},
 cls as (select t.doc_id, r.doc_id as rep from t join r on t.lang = r.lang and t.source = r.source and t.x = r.x),
 nb as (select rep, list(o) as others from (select a as rep, b as o from pairs union all select b, a from pairs union all select doc_id, doc_id from r) group by rep),
 ranked as (select query_id, bm.doc_id, cast(row_number() over (partition by query_id order by score desc, bm.doc_id) as int) as rank, cls.rep, others from bm join cls on cls.doc_id = bm.doc_id join nb on nb.rep = cls.rep where score > 0)"""


@query(f"""with recursive {GREEDY_SQL},
 g(query_id, rank, doc_id, reps, docs, kept_by) as (
  select query_id, rank, doc_id, [rep], [doc_id], cast(null as bigint) from ranked where rank = 1
  union all select g.query_id, n.rank, n.doc_id, case when list_has_any(reps, others) then reps else list_append(reps, rep) end, case when list_has_any(reps, others) then docs else list_append(docs, n.doc_id) end,
   docs[list_position(list_transform(reps, lambda x: list_contains(others, x)), true)] from g join ranked n on n.query_id = g.query_id and n.rank = g.rank + 1 where n.rank <= 20)
 select query_id, doc_id, rank, kept_by from g""")
def greedy_dedup(spark, sf):
    """U5 over U4: each row of the pool of 20, kept, or dropped in favour of the first kept row that it overlaps (copies and near copies of a language and source)."""
    pool = _searched(spark, sf, _terms(spark, sf), 20)
    return O.greedy_dedup(pool, O.text_rows(_rows(spark, sf, pool), BLOCK))


DEDUP_SQL = f"""{GREEDY_SQL},
 g(query_id, rank, doc_id, reps, docs, kept_by) as (
  select query_id, rank, doc_id, [rep], [doc_id], cast(null as bigint) from ranked where rank = 1
  union all select g.query_id, n.rank, n.doc_id, case when list_has_any(reps, others) then reps else list_append(reps, rep) end, case when list_has_any(reps, others) then docs else list_append(docs, n.doc_id) end,
   docs[list_position(list_transform(reps, lambda x: list_contains(others, x)), true)] from g join ranked n on n.query_id = g.query_id and n.rank = g.rank + 1 where n.rank <= 20)"""


@query(f"with recursive {DEDUP_SQL} select query_id, doc_id as dropped, kept_by as kept, 'overlapping_text' as reason from g where kept_by is not null")
def dedup_events(spark, sf):
    """(query, dropped, kept, reason) of each row of the pool of 20 that overlaps a better one."""
    return B.dedup_events(greedy_dedup(spark, sf))


@query(f"""with recursive {DEDUP_SQL}, x as (select query_id, count(*) filter (lang <> 'en') as n from bm join documents using (doc_id) where score > 0 group by query_id)
 select item_id as query_id, count(g.doc_id) as candidates, coalesce(any_value(x.n), 0) as excluded, count(kept_by) as deduplicated, count(g.doc_id) - count(kept_by) < 5 as underfilled from benchmark left join g on g.query_id = item_id left join x on x.query_id = item_id group by item_id""")
def trace_summary(spark, sf):
    """Candidates, exclusions by a language filter, and removed rows of each query, and whether under five candidates stay."""
    store, terms = Store(spark), _terms(spark, sf)
    asked = S.asked(_foreign_docs(spark, sf), terms, store)
    if asked is not None:
        pool = store.save(S.best(asked, 20))
        excluded = store.save(S.counts(asked).select("query_id", F.col("excluded").alias("n")))
    else:
        index = I.build_index(_docs(spark, sf), store, terms=terms)
        pool = store.save(I.search(terms, index, 20, store))
        other = table(spark, sf, "documents").where("lang <> 'en'").select("doc_id")
        excluded = I.score_all(terms, index).where("score > 0").join(other, "doc_id", "left_semi")
    dropped = store.save(B.dedup_events(O.greedy_dedup(pool, O.text_rows(_rows(spark, sf, pool), BLOCK))))
    return B.trace_summary(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), pool, excluded, dropped, 5)


@query(f"""with recursive {GREEDY_SQL},
 g(query_id, rank, doc_id, reps, fresh) as (
  select query_id, rank, doc_id, [rep], true from ranked where rank = 1
  union all select g.query_id, n.rank, n.doc_id, case when list_has_any(reps, others) then reps else list_append(reps, rep) end, not list_has_any(reps, others)
   from g join ranked n on n.query_id = g.query_id and n.rank = g.rank + 1 where len(reps) < 5)
 select query_id, doc_id, rank, cast(row_number() over (partition by query_id order by rank) as int) as new_rank from g where fresh""")
def pool_refill(spark, sf):
    """Five rows for each query after greedy removal in a pool of 20; queries left with fewer go on over all documents that score."""
    store, terms = Store(spark), _terms(spark, sf)
    index = I.build_index(_docs(spark, sf), store, terms=terms)
    pool = store.save(I.search(terms, index, 20, store))
    texts = store.save(O.text_rows(_rows(spark, sf), BLOCK))
    found = O.refill(pool, lambda ids: I.score_all(terms.join(ids, "query_id", "left_semi"), index), texts, 5, store)
    found = Store(spark).save(found)
    store.drop()
    return found
