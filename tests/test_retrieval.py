"""Index, nearest vectors, overlap, removal and refill against brute force, with ties, copies, nulls and odd sizes."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import index, nearest, overlap, retrieval
from quillstone.sources.store import Store, dealt_out


def token_docs(seed=1, n=150):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, r.choices(words, weights, k=r.randint(1, 40))) for i in range(n)]
    docs += [(n + i, list(docs[3][1])) for i in range(30)]
    return docs + [(500, []), (501, None), (502, ["w0"] * 3000 + ["w59"]), (503, ["é", "w0"])]


def bm25(docs, queries):
    tf = {i: Counter(t or []) for i, t in docs}
    n, words = len(docs), sum(len(t or []) for _, t in docs)
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for q, terms in queries:
        for i, c in tf.items():
            dl = sum(c.values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / (words / n))) for t in set(terms) if c[t])
            if s:
                out[q, i] = round(s, 6)
    return out


def best(scores, k):
    """(query, document, rank) of the ``k`` best."""
    by = {}
    for (q, i), s in scores.items():
        by.setdefault(q, []).append((-s, i))
    return {(q, i, at + 1) for q, x in by.items() for at, (_, i) in enumerate(sorted(x)[:k])}


@pytest.fixture(scope="module")
def indexed(spark):
    docs = token_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<string>").repartition(5)
    store = Store(spark)
    blocks, index.BLOCK = index.BLOCK, 7
    try:
        return docs, index.build_index(df, store), store
    finally:
        index.BLOCK = blocks


QUERIES = [(1, ["w0", "w1", "w2", "w55"]), (2, ["w0"]), (3, ["w40", "w41", "w42", "w0", "w1", "w3"]), (4, ["none"]), (5, ["é"]), (6, [f"w{i}" for i in range(60)]), (7, ["w59", "w0", "w59"])]


def test_blocks(indexed):
    """Blocks hold each posting once, sorted, of one term, with its largest part."""
    docs, found, _ = indexed
    tf = {i: Counter(t or []) for i, t in docs}
    got = Counter()
    for r in found.blocks.collect():
        assert 1 <= len(r.docs) and r.docs == sorted(r.docs)
        parts = [t * 2.5 / (t + 1.5 * (0.25 + 0.75 * dl / found.avgdl)) for t, dl in zip(r.tfs, r.dls, strict=True)]
        assert r.best == pytest.approx(max(parts))
        got.update({(r.term, i, t): 1 for i, t in zip(r.docs, r.tfs, strict=True)})
    assert got == Counter({(w, i, c): 1 for i, x in tf.items() for w, c in x.items()})
    assert found.n == len(docs) and {r.term: (r.df, r.cf) for r in found.terms.collect()} == {w: (sum(w in x for x in tf.values()), sum(x[w] for x in tf.values())) for w in set().union(*tf.values())}


@pytest.mark.parametrize("k", [1, 5, 300])
@pytest.mark.parametrize(("seed", "broadcast"), [(1, 200_000), (40, 200_000), (40, 0), (10**6, 200_000)])
def test_search_is_exact(spark, indexed, k, seed, broadcast, monkeypatch):
    """Whatever the bound leaves out, the best are those of all scores; also without broadcasts."""
    monkeypatch.setattr(index, "SEED", seed)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", broadcast)
    docs, found, store = indexed
    terms = spark.createDataFrame([(q, t) for q, x in QUERIES for t in x], "query_id bigint, term string")
    want = bm25(docs, QUERIES)
    got = index.search(terms, found, k, store).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == best(want, k)
    assert all(r.score == pytest.approx(want[r.query_id, r.doc_id], abs=2e-6) for r in got)


@pytest.mark.parametrize("few", [200_000, 0])
def test_index_of_asked_terms(spark, indexed, few, monkeypatch):
    """An index of the terms that are asked for has their postings only, and the statistics of all documents."""
    monkeypatch.setattr(index, "BROADCAST_ROWS", few)
    docs, whole, _ = indexed
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<string>").repartition(3)
    terms = spark.createDataFrame([(q, t) for q, x in QUERIES[:3] for t in set(x)], "query_id bigint, term string")
    store = Store(spark)
    part = index.build_index(df, store, terms=terms)
    assert (part.n, part.avgdl) == (whole.n, whole.avgdl) and {r.term for r in part.terms.collect()} == {t for _, x in QUERIES[:3] for t in x}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in index.search(terms, part, 5, store).collect()} == best(bm25(docs, QUERIES[:3]), 5)


def test_all_scores(spark, indexed):
    docs, found, _ = indexed
    terms = spark.createDataFrame([(q, t) for q, x in QUERIES for t in set(x)], "query_id bigint, term string")
    got = {(r.query_id, r.doc_id): r.score for r in index.score_all(terms, found).collect()}
    assert got == pytest.approx(bm25(docs, QUERIES), abs=2e-6)


def test_frequent_terms_are_read_late(spark, indexed, monkeypatch):
    """A term that can't lift a document into the best by itself brings no document of its own: its list is not opened."""
    _, found, store = indexed
    opened = []
    monkeypatch.setattr(index, "_postings", lambda i, wanted, real=index._postings: opened.append({r.term for r in wanted.select("term").collect()}) or real(i, wanted))
    terms = spark.createDataFrame([(1, "w55"), (1, "w0")], "query_id bigint, term string")
    monkeypatch.setattr(index, "SEED", 1)
    weighted = {r.term: r.most for r in index._weighted(terms, found).collect()}
    assert weighted["w0"] < weighted["w55"]
    index.search(terms, found, 1, store)
    assert opened == [{"w55"}, {"w55"}]


def test_empty_index(spark):
    store = Store(spark)
    none = index.build_index(spark.createDataFrame([], "doc_id bigint, tokens array<string>"), store)
    assert none.n == 0 and none.avgdl == 1.0
    assert index.search(spark.createDataFrame([(1, "a")], "query_id bigint, term string"), none, 3, store).count() == 0


def test_dealt_out(spark):
    few = spark.range(10, numPartitions=1)
    assert dealt_out(few).rdd.getNumPartitions() == 8 and dealt_out(few.repartition(9)).rdd.getNumPartitions() == 9


@pytest.mark.parametrize("budget", [48 << 20, 200])
@pytest.mark.parametrize("cells", [2_000_000, 60])
def test_nearest(spark, budget, cells, monkeypatch):
    monkeypatch.setattr(nearest, "PASS_BYTES", budget)
    monkeypatch.setattr(nearest, "CELLS", cells)
    r = np.random.default_rng(3)
    docs = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(200)]
    docs += [(200 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(40)] + [(300, None), (301, []), (302, [0.0] * 4), (303, [float("nan"), 1.0, 0.0, 0.0]), (304, [1.0, None, 0.0, 0.0]), (305, [1.0, 2.0]), (306, [2.0, 4.0])]
    queries = [(i, docs[i][1]) for i in range(0, 200, 20)] + [(900, [1.0, 1.0, 0.0, 0.0]), (901, [0.0] * 4), (902, None), (903, [1.0, 2.0]), (904, [])]
    ok = lambda v: v and all(x is not None and x == x for x in v) and any(v)
    want = {}
    for q, a in queries:
        for i, b in docs:
            if ok(a) and ok(b) and len(a) == len(b):
                c = math.floor(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) * 1e6 + 0.5) / 1e6
                if c > 0:
                    want[q, i] = c
    q = spark.createDataFrame(queries, "query_id bigint, q array<double>")
    d = spark.createDataFrame(docs, "doc_id bigint, v array<double>")
    for k in (1, 7, 500):
        got = nearest.nearest(q, d.repartition(3), k).collect()
        assert {(x.query_id, x.doc_id, x["rank"]) for x in got} == best(want, k)
        assert all(abs(x.score - want[x.query_id, x.doc_id]) < 2e-6 for x in got)
    assert nearest.nearest(q, d.limit(0), 3).count() == 0 == nearest.nearest(q.limit(0), d, 3).count()
    plan = nearest.nearest(q, d, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_similarities(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, q array<double>")
    d = spark.createDataFrame([(2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0])], "doc_id bigint, v array<double>")
    pairs = spark.createDataFrame([(1, i) for i in range(2, 7)], "query_id bigint, doc_id bigint")
    assert {r.doc_id: r.similarity for r in nearest.similarities(pairs, q, d).collect()} == {2: 1.0, 3: 0.0, 4: -1.0}


KEYS, MAYBE = ["jurisdiction", "act", "section", "language"], ["status", "effective_from", "effective_to", "document_type"]


def overlap_rows(seed=5, n=260):
    r = random.Random(seed)
    base = [[f"t{r.randrange(80)}" for _ in range(r.randint(1, 25))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            words[r.randrange(len(words))] = f"t{r.randrange(80)}"
        if r.random() < 0.3:
            words += [f"u{r.randrange(300)}" for _ in range(r.randint(1, 60))]
        pages = r.choice([(None, None), (1, 2), (2, 3), (5, 9), (None, 3), (4, None)])
        keys = [r.choice(["x", "x", "x", "y", "", None]) if r.random() < 0.1 else "x" for _ in KEYS]
        maybe = [r.choice(["p", None]) if r.random() < 0.2 else None for _ in MAYBE]
        rows.append((i, *keys, *maybe, *pages, list(dict.fromkeys(words)), " ".join(words)))
    return rows + [(n, *["x"] * 4, *[None] * 4, 1, 2, [], ""), (n + 1, *["x"] * 4, *[None] * 4, 1, 2, ["a", "b"], "a b"), (n + 2, *["x"] * 4, *[None] * 4, 2, 3, ["a", "b"], "a b"), (n + 3, *["x"] * 4, *[None] * 4, 8, 9, ["a", "b"], "a b")]


SCHEMA = "doc_id bigint, " + ", ".join(f"{c} string" for c in KEYS + MAYBE) + ", page_start int, page_end int, terms array<string>, token_text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("tokens", F.when(F.size("terms") > 0, F.split("token_text", " ")).otherwise(F.array().cast("array<string>")))


def alike(x):
    """What rows of one class share."""
    return (*x[1:9], x[9], None if x[9] is None else x[9] if x[10] is None else x[10], x[12])


def meets(a, b):
    """The test on two rows, word by word."""
    if any(not x or x != y for x, y in zip(a[1:5], b[1:5], strict=True)) or a[5:9] != b[5:9] or not a[11] or not b[11]:
        return False
    last = lambda x: x[9] if x[10] is None else x[10]
    if None not in (a[9], b[9]) and (a[9] > last(b) or b[9] > last(a)):
        return False
    few, shared = min(len(a[11]), len(b[11])), len(set(a[11]) & set(b[11]))
    return a[12] == b[12] or few >= 4 and shared * 10 >= few * 8


def test_overlap_in_slices(spark):
    """One slice or many give the same pairs, and texts that have only a few rare terms in common are no candidates whose terms are brought together."""
    r = random.Random(4)
    rows = []
    for k in range(160):
        base = [f"c{r.randrange(40)}" for _ in range(12)] + [f"pair{k // 2}", f"pair{(k + 1) // 2}x"] + [f"own{k}_{j}" for j in range(10)]
        rows.append((k, base))
        if k % 8 == 0:
            rows += [(1000 + k, base[4:] + ["more"]), (2000 + k, base + [f"tail{k}_{j}" for j in range(30)])]
    df = spark.createDataFrame([(i, "en", t, None, None) for i, t in rows], "doc_id bigint, lang string, tokens array<string>, page_start int, page_end int").repartition(3)
    need = lambda a, b: min(len(a), len(b)) >= 4 and 10 * len(a & b) >= 8 * min(len(a), len(b))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and need(set(a), set(b))}
    texts = overlap.classes(overlap.text_rows(df, ["lang"])).cache()
    counts = spark.sparkContext.broadcast(overlap.term_order(texts, overlap.FINER))
    for least in (1 << 22, 1):
        assert {tuple(x) for x in overlap.overlapping(df, ["lang"], least_rows=least).collect()} == want and len(want) > 50
        parts = [p.collect() for p in overlap._shared_prefixes(texts, counts, Store(spark), least)]
        found = [(min(x), max(x)) for p in parts for x in p]
        assert want <= set(found) and len(set(found)) < 2 * len(want) and (len(parts) > 1) == (least == 1)


def test_overlap_makes_no_rows_for_shared_terms(spark, monkeypatch):
    r = random.Random(9)
    plans, save = [], Store.save
    monkeypatch.setattr(Store, "save", lambda self, df, name=None: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or save(self, df, name))
    base = [[f"w{r.randrange(600)}" for _ in range(r.choice([6, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(220):
        words = list(r.choice(base))
        for _ in range(len(words) * r.choice([0, 1, 2, 3]) // 12):
            words[r.randrange(len(words))] = f"w{r.randrange(600)}"
        rows.append((i, r.choice(["en", "de"]), words + [f"x{r.randrange(900)}" for _ in range(r.choice([0, 0, 90]))]))
    df = spark.createDataFrame([(i, b, t, None, None) for i, b, t in rows], "doc_id bigint, lang string, tokens array<string>, page_start int, page_end int").repartition(3)
    heads = {}
    for x in rows:
        heads.setdefault((x[1], *x[2]), x)
    need = lambda a, b: min(len(a), len(b)) >= 4 and 10 * len(a & b) >= 8 * min(len(a), len(b))
    want = {(a[0], b[0]) for a in heads.values() for b in heads.values() if a[0] < b[0] and a[1] == b[1] and need(set(a[2]), set(b[2]))}
    for least in (1 << 22, 1):
        plans.clear()
        assert {tuple(x) for x in overlap.overlapping(df, ["lang"], least_rows=least).collect()} == want and len(want) > 100
        pairs = [plan for columns, plan in plans if columns == ["id1", "id2"]]
        assert (len(pairs) > 1) == (least == 1) and not any(x in plan for plan in pairs for x in ("Join", "Exchange"))


@pytest.mark.parametrize("cells", [1 << 18, 3])
def test_overlap(spark, cells, monkeypatch):
    """All eight keys, pages and nulls; also with an order of terms that tells hardly any apart."""
    monkeypatch.setattr(overlap, "CELLS", cells)
    rows = overlap_rows()
    heads = {}
    for x in rows:
        if x[11] and all(x[1:5]):
            heads.setdefault(alike(x), x)
    heads = list(heads.values())
    want = {(a[0], b[0]) for a in heads for b in heads if a[0] < b[0] and meets(a, b)}
    df = frame(spark, rows).repartition(4)
    got = [tuple(x) for x in overlap.overlapping(df, KEYS, MAYBE).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert overlap.overlapping(df.limit(0), KEYS, MAYBE).count() == 0
    texts = overlap.text_rows(df, KEYS, MAYBE)
    members = {x.doc_id: x.rep for x in overlap.membership(texts).collect()}
    same = {}
    for x in rows:
        if x[11] and all(x[1:5]):
            same.setdefault(alike(x), []).append(x[0])
    assert members == {i: min(x) for x in same.values() for i in x}


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_overlap_with_heads(spark, few, monkeypatch):
    monkeypatch.setattr(overlap, "FEW_TERMS", few)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 200_000 if few else 0)
    rows = overlap_rows()
    texts = Store(spark).save(overlap.text_rows(frame(spark, rows), KEYS, MAYBE))
    counts = spark.sparkContext.broadcast(overlap.term_order(texts))
    chosen = [x for x in rows if x[0] % 9 == 0 or x[0] >= 260]
    got = [tuple(x) for x in overlap.overlapping_with(texts.where("id % 9 = 0 or id >= 260"), texts, counts).collect()]
    want = {(a[0], b[0]) for a in chosen for b in rows if meets(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def greedy(order, by):
    """(document, first kept row that it overlaps) in order of rank."""
    kept, out = [], []
    for i in order:
        first = next((k for k in kept if meets(by[i], by[k]) or by[i] is by[k]), None)
        out.append((i, first))
        if first is None:
            kept.append(i)
    return out


def scored_rows(rows, queries=4):
    r = random.Random(8)
    return [(q, x[0], round(r.choice([1.0, 2.0]) + r.random() * (q % 2), 6)) for q in range(queries) for x in rows if r.random() < 0.9]


def test_greedy_dedup(spark):
    rows = overlap_rows()
    by = {x[0]: x for x in rows}
    scores = {(q, i): s for q, i, s in scored_rows(rows)}
    ranked = best(scores, 10**6)
    df = spark.createDataFrame(list(ranked), "query_id bigint, doc_id bigint, rank int").repartition(3)
    got = overlap.greedy_dedup(df, overlap.text_rows(frame(spark, rows), KEYS, MAYBE)).collect()
    for q in range(4):
        order = [i for _, i, _ in sorted((x for x in ranked if x[0] == q), key=lambda x: x[2])]
        assert {(x.doc_id, x.kept_by) for x in got if x.query_id == q} == set(greedy(order, by))


@pytest.mark.parametrize("size", [6, 3])
def test_refill(spark, size):
    """Underfilled queries go on to the end of their ranking; a query of few rows stays short."""
    rows = overlap_rows()
    by = {x[0]: x for x in rows}
    some = scored_rows(rows) + [(9, 0, 1.0), (9, 3, 1.0)]
    scored = spark.createDataFrame(some, "query_id bigint, doc_id bigint, score double")
    texts = overlap.text_rows(frame(spark, rows), KEYS, MAYBE)
    store, asked = Store(spark), []

    def all_of(queries):
        asked.append(queries.count())
        return scored.join(queries, "query_id", "left_semi")

    for limit in (5, 16):
        got = overlap.refill(retrieval.top(scored, size), all_of, texts, limit, store, size).collect()
        for q in {x[0] for x in some}:
            order = [i for _, i, _ in sorted((x for x in best({(a, b): s for a, b, s in some if a == q}, 10**6)), key=lambda x: x[2])]
            want = [(i, order.index(i) + 1, k + 1) for k, i in enumerate([i for i, first in greedy(order, by) if first is None][:limit])]
            assert sorted((x.doc_id, x["rank"], x.new_rank) for x in got if x.query_id == q) == sorted(want)
    assert asked and max(asked) <= 4


def test_refill_behind_many_copies(spark):
    """20 copies and 5 others with a limit of 5; and 70 copies, then 70 near copies: the fifth distinct row stands behind rank 140."""
    base = [f"w{i}" for i in range(20)]
    other = lambda k: " ".join(["w0", *[f"y{k}z{i}" for i in range(20)]])
    for texts, want in (([" ".join(base)] * 20 + [other(k) for k in range(5)], [0, 20, 21, 22, 23]), ([" ".join(base)] * 70 + [" ".join([*base[:-1], f"x{i}"]) for i in range(70)] + [other(k) for k in range(4)], [0, 140, 141, 142, 143])):
        d = spark.createDataFrame([(i, "en", t.split(), None, None) for i, t in enumerate(texts)], "doc_id bigint, lang string, tokens array<string>, page_start int, page_end int")
        scored = d.select(F.lit(1).cast("bigint").alias("query_id"), "doc_id", (2.0 - F.col("doc_id") / 1000).alias("score"))
        got = overlap.refill(retrieval.top(scored, 20), lambda q: scored, overlap.text_rows(d, ["lang"]), 5, Store(spark))  # noqa: B023
        assert [(r.doc_id, r["rank"]) for r in got.orderBy("new_rank").collect()] == [(i, i + 1) for i in want]
