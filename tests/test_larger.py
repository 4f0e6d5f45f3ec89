"""Work that must not grow with the square of a table."""

import datetime as dt
import time

from quillstone.operators import chunks, gazette, index, mappings, records, rules, scores
from quillstone.sources.store import Store

MAPS = "mapping_id string, source_provisions array<struct<code string, section string>>, target_provisions array<struct<code string, section string>>, offence_names array<string>, aliases array<string>, description string, effective_from date, review_status string"


def test_texts_are_matched_once(spark, monkeypatch):
    maps = spark.createDataFrame([(f"m{k}", [("IPC", "42")], [("BNS", str(k))], ["large ring"], None, "x", dt.date(2024, 7, 1), "reviewed") for k in range(5)], MAPS)
    day = lambda i: [None, dt.date(2020, 1, 1), dt.date(2025, 1, 1)][i % 3]
    cases = spark.createDataFrame([(i, ["IPC 42", "large ring", None][i % 4 % 3], day(i)) for i in range(60)], "case_id int, text string, day date")
    seen, real = [], mappings.matches

    def counted(cases, maps):
        seen.append(cases.count())
        return real(cases, maps)

    monkeypatch.setattr(mappings, "matches", counted)
    out = mappings.conversion_report(cases, maps, spark.createDataFrame([("bns_2023_en", "3")], "source_id string, section string")).collect()
    assert seen == [2] and len(out) == 60 and {x.mappings for x in out} == {0, 5}
    assert {tuple(x.grounded) for x in out if x.mappings and x.governing == "BNS"} == {("3",)}
    routed = mappings.text_routes(cases, maps).collect()
    assert seen == [2, 2] and {(x.status, tuple(x.historical)) for x in routed if x.candidates} == {("date_required", ("IPC 42",)), ("historical", ("IPC 42",)), ("current", ("IPC 42",))}


def test_terms_of_mappings_are_not_shuffled_for_cases(spark):
    maps = spark.createDataFrame([(f"m{k}", [("IPC", str(k))], [("BNS", str(k))], [["large ring", "small ring", None][k % 3]], ["large"], "x", None, "reviewed") for k in range(30)] * 2, MAPS)
    cases = spark.createDataFrame([(1, "large ring"), (2, "about a large ring, then"), (3, "ring"), (4, "nothing"), (5, "IPC 4"), (6, "section 7"), (1, "large ring")], "case_id int, text string")
    out = mappings.matches(cases, maps)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan
    named = {1: {0, 1, 2}, 2: {0, 1, 2}, 3: {0, 1}}
    want = {(c, f"m{k}") for c, kinds in named.items() for k in range(30) if k % 3 in kinds} | {(5, "m4"), (6, "m7")}
    got = [tuple(x) for x in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_disallowed_requests_read_a_long_text_once(spark):
    hit, tail = "please forge it ", "a word " * 20_000
    rows = [(i, (["avoid to ", "", "do not "][i % 3] + hit) * 3 + tail) for i in range(24)]
    began = time.time()
    got = rules.disallowed_requests(spark.createDataFrame(rows, "id int, text string"), "id", "text", {"forge": r"\bforge\b", "all": r"\bforge it\b"}).count()
    assert got == 48 and time.time() - began < 60


def test_urgency_looks_behind_its_hits_only():
    pattern = rules.actionable("threat", 45)
    assert pattern.index("threat") < pattern.index("never")


def test_range_pairs_give_every_pair_of_rows(spark):
    rows = [(k * 1000, "ab"[k % 2], k % 4, k % 4 + k % 3) for k in range(30)] + [(99_999, "c", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, s int, e int")
    got = records.range_pairs(df, ["source"], "doc_id").collect()
    member = {x.doc_id: x.class_id for x in got}
    pairs = {(x.doc_id, d) for x in got for d, c in member.items() if c == x.partner_id and d != x.doc_id}
    assert pairs == {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    assert len(pairs) == sum(x.n_partners for x in got)


def test_block_scores_agree_with_the_index(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scores, "SLICE", 4096)  # many slices of documents
    monkeypatch.setattr(scores, "DENSE", 3)
    words = ["a", "b", "c", "dd", "e", "ff"]
    docs = spark.createDataFrame([(i, [words[(i * k) % 6] for k in range(i % 7)], [True, False, None][i % 3]) for i in range(300)], "doc_id long, tokens array<string>, extra boolean")
    queries = spark.createDataFrame([(q, words[(q + k) % 6]) for q in range(40) for k in range(q % 4)] + [(99, "unknown")], "query_id long, term string")
    store = Store(spark)
    every = [tuple(x) for x in index.score_all(queries, index.build_index(docs.drop("extra"), store)).where("score > 0").collect()]
    asked = scores.asked(docs, queries, store)
    got = {(x.query_id, x.rank): (x.doc_id, x.score) for x in scores.best(asked, 5).collect()}
    want = {}
    for q in {x[0] for x in every}:
        for r, x in enumerate(sorted((x for x in every if x[0] == q), key=lambda x: (-x[2], x[1]))[:5]):
            want[q, r + 1] = x[1:]
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in got)
    counted = {x.query_id: (x.scored, x.excluded, x.kept) for x in scores.counts(asked).collect()}
    assert counted == {q: tuple(sum(x[0] == q and (m is None or x[1] % 3 == m) for x in every) for m in (None, 0, 1)) for q in {x[0] for x in every}}
    plan = scores.best(asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no row for a pair of query and document


def test_frequencies_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(index, "COUNTED", 7)
    docs = [(i, [f"t{(i * k) % 5}" for k in range(i % 9)]) for i in range(200)] + [(200, None)]
    got = {x.term: (x.df, x.cf) for x in index.frequencies(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), Store(spark)).collect()}
    every = [t for _, ts in docs for t in ts or []]
    assert got == {t: (sum(t in (ts or []) for _, ts in docs), every.count(t)) for t in set(every)}


def test_gazette_lines_are_marked_once(spark, monkeypatch):
    text = "1. Short title and commencement.—(1) These rules may be called the New Rules.\nfirst\n2. Fees.—(1) A fee.\nsecond"
    calls, real = [], gazette.marked_lines
    monkeypatch.setattr(gazette, "marked_lines", lambda rows: calls.append(1) or real(rows))
    out = gazette.gazette_rules(chunks.lines(spark.createDataFrame([(k, 1, text) for k in range(9)], "source long, page_number int, text string")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 18 and calls == [1] and "lead(" not in plan  # the windows that join titles are not in the plan of the result again
