"""Operators on small fixtures, with the edge cases that the large tables lack."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.functions import dates as D
from quillstone.functions import text as T
from quillstone.operators import chunks as C
from quillstone.operators import embedding, filters, mappings, records, rules
from quillstone.sources.html import table_rows
from quillstone.sources.receipts import verify


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("Section 316(2)(a), 125-A.", ["section", "316(2)(a)", "125-a"]), ("Crl.A.123/2024", ["crl.a.123/2024"]), ("हिन्दी पाठ", ["हिन्दी", "पाठ"]), ("", []), (None, []), ("a - b", ["a", "b"]),
])
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens) == want


def test_fold(spark):
    assert one(spark, "Straße ﬁ", lambda c: T.tokens(c, "nfkc_casefold")) == ["strasse", "fi"]


def test_keys_and_dates(spark):
    assert one(spark, "BNS-103 and X_9", T.alias_key) == "bns 103 and x 9"
    assert one(spark, "a [at] b [dot] c", T.plain_mail) == "a@b.c"
    assert one(spark, "011-23 / 4567; 89 and 10", T.phone_numbers) == ["01123", "4567", "89", "10"]
    assert one(spark, " 3(5)x", T.section_key) == "3"
    assert [one(spark, x, T.is_iso_date) for x in ("2024-02-29", "2023-02-29", "2024-7-1", "2024", None)] == [True, False, False, False, False]
    assert one(spark, dt.date(2023, 1, 31), lambda c: D.add_period(c, F.lit(1), F.lit("month")), "date") == dt.date(2023, 2, 28)
    assert one(spark, dt.date(2024, 2, 29), D.anniversary, "date") == dt.date(2034, 2, 28)


def test_in_force_edges(spark):
    cases = [("2024-01-01", "2024-01-31"), ("2024-01-31", None), (None, None), (None, "x"), ("x", None), ("2024-01-01", "x"), ("2024-02-01", None)]
    df = spark.createDataFrame(cases, "f string, t string")
    on = F.lit("2024-01-31").cast("date")
    got = [tuple(r) for r in df.select(filters.in_force(F.col("f"), F.col("t"), on, False), filters.in_force(F.col("f"), F.col("t"), on, True)).collect()]
    assert got == [(True, True), (True, True), (False, True), (False, False), (False, False), (False, False), (False, False)]


def test_sections(spark):
    text = ["CONTENTS", "1. Title .... 3", "ENACTED", "1. First", "body", "", "2. Second"]
    pages = spark.createDataFrame([("s", 1, "\n".join(text)), ("s", 2, "more\n2. Second\nagain\n"), ("e", 1, "")], "source string, page_number int, text string")
    marked = C.boundaries(C.lines(pages), r"^\d+\. ", "^CONTENTS", "^ENACTED")
    got = C.sections(marked, F.regexp_extract("line", r"^(\d+)", 1)).orderBy("segment").collect()
    assert [(r.chunk_id, r.page_start, r.page_end) for r in got] == [("s:section-preamble", 1, 1), ("s:section-1", 1, 1), ("s:section-2", 1, 2), ("s:section-2-2", 2, 2)]
    assert got[2].text == "2. Second\nmore"


def test_urgency(spark):
    rows = [
        (1, "there is a threat now"), (2, "he did not threat"), (3, 'he said "threat" there'), (4, "last year there was a threat. fine"), (5, "Last year he was ill. A threat came"), (6, None),
        (7, "he was ill and is under threat"), (8, "my lease says no pets. i am under threat"), (9, "police were here, i am under threat"), (10, "a \u201cthreat\u201d of old"), (11, "no longer threat"), (12, "never threat; a threat"),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    assert sorted(r.id for r in rules.urgency_signals(df, "id", "text", {"harm": ["threat"]}).collect()) == [1, 5, 7, 8, 9, 12]


def test_disallowed(spark):
    rows = [(1, "please forge it"), (2, "do not forge it"), (3, "why is it so that I cannot forge"), (4, "don't forge; forge"), (5, "why can they say that I cannot pay the rent of the house at all? now forge it"), (6, "do not ever forge it")]
    df = spark.createDataFrame(rows, "id int, text string")
    assert sorted(r.id for r in rules.disallowed_requests(df, "id", "text", {"forge": "forge"}).collect()) == [1, 4, 5, 6]


def test_mapping_candidates(spark):
    rows = spark.createDataFrame([("1.2", ["theft", "378, 379"]), ("7", ["new kind", "New Section"]), (None, ["x", "1"]), ("8", ["", "1"]), ("9", ["a", "b", "c"]), ("10", ["gone", "44"])], "row_id string, cells array<string>")
    from quillstone.operators import records

    got = {r.row_id: (r.reference, r.old_refs, r.hint) for r in records.mapping_candidates(rows).collect()}
    assert got == {"1.2": ("1(2)", ["378", "379"], "possible_merge"), "7": ("7", [], "new"), "10": ("10", ["44"], "corresponding")}


def test_claim_gate(spark):
    claims = spark.createDataFrame([(1, 1, ["a"]), (2, 1, ["a"]), (3, 1, ["a"]), (4, 1, ["a"])], "answer_id int, claim_id int, cited array<string>")
    verdicts = spark.createDataFrame([(1, 1, "supported", ["a"]), (2, 1, "insufficient", []), (3, 1, "supported", ["b"])], "answer_id int, claim_id int, verdict string, evidence array<string>")
    assert {r.answer_id: r.stage for r in rules.claim_gate(claims, verdicts).collect()} == {1: "verified", 2: "abstained", 3: "error", 4: "error"}


def test_manifest_and_mappings(spark):
    cols = "source_id string, filename string, url string, allowed_hosts array<string>, effective_from date, effective_to date, relationship string, modifies_source_ids array<string>"
    rows = [("a", "A.pdf", "https://h.x/1", ["h.x"], None, None, "principal", []), ("b", "a.PDF", "https://bad/1", ["h.x"], dt.date(2024, 2, 1), dt.date(2024, 1, 1), "amendment", ["b", "q"]), ("c", "c", "https://h.x", ["h.x"], None, None, "amendment", [])]
    got = sorted((r.rule, r.key) for r in records.manifest_violations(spark.createDataFrame(rows, cols)).collect())
    assert got == [("amends_itself", "b"), ("amends_nothing", "c"), ("date_order", "b"), ("duplicate_filename", "a.pdf"), ("host", "b"), ("target_not_principal", "b"), ("unknown_target", "b")]
    prov = "array<struct<code:string,section:string>>"
    maps = spark.createDataFrame([("m1", [("IPC", "1")], [("BNS", "2")], "exact", "reviewed", "x"), ("m2", [("IPC", "1")], [("BNS", "2")], "omitted", "reviewed", "REVIEWER_MUST_SET"), ("m2", [("BNS", "1")], [("BNS", "2")], "exact", "pending", None)],
        f"mapping_id string, source_provisions {prov}, target_provisions {prov}, mapping_type string, review_status string, reviewed_by string")
    assert sorted((r.rule, r.key) for r in mappings.mapping_violations(maps).collect()) == [("code_side", "m2"), ("duplicate_id", "m2"), ("placeholder", "m2"), ("shape", "m2")]


def test_directory(spark):
    html = "<table><tr><td id='7'>Goa</td><td>SLSA<br>x</td><td>011-2 and 3</td><td>a [at] b [dot] in</td></tr><tr><td>Goa</td><td>2</td><td></td><td></td></tr><tr><th>h</th></tr></table>"
    rows = table_rows(spark.createDataFrame([(1, html), (2, None)], "id bigint, html string"), "id", "html")
    assert [(r.row_id, r.cells[1]) for r in rows.collect()] == [("7", "SLSA x"), (None, "2")]
    got = records.directory_rows(rows, ["Goa"]).collect()
    assert [(r.state, r.phones, r.email) for r in got] == [("Goa", ["0112", "3"], "a@b.in")]
    phones = records.phone_check(spark.createDataFrame([("Goa", "0832-123456"), ("X", "1"), ("Goa", "9")], "state string, phone string"), spark.createDataFrame([("Goa", "99123456")], "state string, phone string"))
    assert sorted(r.verdict for r in phones.collect()) == ["agrees", "conflicts", "not_in_snapshot"]
    bad = records.directory_violations(spark.createDataFrame([("c", "Goa", "North"), ("c", "Delhi", "north ")], "contact_id string, state string, district string"), spark.createDataFrame([("f", 1)], "fallback_id string, n int"), ["f", "g"])
    assert sorted((r.rule, r.key) for r in bad.collect()) == [("duplicate_contact", "c"), ("duplicate_district", "north"), ("foreign_district", "c"), ("missing_fallback", "g")]


def test_small_tables(spark):
    d = records.district_candidates(spark.createDataFrame([("New Goa", ["n", "s"])], "name string, districts array<string>"))
    assert sorted(r.candidate_id for r in d.collect()) == ["new-goa-1", "new-goa-2"]
    s = records.stamped(spark.createDataFrame([("b",), ("a",)], "x string"), "x", "now", "d").orderBy("x").collect()
    assert [r.candidate_id for r in s] == ["candidate-0001", "candidate-0002"]
    m = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, position int")
    got, unknown = records.selected_sources(m, ["b ", "a", "q", "b"])
    assert [r.source_id for r in got.collect()] == ["a", "b"] and [r.source_id for r in unknown.collect()] == ["q"]
    words = spark.createDataFrame([(1, 1, 1, 1, 1, 90.0, "Hello"), (1, 1, 1, 1, 2, -1.0, "x"), (1, 1, 1, 2, 1, 50.0, "y")], "page_num int, block_num int, par_num int, line_num int, word_num int, conf double, text string")
    assert sorted((r.text, r.confidence) for r in C.ocr_lines(words).collect()) == [("Hello x", 90.0), ("y", 50.0)]
    lines = spark.createDataFrame([("s", k, t) for k, t in enumerate(["one", "हिन्दी", "two", "हिन्दी", "", "पाठ", "पाठ"])], "source string, line_no int, line string")
    assert sorted(r.line_no for r in C.trim_at_run(lines).collect()) == [0, 1, 2]


def test_receipts(spark):
    import hashlib

    a = spark.createDataFrame([("a", b"x"), ("b", b"y"), ("c", b"z")], "source_id string, content binary")
    r = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest().upper(), 1, "2024-01-01T00:00:00Z"), ("b", "0", 1, "2024-01-01T00:00:00Z"), ("d", "0", 1, None)], "source_id string, sha256 string, byte_count bigint, downloaded_at string")
    assert {x.source_id: x.reason for x in verify(a, r).collect()} == {"a": "ok", "b": "sha256", "c": "missing_receipt", "d": "missing_file"}


def test_embed_missing(spark):
    t = spark.createDataFrame([("k1", "a b"), ("k1", "a b"), ("k2", "c")], "key string, text string")
    store = spark.createDataFrame([("k2",)], "key string")
    assert [(r.key, sum(r.vector)) for r in embedding.embed_missing(t, store, embedding.hashing_embedder(8)).collect()] == [("k1", 2.0)]


def test_chunk_files(spark, tmp_path):
    from quillstone.sources import corpus

    rows = spark.createDataFrame([("a:1", "a", "x"), ("a:1", "a", "y"), ("b:1", "b", "z"), ("b:2", "b", " ")], "chunk_id string, source_id string, text string")
    corpus.write_chunks(rows, str(tmp_path / "c"))
    corpus.write_chunks(rows.where("source_id = 'b'"), str(tmp_path / "c"))
    back = corpus.read_chunks(spark, str(tmp_path / "c"), schema="chunk_id string, text string, source_id string")
    assert sorted((r.chunk_id, r.text) for r in back.collect()) == [("a:1", "x"), ("a:1", "y"), ("b:1", "z")]
    assert sorted(tuple(r) for r in corpus.corpus_violations(back, ["a", "q"]).collect()) == [("duplicate_chunk", "a:1"), ("unknown_source", "q")]
    corpus.remove_sources(spark, str(tmp_path / "c"), ["a"])
    assert corpus.read_chunks(spark, str(tmp_path / "c"), schema="chunk_id string, text string, source_id string").count() == 1
    (tmp_path / "q.json").write_text('{"queries": [{"id": "1"}]}')
    (tmp_path / "e.json").write_text("{}")
    assert [r.id for r in corpus.read_nested(spark, str(tmp_path / "q.json"), "queries", "id: string").collect()] == ["1"]
    assert corpus.read_nested(spark, str(tmp_path / "e.json"), "queries", "id: string").count() == 0


def test_guards(spark):
    texts = spark.createDataFrame([(1, "see section 5 and section 6")], "case_id int, text string")
    ev = spark.createDataFrame([(1, "s1", "5", "", "in_force", "https://a.gov.in/x", "ab"), (1, "s1", "5", "", "repealed", "https://a.com", "000")], "case_id int, source_id string, section string, excerpt string, status string, official_url string, sha256 string")
    assert [r.ref for r in rules.stage_text_violations(texts, ev).collect()] == ["section 6"]
    used = spark.createDataFrame([(1, "s1"), (1, "s2")], "case_id int, source_id string")
    assert sorted((r.rule, r.source_id) for r in rules.evidence_problems(ev, used, []).collect()) == [("digest", "s1"), ("duplicate", "s1"), ("host", "s1"), ("missing", "s2"), ("not_in_force", "s1")]


def test_whole_tables_are_gated_and_exported(spark):
    from quillstone.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n = QUERIES["grounding_export"](spark, sf).agg(F.sum("n_evidence")).first()[0]
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count()
    orders = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["claim_gate"](spark, sf).count() == orders


def test_grounding_runs_are_bounded(spark):
    rows = spark.createDataFrame([(i, "s", f"text {i}") for i in range(25)], "doc_id bigint, source string, text string")
    got = filters.grounding_runs(rows, ["source"], "doc_id", "text", 300, 10).orderBy("run").collect()
    assert [r.run for r in got] == [0, 1, 2] and [r.record.count('"id"') for r in got] == [10, 10, 5] and '"case_key":"s/2"' in got[2].record


def test_pattern_behind_20000_characters(spark):
    assert one(spark, "a " * 15_000 + "<x script", lambda c: rules.pattern_flags(c, {"script": "<[^>]*script"}), "string") == ["script"]


def test_ranges_far_apart_overlap(spark):
    rows = [(0, "a", 1, 40), (10**6, "a", 30, 50), (10**6 + 1, "a", 30, 50), (2 * 10**6, "a", 51, 60), (5, "b", 1, 40)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, s int, e int")
    got = {tuple(r) for r in records.overlapping_range_counts(d, ["source"]).where("s1 <> s2").collect()}
    assert got == {("a", 1, 40, 1, 30, 50, 2)} and records.overlapping_range_counts(d, ["source"]).count() == 5
    assert {r.doc_id: r.n_partners for r in records.range_partners(d, ["source"], "doc_id").collect()} == {0: 2, 10**6: 2, 10**6 + 1: 2, 2 * 10**6: 0, 5: 0}
    more = spark.createDataFrame([*rows, (7, "a", None, 3), (8, "a", 9, 2)], "doc_id bigint, source string, s int, e int")
    assert {r.doc_id: r.n_partners for r in records.range_partners(more, ["source"], "doc_id").collect()}[7] == 0


def test_route_decisions(spark):
    from quillstone.operators import rules

    rows = [(1, ["a"], True, [], True), (2, ["a", "a"], False, [], True), (3, [], True, ["x"], True), (4, [], False, ["x", "y"], True), (5, [], False, [], True), (6, ["a"], False, [], False)]
    df = spark.createDataFrame(rows, "id int, u array<string>, r boolean, q array<string>, c boolean")
    got = {x.id: tuple(x.d) for x in df.select("id", rules.route_decision(F.col("u"), F.col("r"), F.col("q"), F.col("c")).alias("d")).collect()}
    assert got == {1: ("urgent", True, True, "urgent:a"), 2: ("error", False, False, "duplicate_urgency"), 3: ("refuse", False, True, "disallowed_request"), 4: ("needs_info", False, False, "missing:x+y"), 5: ("standard", False, False, None), 6: ("error", False, False, "unconfirmed")}


def test_all_pages_are_in_chunks(spark):
    from quillstone.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    longest = spark.read.parquet(f"{sf}/documents.parquet").agg(F.max(F.length("text"))).first()[0]
    assert QUERIES["chunk_pages"](spark, sf).agg(F.max("chunk")).first()[0] == (-(-longest // 500) - 1) // 2 > 2


def test_digest_levels(spark, monkeypatch):
    """Groups stay bounded with many copies and many rows, and the digest follows the rows, not their order."""
    from quillstone.operators import evaluation

    rows = spark.range(3000).select(F.lit("s").alias("source"), F.sha2((F.col("id") % 500).cast("string"), 256).alias("h"))
    one_ = evaluation.digest_levels(rows, ["source"]).first()
    assert one_.n == 3000 and evaluation.digest_levels(rows.repartition(7).orderBy("h"), ["source"]).first() == one_
    assert evaluation.digest_levels(rows.limit(2999), ["source"]).first().digest != one_.digest
    monkeypatch.setattr(evaluation, "GROUP", 1)
    deep = evaluation.digest_levels(rows.select("h")).first()
    assert deep.n == 3000 and deep.digest != one_.digest
