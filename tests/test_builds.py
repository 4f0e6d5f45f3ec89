"""Builds, events, the vector store, digests and list checks on small fixtures."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import build, chunks, embedding, evaluation, filters, gazette, records
from quillstone.plans.queries import QUERIES

MANIFEST = "source_id string, position int, required boolean"


def parts(spark):
    manifest = spark.createDataFrame([("b", 1, True), ("a", 2, False), ("c", 3, True), ("d", 4, True), ("e", 5, False)], MANIFEST)
    checks = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "sha256"), ("d", "ok")], "source_id string, reason string")
    pages = spark.createDataFrame([("a", 1, "digital"), ("a", 3, "insufficient"), ("a", 2, "ocr"), ("b", 1, "digital"), ("b", 2, "none"), ("c", 1, "digital"), ("d", 1, "none")], "source_id string, page_number int, status string")
    text = spark.createDataFrame([("a:1", "a", "x"), ("a:2", "a", "y"), ("b:1", "b", "z"), ("b:2", "b", " "), ("c:1", "c", "q")], "chunk_id string, source_id string, text string")
    return manifest, checks, pages, text


def test_source_report(spark):
    manifest, checks, pages, text = parts(spark)
    got = [tuple(x) for x in build.source_report(manifest, checks, pages, text).orderBy("position").collect()]
    assert got == [
        (1, "b", True, "succeeded", None, 2, 1, 0, 1, [2], 1), (2, "a", False, "succeeded", None, 3, 0, 1, 1, [3], 2), (3, "c", True, "failed", "sha256", 1, 0, 0, 0, [], 1),
        (4, "d", True, "failed", "no_text", 1, 1, 0, 1, [1], 0), (5, "e", False, "failed", "not_checked", 0, 0, 0, 0, [], 0),
    ]
    assert tuple(build.build_summary(build.source_report(manifest, checks, pages, text)).first()) == (5, 2, 3, 2)


def test_build_leaves_nothing_stale(spark, tmp_path):
    """A source that fails now has no output of an earlier build, others are replaced whole, and a stranger stays; a failure is a row, not an error."""
    manifest, checks, pages, text = parts(spark)
    folder = str(tmp_path / "out")
    old = spark.createDataFrame([(f"{s}:0", s, "old") for s in "abcz"], "chunk_id string, source_id string, text string")
    build.write_chunks(old, folder)
    report = build.build(manifest, checks, pages, text, folder).collect()
    assert {x.source_id for x in report if x.status == "failed"} == {"c", "d", "e"}
    left = {tuple(x) for x in spark.read.json(folder).select("source_id", "chunk_id").collect()}
    assert left == {("a", "a:1"), ("a", "a:2"), ("b", "b:1"), ("z", "z:0")} and not os.path.exists(f"{folder}/source_id=c")
    build.build(manifest, checks, pages, text, folder)
    assert {tuple(x) for x in spark.read.json(folder).select("source_id", "chunk_id").collect()} == left


def test_failing_filters(spark):
    rows = [(1, "IN", "en", "in_force", None, "2024-01-01", None), (2, None, "hi", "in_force", None, None, None), (3, "IN", "hi", "in_force", None, None, None), (4, "IN", "en", None, "p1", None, None), (5, "IN", "en", "in_force", "p9", None, None), (6, "IN", "en", "in_force", "p1", "x", None), (7, "IN", "en", "in_force", "p1", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, jurisdiction string, language string, status string, profile string, effective_from string, effective_to string")
    wanted = spark.createDataFrame([(1, "in", "EN", "in_force", "2024-06-01", False), (2, None, None, None, None, True)], "filter_id int, q_jurisdiction string, q_language string, q_status string, day string, undated boolean").withColumn("day", F.col("day").cast("date"))
    names = ("jurisdiction", "language", "status")
    doc = {c: F.col(c) for c in (*names, "profile", "effective_from", "effective_to")}
    why = build.failing_filter(doc, {c: F.col(f"q_{c}") for c in names}, F.col("day"), F.col("undated"), F.array(F.lit("p1")))
    got = sorted(tuple(x) for x in build.exclusion_events(docs, wanted, why).collect())
    assert got == [(1, 2, "jurisdiction"), (1, 3, "language"), (1, 4, "status"), (1, 5, "profile"), (1, 6, "date"), (1, 7, "date"), (2, 5, "profile")]


def test_trace_summary(spark):
    ids = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "query_id int")
    got = build.trace_summary(ids, rows(1, 1, 1), rows(1), rows(1), 2).orderBy("query_id").collect()
    assert [tuple(x) for x in got] == [(1, 3, 1, 1, False), (2, 0, 0, 0, True)]


def test_vector_store(spark, tmp_path):
    """Two runs embed nothing the second time; a text that comes later is added; copies made by two jobs at once read as one."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts):
        for t in texts:
            (calls / f"{t}-{os.urandom(4).hex()}").touch()
        return np.ones((len(texts), 2), np.float32)

    path = str(tmp_path / "store")
    t = spark.createDataFrame([("k1", "one"), ("k2", "two"), ("k1", "one")], "key string, text string")
    assert embedding.read_store(spark, path).count() == 0
    assert sorted(x.key for x in embedding.append_missing(t, path, embed, 1).collect()) == ["k1", "k2"]
    assert sorted(p.name.split("-")[0] for p in calls.iterdir()) == ["one", "two"]
    embedding.append_missing(t, path, embed)
    assert len(list(calls.iterdir())) == 2
    more = t.union(spark.createDataFrame([("k3", "three")], t.schema))
    assert sorted(x.key for x in embedding.append_missing(more, path, embed).collect()) == ["k1", "k2", "k3"] and len(list(calls.iterdir())) == 3
    spark.createDataFrame([("k1", [1.0, 1.0], "k1")], embedding.STORE).write.partitionBy("part").mode("append").parquet(path)
    assert embedding.read_store(spark, path).count() == 3


def test_hashing_embedder_uses_all_places():
    got = embedding.hashing_embedder(600)([" ".join(f"w{k}" for k in range(5000))])[0]
    assert (got > 0).sum() > 590 and got.sum() == 5000


def test_canonical_rows(spark):
    """The order of a map's entries does not count; any value, a null, or a place of it does."""
    rows = [(1, {"a": "1", "b": "2"}, "x"), (1, {"b": "2", "a": "1"}, "x"), (1, {"a": "1", "b": "3"}, "x"), (1, {"a": "1"}, "x"), (1, {"a": "1", "b": "2"}, None), (1, {"a": "1", "b": None}, "x"), (2, {"a": "1", "b": "2"}, "x")]
    d = spark.createDataFrame(rows, "id int, meta map<string,string>, t string").select(evaluation.canonical_row(["t", "id"], "meta").alias("h")).collect()
    assert d[0].h == d[1].h and len({x.h for x in d}) == 6
    odd = spark.createDataFrame([(1, 1.0, {"a": "nan "}), (2, float("nan"), {"a": "x"}), (3, float("-inf"), None), (4, 2.0, {"a": "-Infinity"}), (5, None, {"a": None}), (5, 1.0, {"a": "info"})], "id int, v double, meta map<string,string>")
    assert sorted(tuple(x) for x in evaluation.fingerprint_violations(odd, "id", ["v"], "meta").collect()) == [("duplicate_id", "5"), ("not_finite", "1"), ("not_finite", "2"), ("not_finite", "3"), ("not_finite", "4")]


def test_answer_metrics(spark):
    cols = "published boolean, expected boolean, claims int, fabricated int, unsupported int, citations int, sound_citations int, right_act boolean, latency double"
    rows = [(True, True, 2, 1, 0, 4, 3, True, 1.0), (True, False, 2, 0, 1, 0, 0, None, 3.0), (False, True, 9, 9, 9, 9, 0, False, 99.0)]
    got = evaluation.answer_metrics(spark.createDataFrame(rows, cols)).first()
    assert tuple(got) == (3, 2, 4, 1, 1, 0.25, 0.25, 0.75, 1.0, 2.0, 3.0, 0.333333)
    none = evaluation.answer_metrics(spark.createDataFrame([(False, False, 1, 1, 1, 1, 1, None, 1.0)], cols)).first()
    assert (none.fabricated_rate, none.unsupported_rate, none.citation_precision, none.correct_act_rate, none.median_latency) == (0.0, 0.0, 0.0, None, None)


def test_typed_values(spark):
    rows = [(" ", "x", "other", "tax"), ("y", "x", "civil", "tax"), (None, None, " ", None), ("", "x", "other", None)]
    got = [tuple(x) for x in spark.createDataFrame(rows, "a string, b string, c string, d string").select(filters.typed_or_extracted(F.col("a"), F.col("b")), filters.typed_domain(F.col("c"), F.col("d"))).collect()]
    assert got == [("x", "tax"), ("y", "civil"), (None, None), ("x", "other")]


def test_cleaning(spark):
    today = F.lit("2024-03-01").cast("date")
    rows = ["2024-03-01", "2024-03-02", "2024-02-30", "soon", None]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in rows], "x string").select(filters.past_day(F.col("x"), today)).collect()]
    assert got == [dt.date(2024, 3, 1), None, None, None, None]
    got = [tuple(x) for x in spark.createDataFrame([(" Civil ",), ("zz",), (None,)], "x string").select(filters.known_domain(F.col("x"), ["civil"]), filters.capped(F.col("x"), 3)).collect()]
    assert got == [("civil", "Civ"), ("other", "zz"), ("other", None)]


def test_list_violations(spark):
    rows = [(1, ["a", "b"], "x"), (2, ["a", " "], "x"), (3, ["a", "a "], " "), (4, None, None), (5, [], "x")]
    got = filters.list_violations(spark.createDataFrame(rows, "id int, l array<string>, s string"), "id", ["l"], ["s"]).collect()
    assert sorted((x.rule, x.key, x.field) for x in got) == [("blank", 3, "s"), ("blank_member", 2, "l"), ("duplicate_member", 3, "l")]


def test_scopes(spark):
    rows = spark.createDataFrame([(1, "src1"), (2, "src12"), (3, "x")], "doc_id int, source string")
    p = spark.createDataFrame([("civil", "src1"), ("civil", "src12"), ("none", "zz"), ("other", "zz")], "domain string, prefix string")
    assert sorted((x.domain, x.doc_id) for x in filters.scoped(rows, p, "source").collect()) == [("civil", 1), ("civil", 2), ("other", 1), ("other", 2), ("other", 3)]
    assert [x.domain for x in filters.unrouted(rows, p, "source").collect()] == ["none"]


def test_consequences(spark):
    cases = spark.createDataFrame([(1, "a", dt.date(2024, 1, 31)), (2, "a", None), (3, "z", None)], "case_id int, domain string, start date")
    deadlines = spark.createDataFrame([("d1", "a", 1, "month", "2000-01-01", "reviewed"), ("d2", "a", 3, "day", None, "pending")], "deadline_id string, domain string, count int, unit string, effective_from string, review_status string")
    today = F.lit("2024-02-28").cast("date")
    got = {(x.case_id, x.deadline_id): (x.due, x.days_remaining, x.notes) for x in records.consequences(cases, deadlines, today).collect()}
    assert got == {
        (1, "d1"): (dt.date(2024, 2, 29), 1, []), (1, "d2"): (dt.date(2024, 2, 3), -25, ["unverified_commencement", "unreviewed", "expired"]), (2, "d1"): (None, None, ["no_start"]),
        (2, "d2"): (None, None, ["no_start", "unverified_commencement", "unreviewed"]), (3, None): (None, None, ["sources_silent"]),
    }
    assert {x.deadline_id for x in records.consequences(cases, deadlines, today, True).collect()} == {"d1", None}


def test_district_contacts(spark):
    rows = spark.createDataFrame([(["A B", "Secretary,  New  Delhi, DLSA", "a[at]b[dot]in", "1"],), (["A", "Clerk", "a", "1"],), (["A", "secretary, North DLSA", "", "1"],), (["A", "Secretary, South DLSA", "m", "2", "x"],)], "cells array<string>")
    got = [(x.contact_id, x.authority, x.email) for x in records.district_contacts(rows).collect()]
    assert got == [("delhi-dlsa-new-delhi", "New Delhi District Legal Services Authority", "a@b.in")]


def test_fallbacks(spark):
    f = spark.createDataFrame([("a", "1", "India"), ("b", "2", "Goa"), ("c", "9", "india")], "fallback_id string, phone string, scope string")
    got = records.fallback_violations(f, {"a": "1", "b": "2", "c": "3", "d": "4"}).collect()
    assert sorted((x.rule, x.key) for x in got) == [("missing_fallback", "d"), ("unreviewed_fallback", "b"), ("unreviewed_fallback", "c")]


def test_gazette_query(spark):
    """The registered query over whole documents, line by line."""
    from test_text_rules import expected_rules

    import hashlib

    sf = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = [f"1. Short title and commencement.—(1) These rules may be called the {r.source} Rules."]
        for k, x in enumerate(r.text.split("\n")):
            lines.append(x if k % 3 == 1 else f"THE GAZETTE OF INDIA : EXTRAORDINARY {x}" if k % 7 == 5 else f"{k // 2 + 2}. {x}")
        text = "\n".join(lines)
        want |= {(f"{r.doc_id}:instrument-{i}:rule-{n}", h, hashlib.md5(t.encode()).hexdigest()) for i, n, h, t, _, _ in expected_rules([(1, t) for t in text.splitlines()])}
    got = {(x.chunk_id, x.heading, x.text_md5) for x in QUERIES["gazette_rules"](spark, sf).collect()}
    assert got == want and len(got) > 200


def test_run_starts_by_group(spark):
    lines = spark.createDataFrame([("s", 1, k, t) for k, t in enumerate(["नियम", "नियम", "नियम"])] + [("s", 2, k, t) for k, t in enumerate(["नियम", "x", "नियम", "नियम"])], "source string, n int, line_no int, line string")
    assert [tuple(x) for x in chunks.run_starts(lines, ["source", "n"]).collect()] == [("s", 1, 0)]
    assert gazette.LOOK_AHEAD == 4


def test_rent_applicability(spark):
    """The boundary days, the limit of the rent, unknown facts, and facts that contradict each other."""
    from decimal import Decimal

    from quillstone.operators import rules

    day = dt.date
    rows = [
        (day(1959, 2, 8), True, False, False, None, None, None, (None, "not_applicable", "1(3)", [])), (day(1959, 2, 9), True, False, False, None, None, None, (None, "applicable", None, [])),
        (day(1988, 11, 30), True, False, False, None, Decimal("9000"), None, (None, "applicable", None, [])), (day(1988, 12, 1), True, False, False, None, Decimal("3500"), day(1980, 1, 1), (None, "applicable", None, [])),
        (day(1988, 12, 1), True, False, False, None, Decimal("3500.01"), None, (None, "not_applicable", "3(c)", [])), (day(1998, 12, 1), True, False, False, None, Decimal("1"), day(1988, 12, 1), (None, "applicable", None, [])),
        (day(1998, 11, 30), True, False, False, None, Decimal("1"), day(1988, 12, 1), (None, "not_applicable", "3(d)", [])), (day(1998, 11, 30), True, False, False, None, Decimal("1"), day(1988, 11, 30), (None, "applicable", None, [])),
        (day(2000, 1, 1), None, None, True, None, None, None, (None, "needs_facts", None, ["area", "grant", "letting", "rent", "completed"])), (day(2000, 1, 1), False, True, True, False, None, None, (None, "not_applicable", "1(2)", [])),
        (day(2000, 1, 1), True, True, True, False, None, None, (None, "not_applicable", "3(b)", [])), (day(2000, 1, 1), True, False, True, False, None, None, (None, "not_applicable", "3(a)", [])),
        (day(2000, 1, 1), True, False, None, True, None, None, ("letting_without_owner", None, None, [])), (day(2000, 1, 1), True, False, False, None, None, day(2000, 1, 2), ("completed_after_day", None, None, [])),
        (day(2000, 1, 1), True, True, True, True, None, None, ("grant_and_letting", None, None, [])), (None, True, False, False, None, None, None, ("no_day", None, None, [])),
    ]
    names = ("day", "area", "grant", "owned", "letting", "rent", "completed")
    df = spark.createDataFrame([(k, *r[:7]) for k, r in enumerate(rows)], "id int, day date, area boolean, grant boolean, owned boolean, letting boolean, rent decimal(18,2), completed date")
    got = {x.id: x.r for x in df.select("id", rules.rent_applicability(*[F.col(c) for c in names]).alias("r")).collect()}
    for k, r in enumerate(rows):
        assert (got[k].problem, got[k].decision, got[k].section, got[k].missing) == r[7], (k, got[k])
    assert got[1].cited == ["1(2)", "1(3)", "3(a)", "3(b)"] and got[3].cited == ["1(2)", "1(3)", "3(a)", "3(b)", "3(c)", "3(d)"] and got[0].cited == ["1(3)"] and got[12].cited == []


def test_fusion_has_both_channels(spark):
    """Most fused rows at this size come from the text and from the vector, so ranks of both are added."""
    rows = QUERIES["hybrid_rrf"](spark, "/root/testdata/sf0.01").collect()
    both = [x for x in rows if x.channels == 2]
    assert len(both) > len(rows) / 2
    assert all(abs(x.score - (1 / (60 + x.bm25_rank) + 1 / (60 + x.vector_rank))) < 1e-8 for x in both)
