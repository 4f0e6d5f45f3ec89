"""Urgency, disallowed requests and gazette rules against row-by-row statements of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import chunks, gazette, rules


def urgent(text, phrases):
    low, out = text.lower(), {}
    for category, ps in phrases.items():
        for p in ps:
            for m in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)", low):
                before = low[: m.start()]
                near = before[-45:]
                quoted = before.count('"') % 2 == 1 or before.rfind("“") > before.rfind("”")
                if not quoted and not re.search(r"(?:\bnot|\bnever|\bno longer|नहीं)\s*$", near) and not re.search(r"(?:\blast year|\bpreviously|\bformerly|\bused to be)\b[^.!?]*$", near):
                    out.setdefault(category, p)
    return {c: next(p for p in phrases[c] if p in [out[c]]) for c in out}


def test_urgency_matches_row_by_row(spark):
    r = random.Random(6)
    words = ["under arrest", "threat", "not", "never", "no longer", "नहीं", "last year", "previously", "used to be", '"', "“", "”", ".", "!", "he", "said", "threats", "xnot", "a" * 20, "under  arrest", "é"]
    phrases = {"custody": ["under arrest", "threat"], "harm": ["threat", "said"], "none": ["zzz"]}
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(1500)] + ["not" + " " * 42 + "threat", "not" + " " * 43 + "threat", '"threat" threat', "", 'x"under arrest"']
    texts += ["THREAT" + '"' * 3 + "threat", "threat “ under arrest ” said “ said"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string")
    got = {}
    for x in rules.urgency_signals(df, "id", "text", phrases).collect():
        got.setdefault(x.id, {})[x.category] = x.phrase
    # the first phrase of the list, not of the text
    want = {}
    for i, t in enumerate(texts):
        for c, ps in phrases.items():
            hit = next((p for p in ps if urgent(t, {c: [p]})), None)
            if hit:
                want.setdefault(i, {})[c] = hit
    assert got == want and len(want) > 300


def asked(text, pattern):
    low = text.lower()
    for m in re.finditer(pattern, low):
        near = low[max(0, m.start() - 40) : m.start()]
        if re.search(r"\b(?:do not|don't|avoid|without)\s*$", near):
            continue
        if re.search(r"\b(?:why|explain why)\b.{0,25}\b(?:cannot|can't|won't|shouldn't|must not)\b", near + m.group()):
            continue
        return True
    return False


def test_disallowed_matches_row_by_row(spark):
    r = random.Random(7)
    words = ["what is", "tell me", "odds of winning", "my", "do not", "don't", "why", "cannot", "can't", "avoid", "forge", "forge.", "\n", "x" * 15, "explain why", "without", "é", "won't"]
    patterns = {"odds": r"\b(?:what|tell)\b.{0,50}\bodds of winning\b", "forge": r"\bforge\b"}
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 16))) for _ in range(2000)] + ["", "forge" * 3, "do not tell me what are the odds of winning", "don't forge; forge", "forge " * 400]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id int, text string")
    got = {(x.id, x.rule) for x in rules.disallowed_requests(df, "id", "text", patterns).collect()}
    want = {(i, n) for i, t in enumerate(texts) for n, p in patterns.items() if asked(t, p)}
    assert got == want and len(want) > 300
    plan = rules.disallowed_requests(df, "id", "text", patterns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# What the rules say, over one source's lines.
DASH, BODY, MONEY = re.compile(r"[A-Za-z]\.?\s*[—–-]+\s*(?=\(|[A-Z])"), re.compile(r"^(?:in|for)\s+the\b", re.I), re.compile(r"\b(?:rs\.?|rupees?|lakh|crore)\b", re.I)
ENGLISH, HINDI = re.compile(r"\bshort\s+title\s+and\s+commencement\b|\bthese\s+rules\s+may\s+be\s+called\b", re.I), re.compile("संक्षिप्त\\s+नाम")
NOISE = re.compile(r"THE GAZETTE OF INDIA\s*:\s*EXTRAORDINARY|[\ue000-\uf8ff]", re.I)


def expected_rules(rows):
    """(instrument, number, heading, text, first page, last page) of [(page, line)]."""
    head = [re.match(r"^\s*(\d+)\.\s*(.*)$", t) for _, t in rows]

    def title(k):
        words = [head[k][2].strip()] if head[k][2].strip() else []
        for t in [None, *(t.strip() for _, t in rows[k + 1 : k + 5])]:
            if t:
                if words and re.match(r"^\s*\d+\.", t):
                    break
                words.append(t)
            if words and (DASH.search(" ".join(words)) or ENGLISH.search(" ".join(words))):
                break
        return " ".join(words)

    def worth(t):
        return 10 if DASH.search(t) else 9 if BODY.search(t) else 0 if MONEY.search(t) else 1 if t and t[0].isupper() and len(t) <= 500 else 0

    ones = [(k, "en" if ENGLISH.search(title(k)) else "hi") for k, m in enumerate(head) if m and m[1] == "1" and (ENGLISH.search(title(k)) or HINDI.search(title(k)))]
    out, number = [], 0
    for j, (begin, lang) in enumerate(ones):
        if lang == "hi":
            continue
        number += 1
        end = ones[j + 1][0] if j + 1 < len(ones) else len(rows)
        starts = [(1, begin)]
        while options := [(-worth(title(k)), k) for k in range(starts[-1][1] + 1, end) if head[k] and int(head[k][1]) == starts[-1][0] + 1 and worth(title(k))]:
            starts.append((starts[-1][0] + 1, min(options)[1]))
        run = []
        for k in range(starts[-1][1] + 1, end):
            if rows[k][1].strip():
                letters = [c for c in rows[k][1] if c.isalpha()]
                run = [*run, k] if letters and sum("ऀ" <= c <= "ॿ" for c in letters) / len(letters) >= 0.55 else []
                if len(run) == 3:
                    end = run[0]
                    break
        for (n, a), b in zip(starts, [k for _, k in starts[1:]] + [end], strict=True):
            text = "\n".join(t.rstrip() for _, t in rows[a:b] if not NOISE.search(t)).strip()
            if text:
                out.append((number, str(n), f"{n}. {title(a)}", text, rows[a][0], rows[b - 1][0]))
    return out


def test_gazette_rules_match_line_by_line(spark):
    r = random.Random(11)
    pool = [
        "1. Short title and commencement.—(1) These rules may be called the Goa Rules, 2020.", "1.", "Short title and", "commencement.—x", "1. संक्षिप्त नाम", "2.", "3.", "2. Definitions.—In these", "Definitions.—In these rules",
        "2. In the case", "3. Rs. 900 per day", "3. Some Title", "3. Fees.—A fee of ten rupees", "4. for the year", "4. lower case", "5. Late.—X", "05. Zero", "", "  ", "body text", "नियम यह है", "दूसरा नियम", "THE GAZETTE OF INDIA : EXTRAORDINARY", "a\ue001b", "6. X", "99999999999999999999. Y",
    ]
    pages, want = [], set()
    for s in range(150):
        own = [[r.choice(pool) for _ in range(r.randint(0, 14))] for _ in range(r.randint(1, 3))]
        if r.random() < 0.7:
            own[0].insert(0, pool[0])
        pages += [(s, k + 1, "\n".join([*x, "."])) for k, x in enumerate(own)]
        want |= {(s, *x) for x in expected_rules([(k + 1, t) for k, x in enumerate(own) for t in [*x, "."]])}
    df = spark.createDataFrame(pages, "source int, page_number int, text string").repartition(4)
    got = gazette.gazette_rules(chunks.lines(df)).collect()
    assert {(x.source, x.instrument, x.section_id, x.heading, x.text, x.page_start, x.page_end) for x in got} == want and len(got) == len(want) > 250
    assert all(x.chunk_id == f"{x.source}:instrument-{x.instrument}:rule-{x.section_id}" for x in got)
    assert any(x.section_id == "3" for x in got) and max(x.instrument for x in got) > 1


def test_gazette_chunks(spark):
    """Two instruments with a table inside a rule, a title over two lines, an amendment, and a source without rules."""
    first = [
        "1. Short title and commencement.—These rules may be called the First Rules, 2020.", "2.", "Definitions.—In these rules, x.", "3. Fees.—A fee of ten rupees is due.", "1. Row one", "4. Four lakh to eight lakh", "Provided that y.", "4. Records.—Keep the record.",
        "अधिसूचना यह है", "", "दूसरी पंक्ति", "तीसरी पंक्ति", "1. संक्षिप्त नाम", "2. परिभाषा", "1. (1) These rules may be called the Second (Amendment) Rules, 2020.", "2. In the principal rules, rule 4 is left out.", "[भाग II—खण्ड 3(i)] भारत का राजपत्र : असाधारण",
    ]
    pages = [("a", 1, "\n".join(first[:7])), ("a", 2, "\n".join(first[7:])), ("c", 1, "CORRIGENDUM\nFor page 8 line 40, read (a)."), ("e", 1, "")]
    got = gazette.gazette_chunks(spark.createDataFrame(pages, "source string, page_number int, text string"), r"^\s*\d+[A-Za-z]?\.\s+\S", "^CONTENTS", "^ENACTED")
    got = {x.chunk_id: x for x in got.collect()}
    assert sorted(got) == ["a:instrument-1:rule-1", "a:instrument-1:rule-2", "a:instrument-1:rule-3", "a:instrument-1:rule-4", "a:instrument-2:rule-1", "a:instrument-2:rule-2", "c:section-preamble"]
    one = [got[f"a:instrument-1:rule-{k}"] for k in (1, 2, 3, 4)]
    assert one[1].heading == "2. Definitions.—In these rules, x." and one[2].text.split("\n")[1:] == ["1. Row one", "4. Four lakh to eight lakh", "Provided that y."]
    assert one[3].heading == "4. Records.—Keep the record." and one[3].text == "4. Records.—Keep the record."
    assert (one[0].page_start, one[3].page_start, one[0].instrument_title) == (1, 2, "First Rules, 2020")
    assert got["a:instrument-2:rule-2"].text == "2. In the principal rules, rule 4 is left out." and got["a:instrument-2:rule-1"].instrument_title == "Second (Amendment) Rules, 2020"
    assert got["c:section-preamble"].heading == "Preamble" and "CORRIGENDUM" in got["c:section-preamble"].text


@pytest.mark.parametrize(("line", "want"), [("x The Gazette of India: Extraordinary", True), ("भारत  का राजपत्र", True), ("[PART II—SEC. 3", True), ("\ue123", True), ("plain", False)])
def test_noise(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(gazette.is_noise(F.col("x"))).first()[0] is want
