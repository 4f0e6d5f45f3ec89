"""Line dedup, spelling variants and phrases against brute force, with null, empty, long, tied and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import common, lines, phrases, variants

DOCS = "doc_id bigint, text string"


def line_rows():
    r = random.Random(4)
    pool = [" ".join(r.choice(["alpha", "beta", "Gamma", "é", "x"]) for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = [(k, "\n".join(r.choice(pool) + r.choice(["", " ", "\t\r", "\x0b"]) for _ in range(r.randint(1, 12)))) for k in range(1, 60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "x" * 10 + "\n" + "é" * 9 + "\n" + "é" * 10), (64, "é" * 9), (65, " é" + "é" * 9), (66, " " + "x" * 10), (67, "X" * 10)]
    rows += [(68, "hot line of all\n" * 3000 + "end"), (69, "HOT line of all\n" + "lone line of it\n" * 20), (None, "hot line of all\nunknown one\nnobody else"), (None, "nobody else\nz"), rows[3], (5, "another text of five\n" + pool[0])]
    return rows + [(100 + k, "hot line of all\nown line %d of this" % k) for k in range(400)]


def kept_lines(rows):
    """(id, text) to (lines, dropped, what is left)."""
    key = lambda x: (k := re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))) if len(x.strip(" \t\n\x0b\x0c\r")) >= 10 else None  # noqa: E731, F841
    rank = lambda i: (1 << 63) - 1 if i is None else i
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if (k := key(x)) is not None:
                owner[k] = min(owner.get(k, rank(i)), rank(i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if key(x) is None or owner[key(x)] == rank(i)]
        out.append((rank(i), len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("partitions", "broadcast"), [(1, 500_000), (23, 500_000), (200, 0)])
def test_line_bitmaps(spark, partitions, broadcast, monkeypatch):
    """Also with ranges so small that one key fills many of them."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = line_rows()
    names = {c: F.lit(1) for c in ("doc", "t", "pos", "keep", "n_lines", "doc_0", "bits_0", "key_0", "h1")}
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns(names)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = lines.keep_bitmaps(df)
        got = found.select("doc_id", "n_lines", "n_dropped", "keep", "text", lines.kept_text(F.col("text"), F.col("keep")).alias("left")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(found.columns) == sorted({*df.columns, "n_dropped"})
    assert sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.left or "") for r in got) == kept_lines(rows)
    for r in got:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(r.keep)), np.uint8), bitorder="little") if r.keep else np.ones(0, np.uint8)
        assert r.n_dropped == int((bits[: r.n_lines] == 0).sum()) and bits[r.n_lines :].all()
    assert any(r.text is None and r.left is None for r in got)


def test_lines_of_an_empty_table(spark):
    assert lines.keep_bitmaps(spark.createDataFrame([], DOCS)).count() == 0


def test_bitmaps_shuffle_no_text(spark):
    plan = lines.keep_bitmaps(spark.createDataFrame(line_rows(), DOCS).repartition(3)).select("doc_id", "keep")._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join", 1)[1].split("\n")[1]
    assert re.search(r"Project \[doc_id#\d+L, struct\(", below), below


def variant_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_brute_force(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_variants(spark, monkeypatch):
    r = random.Random(9)
    base = ["".join(r.choice("abÀà×é") for _ in range(r.randint(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "abbbab"]
    chain = ["chainaaaa", "chainaaab", "chainaabb", "chainabbb", "chainbbbb", "chainbbbc", "chainbbcc", "chainbccc"]
    words = [w for w in base for _ in range(r.choice([3, 4, 6, 12, 40]))] + [w for k, w in enumerate(chain) for _ in range(3 * 2**k)]
    for w in base:
        for _ in range(12):
            k, c = r.randrange(len(w)), r.choice("abzé")
            words += [r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])] * r.choice([1, 3, 3, 7])
    r.shuffle(words)
    rows = [(k, "; ".join(x.upper() if r.random() < 0.2 else x for x in words[k::40]) + "1 €") for k in range(40)]
    rows += [(None, "aaaaaa chainaaaa"), (40, None), (41, ""), (42, "ab cd 12"), rows[0], (43, ("q" * 30_000 + " ") * 3 + ("q" * 30_001 + " ") * 6 + ("q" * 12_000 + "x" + "q" * 17_999 + " ") * 3)]
    n = variant_words(rows)
    want = variants_by_brute_force(n)
    assert sum(v[3] > 1 for v in want.values()) > 50 and len({v[1] for v in want.values()}) > 10
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({"word": F.lit("x"), "n": F.lit(1), "doc_0": F.lit(2)})
    for broadcast in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
        got = variants.spelling_variants(df).collect()
        assert len(got) == len(want)
        assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_groups_over_batches():
    """Groups that are cut by batches are scanned whole."""
    import pyarrow as pa

    words = ["abcde", "abcdf", "abcdg", "bbcde", "abde", "aabcde"]
    k1, k2, of, kind = variants.rotation_keys(words)
    order = np.lexsort((k2, k1))
    whole = pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (k1, k2, of, kind)], ["k1", "k2", "rank", "kind"])
    total = lambda out: {k: sum(n for b in out for r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if r == k) for k in range(len(words))}
    near = total(list(variants._scan([whole.slice(k, 1) for k in range(whole.num_rows)])))
    assert near == total(list(variants._scan([whole]))) == {k: sum(one_edit(w, x) for x in words) for k, w in enumerate(words)}


def phrases_by_brute_force(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    many = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    for (lang, w), a in many.items():
        if any(la == lang and b == a and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for (la, v), b in many.items()):
            continue
        score, _, le, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), le, r))
    return {(lang, k, p.decode(), -a, le, r, n[lang], -s) for lang, x in found.items() for k, (s, a, p, le, r) in enumerate(sorted(x)[:top], 1)}


def phrase_rows():
    r = random.Random(2)
    pool = ["the", "of", "cat", "é", "É", "New", "york", "a", "a", "\u00a0x"]
    rows = [(r.choice(["en", "de", None, ""]), "".join(r.choice(pool) + r.choice([" ", "  ", "\t", " ", ". ", ",", "\n", " \x0b ", " "]) for _ in range(r.randint(1, 80)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("en", " .\n"), ("en", "in a b c d e f g, " * 40 + "and so on"), ("und", "a a a a a a a " * 9), ("en", "x" * 50_000 + " new york"), ("xx", "once")]
    return rows + [("en", "New York of The " * 9000), rows[0], rows[0]]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_phrases(spark, broadcast, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(phrases, "PAIRS", 50)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({"a": F.lit(1), "n": F.lit("x"), "g": F.lit(2)})
    for least, longest, top in ((5, 5, 2000), (20, 3, 7)):
        got = phrases.collocations(df, least=least, longest=longest, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        got = got.collect()
        want = phrases_by_brute_force(rows, least, longest, top)
        assert len(got) == len(want) > 10 and {tuple(x) for x in got} == want
    assert phrases.collocations(df.limit(0)).count() == 0 == phrases.collocations(df.where("lang = 'xx'")).count()


def test_scores_beyond_64_bits(spark):
    a, n, parts = 10**12, 10**15 + 7, [10**14 + 1, 10**13 + 3, 10**12 + 9]
    df = spark.createDataFrame([(a, n, parts, [10**12 + 5, 3 * 10**13, 10**12 + 1])], "a bigint, n bigint, heads array<bigint>, tails array<bigint>")
    got = df.select(phrases._score(F.col("n")).alias("s")).collect()[0].s
    tails = [10**12 + 5, 3 * 10**13, 10**12 + 1]
    want = min((1000 * a * n // (parts[k] * tails[2 - k]), k + 1, parts[k], tails[2 - k]) for k in range(3))
    assert tuple(got) == want


def test_phrase_numbers_beyond_32_bits():
    """Pairs whose numbers don't fit into one word are counted all the same."""
    import pyarrow as pa

    g = np.array([5, 2**40, 5, 2**40, 7, 0, 2**40, 7, 0], np.int64)
    got = next(phrases._count_pairs([pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, 9], pa.array(g))], ["g"])])).to_pylist()
    assert {(x["x"], x["y"]): x["n"] for x in got} == {(5, 2**40): 2, (2**40, 5): 1, (2**40, 7): 2}


def test_joined_blocks_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(phrases, "SPAN", 4, raising=False)
    plans, save = [], common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or save(self, df))
    r = random.Random(8)
    words = " ".join(r.choice("abc") for _ in range(9000))  # a run over several batches of a join
    rows = [("en", words), ("en", words[:501] + ". " + words[:99]), ("de", "a b c. a b, a"), (None, "a b")]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3, longest=4, top=50)
    assert sorted(map(tuple, got.collect())) == sorted(phrases_by_brute_force(rows, 3, 4, 50))
    relations = [plan for columns, plan in plans if columns == ["g"]]
    assert len(relations) >= 2 and not any("collect_list" in x for x in relations)  # no task holds a block as rows of one group
