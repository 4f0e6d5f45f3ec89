"""Toxicity: a support vector machine on a gapped subsequence kernel, with Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, runs, tidy

ALPHABET, START, DECAY, CUT = 64, 63, 0.5, 24
#: Bounds of training: labelled rows, landmarks of either class, words of either class, rounds of hard words.
SAMPLE, LANDMARKS, POSITIVE, NEGATIVE, ROUNDS = 4000, (160, 64), 600, 4000, 2
KNOWN_WORDS, CHARS = 150_000, 1_000_000  # word margins that a task remembers, and characters of texts that it splits at once
FLOOR = -1.5  # margin of what holds no word
LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SENTENCE = re.compile(r"[.!?\n]+")


class _Codes(dict):
    """Letters to 1..62 (look-alikes as the letter), all else to 0, which matches nothing and only widens a gap."""

    def __missing__(self, char: int) -> int:
        c = LIKE.get(chr(char), chr(char)).lower()[0]
        code = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 36 if c.isalpha() else 0
        self[char] = code
        return code


CODES = _Codes()


def pieces(word: str) -> list[bytes]:
    """The coded word behind a start mark; a word of over 24 symbols as overlapping pieces, all of them."""
    coded = bytes([START]) + word.translate(CODES).encode("latin-1").strip(b"\0")
    return [coded] if len(coded) <= CUT else [coded[k : k + CUT] for k in range(0, len(coded) - CUT // 2, CUT // 2)]


@lru_cache(CUT + 1)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = (np.array(x, np.int64) for x in zip(*[(a, b, c) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n)], strict=True))
    return i, j, k, DECAY ** (k - i + 1.0)


def _subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all three-symbol subsequences of equally long rows, and their weights; code 0 where a symbol is 0."""
    i, j, k, weight = _triples(rows.shape[1])
    x = rows.astype(np.int32)
    code = (x[:, i] * ALPHABET + x[:, j]) * ALPHABET + x[:, k]
    code[(x[:, i] == 0) | (x[:, j] == 0) | (x[:, k] == 0)] = 0
    return code, weight


def self_kernel(rows: np.ndarray) -> np.ndarray:
    """The kernel (order 3) of each row with itself, by the usual recursion over both prefixes, all rows at once."""
    w, n = rows.shape
    d2 = DECAY * DECAY
    kp = np.ones((w, n + 1, n + 1))
    out = np.zeros(w)
    for order in range(1, 4):
        new = np.zeros((w, n + 1, n + 1))
        for i in range(1, n + 1):
            same = ((rows[:, i - 1 : i] == rows) & (rows > 0)) * kp[:, i - 1, :-1]
            if order == 3:
                out += d2 * same.sum(1)
                continue
            run = np.zeros(w)
            for j in range(1, n + 1):
                run = DECAY * run + d2 * same[:, j - 1]
                new[:, i, j] = DECAY * new[:, i - 1, j] + run
        kp = new
    return out


def _by_length(coded: list[bytes], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows) of equally long strings of three symbols or more, in chunks of bounded size."""
    lengths: dict[int, list[int]] = {}
    for at, b in enumerate(coded):
        if len(b) >= 3:
            lengths.setdefault(len(b), []).append(at)
    for n, at in lengths.items():
        step = max(1, most // len(_triples(n)[0]))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield np.array(part), np.frombuffer(b"".join(coded[p] for p in part), np.uint8).reshape(len(part), n)


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised kernel values of coded words with coded landmarks."""
    table = np.full(ALPHABET**3, -1, np.int64)
    units: dict[int, dict[int, float]] = {}
    for m, mark in enumerate(landmarks):
        for at, rows in _by_length([mark]):
            code, weight = _subsequences(rows)
            for c, v in zip(code[0].tolist(), weight.tolist(), strict=True):
                if c:
                    units.setdefault(c, {}).setdefault(m, 0.0)
                    units[c][m] += v
            norm = np.sqrt(self_kernel(rows))[0]
            for per in units.values():
                if m in per:
                    per[m] /= norm or 1.0
    table[list(units)] = np.arange(len(units))
    own = np.zeros((len(units), len(landmarks)))
    for r, per in enumerate(units.values()):
        for m, v in per.items():
            own[r, m] = v
    out = np.zeros((len(words), len(landmarks)))
    for at, rows in _by_length(words, 1 << 15):
        code, weight = _subsequences(rows)
        row, col = np.nonzero(table[code] >= 0)
        if len(row):
            part = own[table[code[row, col]]] * weight[col][:, None]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[at[row[first]]] = np.add.reduceat(part, first)
        out[at] /= np.sqrt(np.maximum(self_kernel(rows), 1e-12))[:, None]
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, reg = np.zeros(x.shape[1]), np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], (c * weight[inside])[:, None]
        new = np.linalg.solve(reg + xi.T @ (ci * xi), xi.T @ (ci[:, 0] * y[inside]))
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of which none is negative (the bias apart): features with the lowest negative weight are left out in turn."""
    use, out = list(range(x.shape[1])), np.zeros(x.shape[1] + 1)
    while True:
        w = logistic(x[:, use], y)
        if not use or w[:-1].min() >= 0:
            out[[*use, -1]] = w
            return out
        use.pop(int(np.argmin(w[:-1])))


def logistic(x: np.ndarray, y: np.ndarray, reg: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + reg * np.eye(len(w)), x.T @ (y - p) - reg * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """``table``: the machine's weight of each three-symbol subsequence, which folds landmarks and their whitening into one lookup."""

    table: np.ndarray
    bias: float
    final: np.ndarray

    def margins(self, words: list[str]) -> list[float]:
        coded, owner = [], []
        for at, word in enumerate(words):
            for b in pieces(word):
                coded.append(b)
                owner.append(at)
        best = np.full(len(words), FLOOR)
        own = np.array(owner, np.int64)
        for at, rows in _by_length(coded):
            code, weight = _subsequences(rows)
            m = self.table[code] @ weight.astype(np.float32)
            live = np.flatnonzero(m > 0)  # the norm is needed only where the numerator is positive
            if len(live):
                m[live] /= np.sqrt(np.maximum(self_kernel(rows[live]), 1e-12))
            np.maximum.at(best, own[at], np.maximum(m + self.bias, FLOOR))
        return best.tolist()


class Margins(dict):
    """Margins of words, as a task meets them."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, texts: list) -> None:
        if len(self) > KNOWN_WORDS:
            self.clear()
        new = list(set().union(*texts).difference(self)) if texts else []
        self.update(zip(new, self.model.margins(new), strict=True))


def _features(margins: np.ndarray) -> tuple[float, float, float]:
    """Highest and second highest margin of a text's words, and log(1 + words above 0)."""
    if not len(margins):
        return FLOOR, FLOOR, 0.0
    top = np.partition(margins, -2)[-2:] if len(margins) > 1 else np.array([FLOOR, margins[0]])
    return float(top[1]), float(top[0]), float(np.log1p((margins > 0).sum()))


def _document_features(cache: Margins, texts: pd.Series) -> np.ndarray:
    out, texts = np.empty((len(texts), 3)), texts.tolist()
    for begin, end in runs(texts, CHARS):
        part = [t.split() if t else [] for t in texts[begin:end]]
        cache.learn(part)
        for j, words in enumerate(part):
            out[begin + j] = _features(np.fromiter(map(cache.__getitem__, words), np.float64, len(words)))
    return out


def _evidence(a, b, n1: int, n0: int):
    """Twice the log-likelihood ratio of ``a`` of n1 toxic and ``b`` of n0 clean sentences' texts, against one common rate."""
    part = lambda x, n, other: x * np.log(np.maximum(x, 1e-9) * (n1 + n0) / (n * np.maximum(x + other, 1e-9)))
    return 2 * (part(a, n1, b) + part(b, n0, a))


def _train_words(counts: pd.DataFrame, hard: pd.DataFrame | None, n1: int, n0: int, c: float = 3.0) -> tuple[np.ndarray, float]:
    """The machine on words: those that mark toxic sentences beyond doubt against common ones and ``hard`` ones (highest of clean texts)."""
    odds = np.log((counts.n1 + 0.5) / (n1 + 1)) - np.log((counts.n0 + 0.5) / (n0 + 1))
    counts = counts.assign(odds=odds, evidence=_evidence(counts.n1, counts.n0, n1, n0))
    good = counts[(counts.n1 >= 4) & (odds > np.log(8)) & (counts.evidence > 16)]
    good = good.sort_values(["evidence", "word"], ascending=[False, True]).head(POSITIVE)
    bad = counts[(odds < np.log(2)) & ~counts.word.isin(good.word)].sort_values(["n0", "word"], ascending=[False, True]).head(NEGATIVE)[["word"]].assign(hits=1.0)
    if hard is not None:
        bad = pd.concat([bad, hard[~hard.word.isin(good.word)]]).groupby("word", as_index=False).hits.max().sort_values(["hits", "word"], ascending=[False, True])
    words = [*good.word, *bad.word]
    coded = [pieces(w)[0] for w in words]
    marks = list(dict.fromkeys([*coded[: min(len(good), LANDMARKS[0])], *coded[len(good) :][: LANDMARKS[1]]]))
    if not len(good) or not len(bad) or not marks:
        return np.zeros(ALPHABET**3, np.float32), FLOOR
    among = kernel(marks, marks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    y = np.concatenate([np.ones(len(good)), -np.ones(len(bad))])
    weight = np.concatenate([good.n1.to_numpy(float), bad.hits.to_numpy(float)])
    weight[: len(good)] *= weight[len(good) :].sum() / max(1.0, weight[: len(good)].sum()) / 2
    w = support_vectors(kernel(coded, marks) @ whiten, y, weight, c=c)
    by_mark = whiten @ w[:-1]
    table = np.zeros(ALPHABET**3)
    for m, mark in enumerate(marks):
        for _, rows in _by_length([mark]):
            code, lam = _subsequences(rows)
            np.add.at(table, code[0], by_mark[m] * lam / np.sqrt(self_kernel(rows)[0] or 1.0))
    table[0] = 0
    return table.astype(np.float32), float(w[-1])


def _highest(model: Model):
    """The two highest words of each text, if they come near the margin."""

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Margins(model)
        for f in frames:
            out = []
            texts = f.text.tolist()
            for begin, end in runs(texts, CHARS):
                split = [sorted(set(t.lower().split())) if t else [] for t in texts[begin:end]]
                cache.learn(split)
                for words in split:
                    out += [w for w in sorted(words, key=cache.__getitem__)[-2:] if cache[w] > -0.5]
            yield pd.DataFrame({"word": pd.Series(out, dtype=object)})

    return run


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits the model on at most ``sample`` labelled rows for which ``allowed`` holds (the bound; chosen by a hash of the key).

    Texts are taken as sets of words, not as sentences (see the README). Words that mark toxic texts beyond doubt train the machine against
    common words; then the highest words of clean texts join the latter, and it is trained again. A logistic curve that
    rises with each feature turns a text's features into a score. Spark counts words and scores the sample; the driver gets tables of bounded size. Labels that are null are
    left out; without both classes every score is the share of label 1 (0.5 without labels).
    """
    scratch = Scratch(docs.sparkSession)
    chosen = labels.where(allowed & F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.max(f"`{label}`").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id")  # at most ``sample`` rows
    rows = scratch.save(rows.repartition(8, "id"))

    @tidy
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: dict[str, list[int]] = {}
            for t, y in zip(f.text, f.y, strict=True):
                for w in set().union(*[s.lower().split() for s in SENTENCE.split(t)]) if t else ():
                    found.setdefault(w, [0, 0])[int(y > 0)] += 1
            yield pd.DataFrame([(w, a, b) for w, (b, a) in found.items()], columns=["word", "n1", "n0"])

    counts = scratch.save(rows.select("text", "y").mapInPandas(count, "word string, n1 bigint, n0 bigint").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1)) - F.coalesce(F.sum("y"), F.lit(0))).first()
    share = 0.5 if n1 + n0 == 0 else n1 / (n1 + n0)
    if not n1 or not n0:
        return Model(np.zeros(ALPHABET**3, np.float32), FLOOR, np.array([0, 0, 0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    odds = (F.col("n1") + 0.5) * (n0 + 1) / ((F.col("n0") + 0.5) * (n1 + 1))
    often = counts.where("n1 >= 4").orderBy(F.desc(odds * F.least("n1", F.lit(20))), "word").limit(4 * POSITIVE)
    common = counts.orderBy(F.desc("n0"), "word").limit(NEGATIVE // 2)
    others = counts.where("n0 > 0").orderBy(F.xxhash64("word"), "word").limit(NEGATIVE // 2)
    table = often.union(common).union(others).distinct().toPandas().sort_values("word", ignore_index=True)
    hard = None
    for _ in range(ROUNDS):
        model = Model(*_train_words(table, hard, n1, n0), np.zeros(4))
        top = rows.where("y = 0").select("text").mapInPandas(_highest(model), "word string").groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("hits"))
        more = top.toPandas()  # two words for a row of the sample at most
        hard = more if hard is None else pd.concat([hard, more]).groupby("word", as_index=False).hits.sum()
    model = Model(*_train_words(table, hard, n1, n0), np.zeros(4))

    @tidy
    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Margins(model)
        for f in frames:
            yield pd.DataFrame(_document_features(cache, f.text), columns=["a", "b", "c"]).assign(y=f.y.to_numpy())

    got = rows.select("text", "y").mapInPandas(features, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    model.final = rising(got[["a", "b", "c"]].to_numpy(), (got.y > 0).to_numpy(float))
    scratch.drop(rows, counts)
    return model


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of each whole text: every word is scored, in whatever place. Null and empty texts score as texts without words."""
    shared = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Margins(shared)
        try:
            for texts in batches:
                x = _document_features(cache, texts)
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ shared.final[:-1] + shared.final[-1], -30, 30))))
        finally:
            cache.clear()
            give_back()

    return score(text)


def held_out(key: Column) -> Column:
    """The fold that never trains: crc32 of the key as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
