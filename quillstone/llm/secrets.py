"""Secret scans: three base patterns, and dictionary-primed zstandard novelty for strings that patterns miss."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more; a shorter run can't hold a longer one
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "novel")

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
#: Words that mark a sensitive context when they stand before a candidate.
SENSITIVE = ("auth", "bearer", "credential", "private", "key", "pwd", "pass", "secret", "token", "signature", "cert", "cookie", "session", "access", "client")
#: What identifiers in code are commonly made of; primes the compressor, so that long names cost little.
IDENTIFIERS = (
    "abstract account address algorithm application argument array attribute authentication authorization base64 boolean buffer builder callback certificate "
    "client collection column component config configuration connection constant constructor container content context controller cookie credential current "
    "database default description destination directory document element encoding endpoint environment exception execute expression factory filename "
    "filter function generator getInstance getValue handler hashCode header identifier implementation import index information initialize instance "
    "integer interface iterator javascript language length library listener location manager message method middleware module namespace network number "
    "object operation option organization output override package parameter parent password pattern permission position prefix private process processor "
    "project property protected protocol provider public publicKey query receiver reference register repository request resource response result return "
    "schema security selector sequence serialize server service session setting setValue signature source standard static string structure subscription "
    "super template temporary thread timestamp toString transaction transform undefined update username utility validation value variable version virtual "
    "width window workspace wrapper 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
).encode()
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets of random strings, smallest first: hexadecimal, base32, one case, both cases, base64 and its url form.
ALPHABETS = (
    _DIGITS + "ABCDEF", _DIGITS + "abcdef", _UPPER + "234567=", _LOWER + "234567=", _DIGITS + _UPPER, _DIGITS + _LOWER, _DIGITS + _LOWER + _UPPER,
    _DIGITS + _LOWER + _UPPER + "+/=", _DIGITS + _LOWER + _UPPER + "_-=", _DIGITS + _LOWER + _UPPER + "+/=_-",
)
_WORDS = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, each kind leftmost and non-overlapping, in order of kind."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


@lru_cache(1)
def _primed() -> zstandard.ZstdCompressor:
    return _compressor(b"")


def _compressor(around: bytes) -> zstandard.ZstdCompressor:
    prime = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)


@lru_cache(1 << 14)
def random_share(letters: str, length: int) -> float:
    """Compressed bytes a byte of random strings of ``length`` of these letters (from 64 bytes on the compressor codes their entropy)."""
    draw, press = random.Random(length), _primed()
    empty = len(press.compress(b""))
    cost = [len(press.compress("".join(draw.choices(letters, k=length)).encode())) - empty for _ in range(4)]
    return min(1.0, sum(cost) / (4 * length))


def random_bytes(candidate: str) -> float:
    """What a random string of the candidate's length and alphabet costs; beyond 4,096 symbols in proportion."""
    letters = next(a for a in ALPHABETS if not set(candidate) - set(a))
    n = len(candidate)
    step = 1 if n < 256 else 64  # the share changes slowly behind 256 symbols
    return n * random_share(letters, min(4096, n // step * step))


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that ``candidate`` adds once the compressor knows identifiers and the code around it."""
    press = _compressor(around.encode("utf-8", "replace"))
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def novel_spans(text: str, taken: list[tuple[str, int, int]], ratio: float, window: int, near: int) -> list[tuple[str, int, int]]:
    """Candidates in a sensitive context, apart from ``taken`` spans, that cost at least ``ratio`` times what a random string of their kind costs.

    Other places of the candidate are taken out of the text that primes the compressor, so a repeated secret stays one.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        word = m[0]
        before = text[max(0, s - near) : s].lower()
        if not any(k in before for k in SENSITIVE) or not re.search("[0-9]", word) or not re.search("[A-Za-z]", word):
            continue
        if any(a < e and s < b for _, a, b in taken):
            continue
        reach = window + len(word)  # holds each other place that meets the window whole
        left, right = text[max(0, s - reach) : s].replace(word, "")[-window:], text[e : e + reach].replace(word, "")[:window]
        if marginal_bytes(word, left + right) >= ratio * random_bytes(word):
            out.append(("novel", s, e))
    return out


def find_spans(text: str | None, ratio: float = 0.85, window: int = 512, near: int = 64) -> list[tuple[str, int, int]]:
    """All spans of one text, by start and then kind; no text, no spans."""
    if not text:
        return []
    base = base_spans(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(base + novel_spans(text, base, ratio, window, near), key=lambda x: (x[1], rank[x[0]], x[2]))


def secret_spans(text: Column, ratio: float = 0.85, window: int = 512, near: int = 64) -> Column:
    """array<struct<kind, start, end>> of the secrets in a text column; code points, end exclusive.

    Null and empty texts give an empty array. The scan is one pass over the whole text in a pandas function; each
    text is judged alone, so there is no shuffle.
    """

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, ratio, window, near)] for t in texts], dtype=object)

    return scan(text)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", **how) -> DataFrame:
    """``df`` with every secret in its text replaced by ``mark``; spans that overlap are replaced together. Null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = find_spans(t, **how)
            if spans:
                parts, at = [], 0
                for _, s, e in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return df.withColumn(text_col, clean(F.col(f"`{text_col}`")))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
