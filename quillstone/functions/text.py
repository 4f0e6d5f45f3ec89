"""Text functions on columns: tokens, keys, normal forms, counts of scripts. All but ``fold`` stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is made of, and line ends.
WORD = r"[\p{L}\p{M}\p{N}]"
TOKEN = rf"{WORD}+(?:[./_:\-]{WORD}+|\({WORD}+\){WORD}*)*"
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
BIDI = "[؜‎‏‪-‮⁦-⁩]"


def fold(text: Column) -> Column:
    """NFKC and case folding (``ß`` becomes ``ss``)."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())

    return run(text)


def tokens(text: Column, normalize: str = "lower") -> Column:
    """array<string> of tokens; null texts have none. ``normalize``: ``lower``, or ``nfkc_casefold`` by way of ``fold``."""
    plain = fold(text) if normalize == "nfkc_casefold" else F.lower(text)
    return F.coalesce(F.regexp_extract_all(plain, F.lit(TOKEN), 0), F.array().cast("array<string>"))


def alias_key(text: Column) -> Column:
    """Tokens joined by a space, with - _ : between a letter and a digit as a space."""
    return F.array_join(tokens(F.regexp_replace(text, r"(?<=[A-Za-z])[-_:](?=\d)", " ")), " ")


def place_key(text: Column) -> Column:
    """Lower case letters and digits, all else as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def quote_key(text: Column) -> Column:
    """Lower case with white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def ascii_key(text: Column) -> Column:
    """Runs of a-z and 0-9, joined by a space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), " ")


def intake_text(text: Column) -> Column:
    """Line ends as LF, trimmed."""
    return F.trim(F.regexp_replace(text, "\r\n|\r", "\n"))


def intake_problem(text: Column, limit: int = 20_000) -> Column:
    """Why a text is rejected (``blank``, ``too_long``, ``control``, ``bidi``), or null."""
    x = intake_text(text)
    return (
        F.when(x.isNull() | (x == ""), "blank").when(F.length(x) > limit, "too_long")
        .when(x.rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), "control").when(x.rlike(BIDI), "bidi")
    )


def script_counts(text: Column) -> tuple[Column, Column]:
    """Letters in Devanagari and in Latin."""
    return F.regexp_count(text, F.lit(r"[\p{IsDevanagari}&&\p{L}]")), F.regexp_count(text, F.lit(r"[\p{IsLatin}&&\p{L}]"))


def language_by_script(text: Column, markers: list[str]) -> Column:
    """``mixed`` with both scripts or two romanised markers, ``hi``, ``en``, or ``und``."""
    devanagari, latin = script_counts(text)
    known = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)), F.array(*[F.lit(m) for m in markers])))
    return F.when((devanagari > 0) & (latin > 0), "mixed").when(devanagari > 0, "hi").when((latin > 0) & (known >= 2), "mixed").when(latin > 0, "en").otherwise("und")


def page_status(text: Column, ocr: Column) -> Column:
    """``ocr``, ``none``, ``insufficient`` (under 20 non-blanks and 5 letters or digits), or ``digital``."""
    full, alnum = F.regexp_count(text, F.lit(r"[^\s]")), F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return F.when(ocr, "ocr").when(F.coalesce(full, F.lit(0)) == 0, "none").when((full < 20) & (alnum < 5), "insufficient").otherwise("digital")


def bounded(text: Column, limit: int) -> Column:
    """The text, if it has ``limit`` characters at most; else up to its last space (if past the middle), or cut; right-trimmed."""
    head = F.substring(text, 1, limit)
    space = F.lit(limit) - F.instr(F.reverse(head), " ")  # 0-based
    cut = F.when((F.instr(head, " ") > 0) & (space > limit / 2), F.substr(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.rtrim(cut))


def ellipsis(text: Column, limit: int) -> Column:
    """As ``bounded``, with an ellipsis inside the limit and no mark before it."""
    head = F.substring(text, 1, limit - 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, "[ ,.;:]+$", ""), F.lit("…")))


def title_line(text: Column, limit: int = 80) -> Column:
    """The first line, trimmed, with an ellipsis beyond ``limit``."""
    line = F.trim(F.split(F.trim(text), "\n", 2)[0])
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("…")))


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes div 3, plus 1."""
    return F.floor(F.octet_length(text) / 3) + 1


def has_phrase(text: Column, phrase: str) -> Column:
    """The phrase between characters that are not of words, in any case."""
    escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase.lower())
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_]){escaped}(?![\p{{L}}\p{{N}}_])")


def plain_mail(text: Column) -> Column:
    """``[at]`` and ``[dot]`` as @ and a point."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*\[at\]\s*", "@"), r"\s*\[dot\]\s*", ".")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def phone_numbers(text: Column) -> Column:
    """Digits of each number in a list parted by , / ; or ``and``; empty ones are left out."""
    return F.filter(F.transform(F.split(text, r"[,/;]|\band\b"), lambda x: F.regexp_replace(x, r"\D", "")), lambda x: x != "")


def section_key(text: Column) -> Column:
    """Leading digits and letters, in lower case."""
    return F.lower(F.regexp_extract(text, r"^\s*(\d+[A-Za-z]*)", 1))


def statute_refs(cell: Column) -> Column:
    """References like ``420(1)(a)`` of a table cell, in order, once each; none for new or deleted sections."""
    none = F.lower(cell).rlike("new section|deleted")
    refs = F.array_distinct(F.regexp_extract_all(cell, F.lit(r"\d+[A-Z]{0,2}(?:\([0-9a-z]+\))*"), 0))
    return F.when(none, F.array().cast("array<string>")).otherwise(refs)


def relationship(cell: Column, refs: Column) -> Column:
    """What a cell of old references suggests: new, deleted, possible_merge (several), corresponding (one), or requires_review."""
    low = F.lower(cell)
    return (
        F.when(low.contains("new section") | low.contains("new sub-section"), "new").when(low.contains("deleted"), "deleted")
        .when(F.size(refs) > 1, "possible_merge").when(F.size(refs) == 1, "corresponding").otherwise("requires_review")
    )


def provision_refs(text: Column) -> Column:
    """``section 17`` and the like, as ``word number`` in lower case, in order, once each."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:section|article|rule|order|अनुच्छेद|धारा)\s+\d+[a-z]{0,2}(?:\([0-9a-z]+\))*"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " ")))


def code_refs(text: Column) -> Column:
    """``ipc 420`` and ``bns 318``, in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:ipc|bns)\s*\d+[a-z]?"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^(ipc|bns)\s*", "$1 ")))


def is_iso_date(text: Column) -> Column:
    """YYYY-MM-DD and a real day."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), F.lit(False))


def is_zoned_timestamp(text: Column) -> Column:
    """An ISO time with a zone."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$") & text.try_cast("timestamp").isNotNull(), F.lit(False))


def is_official(url: Column, hosts: list[str], suffixes: tuple[str, ...] = (".gov.in", ".nic.in", ".nalsa.gov.in")) -> Column:
    """https, no credentials or fragment, and a host that is listed or ends as stated."""
    host = F.lower(F.regexp_extract(url, "^https://([^/?#]*)", 1))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | host.endswith(s)
    return F.coalesce((host != "") & ~host.contains("@") & ~url.contains("#") & (host.isin(hosts) | ends), F.lit(False))
