"""Row predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def matches(value: Column, wanted: str | None) -> Column:
    """Equality in any case; no wanted value lets all pass, a null value then never does."""
    return F.lit(True) if wanted is None else F.coalesce(F.lower(value) == wanted.lower(), F.lit(False))


def any_matches(values: Column, wanted: list[str]) -> Column:
    """Any of a row's values is one of the wanted, in any case."""
    return F.coalesce(F.exists(values, lambda v: F.lower(v).isin([w.lower() for w in wanted])), F.lit(False))


def profile_allowed(profile: Column, approved: list[str]) -> Column:
    return profile.isNull() | profile.isin(approved)


def in_force(start: Column, end: Column, on: Column, include_undated: bool) -> Column:
    """start <= on <= end, ends included. A malformed date excludes the row; no end is open; no start is excluded, or let in whatever a sound end says."""
    bad_end = end.isNotNull() & ~T.is_iso_date(end)
    inside = (start.try_cast("date") <= on) & (end.isNull() | (end.try_cast("date") >= on))
    return F.coalesce(F.when(bad_end, False).when(start.isNull(), include_undated).when(~T.is_iso_date(start), False).otherwise(inside), F.lit(False))


def scoped(rows: DataFrame, prefixes: DataFrame, column: str, key: str = "doc_id", whole: tuple[str, ...] = ("other",)) -> DataFrame:
    """Rows of each (domain, prefix) whose ``column`` starts with a prefix, once a domain; domains in ``whole`` have all rows. Prefixes are a reviewed list."""
    hit = F.col("domain").isin(*whole) | F.startswith(F.col(column), F.col("prefix"))
    return rows.join(F.broadcast(prefixes), hit).drop("prefix").dropDuplicates(["domain", key])


def unrouted(rows: DataFrame, prefixes: DataFrame, column: str, whole: tuple[str, ...] = ("other",)) -> DataFrame:
    """(domain): domains none of whose prefixes begins a value of ``column``, which is an error."""
    hit = F.col("domain").isin(*whole) | F.startswith(F.col(column), F.col("prefix"))
    return prefixes.select("domain").distinct().join(rows.select(column).distinct().join(F.broadcast(prefixes), hit).select("domain").distinct(), "domain", "left_anti")


def evidence(rows: DataFrame) -> DataFrame:
    """Adds ``rejected`` (the first provenance field that is missing) and defaults for language, status and priority; text trimmed to 500 characters."""
    needed = ("act", "jurisdiction", "url", "sha")
    why = F.lit(None).cast("string")
    for c in reversed(needed):
        why = F.when(F.col(c).isNull() | (F.trim(c) == ""), f"no_{c}").otherwise(why)
    why = F.coalesce(why, F.when(~T.is_zoned_timestamp(F.col("retrieved_at")), "no_retrieved_at"))
    return rows.withColumns({
        "rejected": why, "language": F.coalesce("language", F.lit("en")), "status": F.coalesce("status", F.lit("unknown")),
        "priority": F.coalesce("priority", F.lit(3)), "text": F.trim(F.substring(F.trim("text"), 1, 500)),
    })


def without_sentinels(value: Column, sentinels: list[str]) -> Column:
    """The trimmed value; null for a blank or a sentinel in any case."""
    x = F.trim(value)
    return F.when((x != "") & ~F.lower(x).isin(sentinels), x)


def clean_list(values: Column, most: int = 8) -> Column:
    """Trimmed, non-blank, distinct in order, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def capped(value: Column, most: int = 500) -> Column:
    """The trimmed text, cut to ``most`` characters and trimmed again; null for a blank one."""
    return F.nullif(F.trim(F.substring(F.trim(value), 1, most)), F.lit(""))


def past_day(value: Column, today: Column) -> Column:
    """The day of an ISO date; null if it is malformed or later than ``today``."""
    day = F.when(T.is_iso_date(value), value.try_cast("date"))
    return F.when(day <= today, day)


def known_domain(value: Column, domains: list[str]) -> Column:
    """The domain in lower case, ``other`` if it is none of ``domains``."""
    x = F.lower(F.trim(value))
    return F.when(x.isin(domains), x).otherwise("other")


def typed_or_extracted(typed: Column, extracted: Column) -> Column:
    """What was typed, unless blank."""
    return F.coalesce(F.nullif(F.trim(typed), F.lit("")), extracted)


def typed_domain(typed: Column, extracted: Column) -> Column:
    """The domain that was typed, unless it is blank or ``other``, which says less than what was extracted."""
    x = F.nullif(F.trim(typed), F.lit(""))
    return F.coalesce(F.when(x != "other", x), extracted, x)


def list_violations(rows: DataFrame, key: str, lists: list[str], scalars: list[str] = ()) -> DataFrame:
    """(rule, key, field): lists with a blank or repeated member (trimmed, as they are written), and blank scalars; nulls are no violation."""
    parts = []
    for c in lists:
        trimmed = F.transform(c, lambda x: F.trim(x))
        parts += [("blank_member", c, F.exists(trimmed, lambda x: x == "")), ("duplicate_member", c, F.size(trimmed) != F.size(F.array_distinct(trimmed)))]
    parts += [("blank", c, F.trim(c) == "") for c in scalars]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("field"))) for rule, c, bad in parts]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.field")


def renumber(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("claim_id", F.concat(F.lit("claim-"), F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("string")))


def grounding_runs(rows: DataFrame, case: list[str], key: str, text: str, limit: int, width: int, since: str | None = None) -> DataFrame:
    """(case columns, run, record) over all rows: JSON of a case and its evidence in order, excerpts bounded and marked as shortened, one for each run of ``width`` keys of a case.

    With the column ``since`` (when the source came into force) each piece says whether that is proven. Unique integer keys bound a record to ``width`` pieces of evidence; their number grows with the table.
    """
    more = [] if since is None else [F.col(since).isNotNull().alias("commencement_proven")]
    item = F.struct(F.col(key).alias("id"), T.bounded(F.col(text), limit).alias("excerpt"), (F.length(text) > limit).alias("shortened"), *more)
    got = rows.groupBy(*case, F.floor(F.col(key) / width).alias("run")).agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    return got.select(*case, "run", F.to_json(F.struct(F.concat_ws("/", *case, F.col("run").cast("string")).alias("case_key"), "evidence")).alias("record"))
