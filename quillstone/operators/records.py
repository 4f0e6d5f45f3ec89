"""Reference data: cross checks, lookups with fallbacks, mappings, quotes, deadlines, contacts, constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates as D
from ..functions import text as T


def cross_check(candidates: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Candidates (left_key, right_key, no_ancestor) with a verdict against the snapshot's (left_key, right_key)."""
    known = snapshot.groupBy("left_key").agg(F.collect_set("right_key").alias("known"))
    verdict = F.when(F.col("known").isNull(), "not_in_snapshot").when(F.col("no_ancestor"), "no_ancestor").when(F.array_contains("known", F.col("right_key")), "agrees").otherwise("conflicts")
    return candidates.join(known, "left_key", "left").withColumn("verdict", verdict).drop("known")


def counts_with_zeros(rows: DataFrame, column: str, every: list[str]) -> DataFrame:
    names = rows.sparkSession.createDataFrame([(x,) for x in every], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def phone_check(contacts: DataFrame, known: DataFrame, key: str = "state") -> DataFrame:
    """Contacts (key, phone) with a verdict against known numbers of the key by their last six digits."""
    numbers = known.groupBy(key).agg(F.collect_set("phone").alias("numbers"))
    tail = lambda c: F.right(F.regexp_replace(c, r"\D", ""), F.lit(6))
    mine = tail(F.col("phone"))
    verdict = F.when(F.col("numbers").isNull(), "not_in_snapshot").when(F.col("phone").isNull() | (mine == ""), "no_phone").when(F.exists("numbers", lambda n: tail(n) == mine), "agrees").otherwise("conflicts")
    return contacts.join(numbers, key, "left").withColumn("verdict", verdict).drop("numbers")


def in_interval(rows: DataFrame, spans: DataFrame, key: str, day: str) -> DataFrame:
    """Rows whose day lies in a span (s, e; no e is open) of their key, ends included."""
    return rows.join(spans, key).where((F.col(day) >= F.col("s")) & (F.col("e").isNull() | (F.col(day) <= F.col("e"))))


def overlapping_range_counts(rows: DataFrame, block: list[str], width: int = 16) -> DataFrame:
    """(block, s1, e1, n1, s2, e2, n2): distinct ranges of a block that meet, each pair and each range with itself once, with their rows.

    No window on ids: rows with one range are one class of n rows, and the members of a class are the rows with the same block, s and e.
    Ranges look for partners in the cells of ``width`` that they touch, and meet in the first cell that they share.
    """
    r = rows.groupBy(*block, "s", "e").agg(F.count(F.lit(1)).alias("n")).where("s <= e")
    r = r.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    side = lambda k: r.select(*block, "cell", *[F.col(c).alias(c + k) for c in ("s", "e", "n")])
    order = (F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("e1") <= F.col("e2")))
    both = side("1").join(side("2"), [*block, "cell"]).where(order & (F.col("s2") <= F.col("e1")) & (F.col("cell") == F.floor(F.col("s2") / width)))
    return both.select(*block, "s1", "e1", "n1", "s2", "e2", "n2")


def range_partners(rows: DataFrame, block: list[str], key: str, width: int = 16) -> DataFrame:
    """(key, n_partners): how many other rows of its block have a range [s, e] that meets the row's, from counts of distinct ranges; no pair of rows is formed. Rows without a range have none."""
    met = overlapping_range_counts(rows, block, width)
    apart = (F.col("s1") != F.col("s2")) | (F.col("e1") != F.col("e2"))
    one = met.select(*block, F.col("s1").alias("s"), F.col("e1").alias("e"), F.col("n2").alias("n"))
    two = met.where(apart).select(*block, F.col("s2").alias("s"), F.col("e2").alias("e"), F.col("n1").alias("n"))
    total = one.union(two).groupBy(*block, "s", "e").agg(F.sum("n").alias("n"))
    return rows.join(total, [*block, "s", "e"], "left").select(key, F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_partners"))


def range_pairs(rows: DataFrame, block: list[str], key: str, width: int = 16) -> DataFrame:
    """(key, class_id, partner_id, n_partners): for each row, each class of rows of its block whose range meets the row's, without the row itself.

    A class is the rows of a block with one range, named by its least key, so ``class_id`` is the membership of a row and (class_id, partner_id) the pairs
    between representatives: joined with the membership on ``partner_id`` they give all pairs of rows.
    """
    met = overlapping_range_counts(rows, block, width)
    apart = (F.col("s1") != F.col("s2")) | (F.col("e1") != F.col("e2"))
    side = lambda a, b: [*block, F.col(f"s{a}").alias("s"), F.col(f"e{a}").alias("e"), F.col(f"s{b}").alias("ps"), F.col(f"e{b}").alias("pe"), F.col(f"n{b}").alias("n")]
    both = met.select(*side(1, 2)).union(met.where(apart).select(*side(2, 1)))
    least = rows.groupBy(*block, "s", "e").agg(F.min(key).alias("class_id"))
    named = both.join(least, [*block, "s", "e"]).join(least.select(*block, F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("class_id").alias("partner_id")), [*block, "ps", "pe"])
    own = F.when(F.col("class_id") == F.col("partner_id"), F.col("n") - 1).otherwise(F.col("n"))
    pairs = named.select(*block, "s", "e", "class_id", "partner_id", own.alias("n_partners"))
    return rows.join(pairs, [*block, "s", "e"]).where("n_partners > 0").select(key, "class_id", "partner_id", "n_partners")


def check_quotes(quotes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(quote_id, source_known, verbatim): whether the quote stands in the cited text, white space and case aside."""
    both = quotes.join(corpus, "source_id", "left")
    inside = F.coalesce(F.contains(T.quote_key(F.col("text")), T.quote_key(F.col("quote"))), F.lit(False))
    return both.select("quote_id", F.col("text").isNotNull().alias("source_known"), inside.alias("verbatim"))


def with_fallback(rows: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, origin, citation): the first tier (key, x) that has the key, else the key itself."""
    out, origin, found = rows, F.lit("raw"), F.col(key).cast("string")
    for name, tier in reversed(tiers):
        out = out.join(tier.withColumnRenamed("x", f"_{name}"), key, "left")
        origin, found = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(origin), F.coalesce(F.col(f"_{name}"), found)
    return out.select(key, origin.alias("origin"), found.alias("citation"))


def resolve_place(cases: DataFrame, states: DataFrame, aliases: DataFrame, fallbacks: list[str] = ()) -> DataFrame:
    """Cases (state, home, district) with status, contact and ``fallbacks``: another state's contact or none; at home a district's by alias, or unmatched; no state: unknown.

    The nationwide fallbacks are attached to every case, whatever its status. Directories have a row for each state or district.
    """
    out = cases.join(F.broadcast(states.select("state", F.col("contact").alias("_s"))), "state", "left")
    out = out.withColumn("alias", T.place_key(F.col("district"))).join(F.broadcast(aliases.select("alias", F.col("contact").alias("_d"))), "alias", "left")
    away = ~F.col("home")
    status = F.when(F.col("home").isNull(), "unknown").when(away & F.col("_s").isNotNull(), "matched").when(away, "none").when(F.col("_d").isNotNull(), "matched").otherwise("unmatched")
    always = F.array(*[F.lit(x) for x in fallbacks]).cast("array<string>")
    return out.withColumn("status", status).withColumns({"contact": F.when(away, F.col("_s")).when(F.col("home"), F.col("_d")), "fallbacks": always}).drop("_s", "_d")


def mapping_status(cases: DataFrame, key: str, mappings: DataFrame) -> DataFrame:
    """(key, status, candidates) of cases (key, day, term) over reviewed mappings (term, effective_from, review_status)."""
    good = mappings.where("review_status = 'reviewed'").select("term", "effective_from", F.lit(1).alias("hit"))
    got = cases.join(good, "term", "left").groupBy(key, "day").agg(F.count("hit").alias("candidates"), F.bool_and(F.col("day") >= F.col("effective_from")).alias("all"))
    return got.withColumn("status", F.when(F.col("candidates") == 0, "not_found").when(F.col("day").isNull(), "date_required").when(F.col("all"), "current").otherwise("historical"))


def deadline_notes(today: Column) -> Column:
    """Notes of a deadline row (review_status, start, count, unit)."""
    due = D.add_period(F.col("start"), F.col("count"), F.col("unit"))
    return F.array_compact(F.array(F.when(F.col("review_status") != "reviewed", "unreviewed"), F.when(F.col("start").isNull(), "no_start"), F.when(due < today, "expired")))


def all_violations(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violation(rows: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def duplicates(rows: DataFrame, rule: str, key: Column) -> DataFrame:
    return violation(rows.groupBy(key.cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rule, F.col("k"), F.col("n"))


def manifest_violations(sources: DataFrame) -> DataFrame:
    """(rule, key, detail) of a manifest: unique ids and folded filenames, listed hosts, date order, amendments of other, known, principal sources."""
    s = sources
    host = F.lower(F.regexp_extract("url", "^https://([^/?#]*)", 1))
    edges = s.select("source_id", F.explode("modifies_source_ids").alias("target"))
    principal = s.select(F.col("source_id").alias("target"), "relationship")
    return all_violations([
        duplicates(s, "duplicate_id", F.col("source_id")), duplicates(s, "duplicate_filename", F.lower("filename")),
        violation(s.where(~F.coalesce(F.array_contains("allowed_hosts", host), F.lit(False))), "host", F.col("source_id"), host),
        violation(s.where("effective_to < effective_from"), "date_order", F.col("source_id")),
        violation(s.where("relationship = 'amendment' and size(modifies_source_ids) = 0"), "amends_nothing", F.col("source_id")),
        violation(edges.where("source_id = target"), "amends_itself", F.col("source_id")),
        violation(edges.join(principal, "target", "left_anti"), "unknown_target", F.col("source_id"), F.col("target")),
        violation(edges.join(principal.where("relationship <> 'principal'"), "target"), "target_not_principal", F.col("source_id"), F.col("target")),
    ])


def directory_violations(contacts: DataFrame, fallbacks: DataFrame, required: list[str], home: str = "Delhi") -> DataFrame:
    """(rule, key, detail): unique ids and districts, home districts only in that tier, required fallbacks present."""
    need = contacts.sparkSession.createDataFrame([(x,) for x in required], "fallback_id string")
    return all_violations([
        duplicates(contacts, "duplicate_contact", F.col("contact_id")), duplicates(fallbacks, "duplicate_fallback", F.col("fallback_id")),
        duplicates(contacts.where("district is not null"), "duplicate_district", T.place_key(F.col("district"))),
        violation(contacts.where(F.col("district").isNotNull() & (F.col("state") != home)), "foreign_district", F.col("contact_id"), F.col("state")),
        violation(need.join(fallbacks, "fallback_id", "left_anti"), "missing_fallback", F.col("fallback_id")),
    ])


def directory_rows(rows: DataFrame, states: list[str]) -> DataFrame:
    """Contacts from table rows (row_no, cells): four cells, a listed state, the first row of each state, reachable by phone or mail."""
    c = lambda k: F.trim(F.get("cells", F.lit(k)))
    got = rows.where((F.size("cells") == 4) & c(0).isin(states)).select("row_no", c(0).alias("state"), c(1).alias("authority"), T.phone_numbers(c(2)).alias("phones"), F.regexp_extract(T.plain_mail(c(3)), r"[\w.+-]+@[\w.-]+\.\w+", 0).alias("email"))
    got = got.withColumn("k", F.row_number().over(W.partitionBy("state").orderBy("row_no"))).where("k = 1").drop("k")
    return got.where((F.size("phones") > 0) | (F.col("email") != ""))


def district_candidates(states: DataFrame) -> DataFrame:
    """(candidate_id, state, district) of nested (name, districts), ids from the state's slug and the position."""
    d = states.select(F.col("name").alias("state"), F.posexplode("districts").alias("pos", "district"))
    return d.select(F.concat(T.slug(F.col("state")), F.lit("-"), (F.col("pos") + 1).cast("string")).alias("candidate_id"), "state", "district")


def stamped(rows: DataFrame, order: str, imported_at: str, digest: str) -> DataFrame:
    """Imported rows with an id by position, a pending status and their provenance."""
    ranked = rows.withColumn("position", F.row_number().over(W.orderBy(order)))  # a reviewed list of hundreds of rows
    return ranked.withColumns({"candidate_id": F.format_string("candidate-%04d", "position"), "review_status": F.lit("pending"), "imported_at": F.lit(imported_at), "source_digest": F.lit(digest)})


def selected_sources(manifest: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sources asked for in the manifest's order, unknown ids)."""
    ask = manifest.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(w.strip() for w in wanted) if x], "source_id string")
    return manifest.join(F.broadcast(ask), "source_id", "left_semi").orderBy("position"), ask.join(manifest, "source_id", "left_anti")


def mapping_candidates(rows: DataFrame) -> DataFrame:
    """(row_id, reference, new_text, old_refs, hint) of table rows (row_id, cells): a row id, exactly two cells, the first not blank; ``1.2`` is ``1(2)``."""
    new, old = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    refs = T.statute_refs(old)
    good = rows.where(F.coalesce(F.col("row_id") != "", F.lit(False)) & (F.size("cells") == 2) & (new != ""))
    return good.select("row_id", F.regexp_replace("row_id", r"^([^.]*)\.(.*)$", "$1($2)").alias("reference"), new.alias("new_text"), refs.alias("old_refs"), T.relationship(old, refs).alias("hint"))


def worksheet(candidates: DataFrame, chunks: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(number, mapping_id, row_id, score, hint, old_refs, target, text_held) for a reviewer: the ``limit`` candidates with most ``terms`` in their texts, ties by row id.

    candidates (row_id, reference, new_text, old_text, old_refs, hint), chunks (source_id, section). Candidates without an old reference and new ones pair nothing and are left out. The target is the
    reference without what stands in brackets; ``text_held``: the corpus of the new code has that section.
    """
    from .mappings import TARGET_CORPUS

    low = F.lower(F.concat_ws(" ", "new_text", "old_text"))
    score = F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)))
    pairs = candidates.where((F.size("old_refs") > 0) & (F.col("hint") != "new")).withColumn("score", score)
    best = pairs.orderBy(F.desc("score"), "row_id").limit(limit)
    target = F.element_at(F.split("reference", r"\("), 1)
    held = chunks.where(F.startswith("source_id", F.lit(TARGET_CORPUS))).select(F.col("section").alias("target"), F.lit(True).alias("held")).distinct()
    rows = best.withColumn("target", target).join(held, "target", "left").withColumn("number", F.row_number().over(W.orderBy(F.desc("score"), "row_id")))  # ``limit`` rows
    name = F.concat(F.lit("ipc-"), F.array_join("old_refs", "-"), F.lit("-bns-"), F.col("target"))
    return rows.select("number", name.alias("mapping_id"), "row_id", "score", "hint", "old_refs", "target", F.coalesce("held", F.lit(False)).alias("text_held"))


def district_contacts(rows: DataFrame) -> DataFrame:
    """(contact_id, authority, district, officer_name, phone, email) from table rows (cells): four cells with ``Secretary, X DLSA``, a mail and a phone."""
    c = lambda k: F.trim(F.get("cells", F.lit(k)))
    named = F.regexp_extract(c(1), r"(?i)Secretary,\s*(.+?),?\s+DLSA\b", 1)
    district = F.trim(F.regexp_replace(named, r"\s+", " "), F.lit(" ,-–"))
    got = rows.where(F.size("cells") == 4).select(district.alias("district"), c(0).alias("officer_name"), T.plain_mail(c(2)).alias("email"), c(3).alias("phone"))
    got = got.where((F.col("district") != "") & (F.col("email") != "") & (F.col("phone") != ""))
    return got.select(F.concat(F.lit("delhi-dlsa-"), T.slug(F.col("district"))).alias("contact_id"), F.concat("district", F.lit(" District Legal Services Authority")).alias("authority"), "district", "officer_name", "phone", "email")


def fallback_violations(fallbacks: DataFrame, phones: dict[str, str], scope: str = "india") -> DataFrame:
    """(rule, key, detail): required fallbacks that are missing, or have another phone or scope than reviewed."""
    need = fallbacks.sparkSession.createDataFrame(list(phones.items()), "fallback_id string, expected string")
    both = need.join(fallbacks, "fallback_id", "left")
    wrong = ~F.coalesce((F.col("phone") == F.col("expected")) & (T.place_key(F.col("scope")) == scope), F.lit(False))
    return all_violations([
        violation(need.join(fallbacks, "fallback_id", "left_anti"), "missing_fallback", F.col("fallback_id")),
        violation(both.where(F.coalesce("phone", "scope").isNotNull() & wrong), "unreviewed_fallback", F.col("fallback_id"), F.col("phone")),
    ])


def consequences(cases: DataFrame, deadlines: DataFrame, today: Column, reviewed_only: bool = False) -> DataFrame:
    """(case_id, deadline_id, due, days_remaining, notes) of cases (case_id, domain, start) by the deadlines of their domain, a reviewed list.

    deadlines (deadline_id, domain, count, unit, effective_from, review_status). Notes: ``no_start`` (a question), ``unverified_commencement`` for a source without a date,
    ``unreviewed``, ``expired``. A case without a deadline gets one row with the note ``sources_silent``.
    """
    chosen = deadlines.where("review_status = 'reviewed'") if reviewed_only else deadlines
    rows = cases.join(F.broadcast(chosen), "domain", "left")
    due = D.add_period(F.col("start"), F.col("count"), F.col("unit"))
    rows = rows.withColumn("due", due).withColumn("days_remaining", F.datediff("due", today))
    there = F.col("deadline_id").isNotNull()
    notes = F.array_compact(F.array(
        F.when(~there, "sources_silent"), F.when(there & F.col("start").isNull(), "no_start"), F.when(there & F.col("effective_from").isNull(), "unverified_commencement"),
        F.when(F.col("review_status") != "reviewed", "unreviewed"), F.when(F.col("due") < today, "expired"),
    ))
    return rows.select("case_id", "deadline_id", "due", "days_remaining", notes.alias("notes"))


def deadline_violations(deadlines: DataFrame) -> DataFrame:
    """(rule, key, detail): ids that come twice, and practical risks that do not state what they depend on."""
    vague = deadlines.where((F.col("consequence_kind") == "practical_risk") & (F.coalesce(F.size("depends_on"), F.lit(0)) <= 0))
    return all_violations([duplicates(deadlines, "duplicate_id", F.col("deadline_id")), violation(vague, "depends_on_nothing", F.col("deadline_id"))])


def rights(entries: DataFrame, domains: list[str], always: str = "constitutional") -> DataFrame:
    """(case_domain, right_id): the entries of each domain and those that hold for all; the domains are a short list."""
    asked = entries.sparkSession.createDataFrame([(d,) for d in domains], "case_domain string")
    return entries.join(F.broadcast(asked), (F.col("domain") == F.col("case_domain")) | (F.col("domain") == always)).select("case_domain", "right_id")
