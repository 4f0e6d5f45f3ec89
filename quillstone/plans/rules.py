"""Queries of dates, rules and guards."""

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import rules as R
from .registry import query, table


@query("""with o as (select o_orderkey, cast(o_orderdate as date) as day, cast(o_orderkey % 5 + 1 as int) as n, (['day','month','year'])[o_orderkey % 3 + 1] as unit from orders)
 select o_orderkey, cast(case unit when 'day' then day + n when 'month' then day + to_months(n) else day + to_months(12 * n) end as date) as due, n || ' ' || unit || case when n = 1 then '' else 's' end as period from o""")
def period_due(spark, sf):
    """Due dates of a period in days, months or years."""
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (key % 5 + 1).cast("int").alias("n"), F.get(F.array(F.lit("day"), F.lit("month"), F.lit("year")), (key % 3).cast("int")).alias("unit"))
    return o.select("o_orderkey", D.add_period(F.col("day"), F.col("n"), F.col("unit")).alias("due"), D.period_text(F.col("n"), F.col("unit")).alias("period"))


@query("""with o as (select o_orderkey, case when o_orderkey % 6 <> 0 then cast(o_orderdate as date) + 30 end as due from orders)
 select o_orderkey, coalesce(cast(due - date '1996-01-01' as int), 0) as days_left, coalesce(due < date '1996-01-01', false) as expired, due is null as ask from o""")
def days_remaining(spark, sf):
    """Days to the due date on a fixed day; unknown starts give a question."""
    due = F.when(F.col("o_orderkey") % 6 != 0, F.date_add(F.to_date("o_orderdate"), 30))
    today = F.lit("1996-01-01").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.datediff(due, today), F.lit(0)).alias("days_left"), F.coalesce(due < today, F.lit(False)).alias("expired"), due.isNull().alias("ask"))


@query("select o_orderkey, cast(cast(o_orderdate as date) + to_months(120) as date) as tenth from orders")
def anniversary(spark, sf):
    """D3."""
    return table(spark, sf, "orders").select("o_orderkey", D.anniversary(F.to_date("o_orderdate")).alias("tenth"))


@query("select o_orderkey, case when o_orderkey % 8 = 0 then 'ask' when cast(o_orderdate as date) < date '1995-07-01' then 'old' else 'new' end as code from orders")
def governing_code(spark, sf):
    """D5."""
    day = F.when(F.col("o_orderkey") % 8 != 0, F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", D.governing_code(day, "1995-07-01", "old", "new").alias("code"))


@query("""with e as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 2 then '2024-7-1' else '2024-02-31' end as x from events)
 select event_id, event_id % 4 = 0 as iso_date, event_id % 4 = 1 as zoned from e""")
def iso_checks(spark, sf):
    """Dashed ISO dates that exist, and times with a zone."""
    key = F.col("event_id") % 4
    x = F.when(key == 0, F.date_format("ts", "yyyy-MM-dd")).when(key == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(key == 2, "2024-7-1").otherwise("2024-02-31")
    return table(spark, sf, "events").select("event_id", x.alias("x")).select("event_id", T.is_iso_date(F.col("x")).alias("iso_date"), T.is_zoned_timestamp(F.col("x")).alias("zoned"))


@query("""with o as (select o_orderkey as k, cast(o_orderdate as date) as day, cast(o_totalprice / 40 as decimal(18,2)) as rent, cast(o_orderdate as date) - 3000 - cast(o_orderkey % 2000 as int) as completed from orders),
 f as (select *, case k % 13 when 0 then true when 1 then null else false end as government, case k % 11 when 0 then false when 1 then null else true end as in_area,
  case k % 7 when 0 then false when 1 then null else true end as is_premises, case k % 5 when 0 then false when 1 then null else true end as is_tenant from o),
 m as (select *, concat_ws('+', case when government is null then 'government' end, case when in_area is null then 'in_area' end, case when is_premises is null then 'is_premises' end, case when is_tenant is null then 'is_tenant' end) as missing from f)
 select k as o_orderkey, case when government is true then 'excluded:government' when in_area is false then 'excluded:area' when is_premises is false then 'excluded:premises' when is_tenant is false then 'excluded:tenant'
  when day >= date '1994-12-01' and rent > 3500 then 'excluded:rent' when day >= date '1994-12-01' and cast(completed + to_months(120) as date) > day then 'excluded:new_building'
  when missing <> '' then 'missing:' || missing else 'applicable' end as verdict from m""")
def applicability(spark, sf):
    """Ordered exclusions on facts that may be unknown, with a decimal threshold."""
    k = F.col("o_orderkey")
    three = lambda n, first: F.when(k % n == 0, first).when(k % n == 1, None).otherwise(not first)
    facts = {"government": three(13, True), "in_area": three(11, False), "is_premises": three(7, False), "is_tenant": three(5, False)}
    day = F.to_date("o_orderdate")
    completed = F.date_sub(day, (k % 2000 + 3000).cast("int"))
    verdict = R.rent_act(day, (F.col("o_totalprice") / 40).cast("decimal(18,2)"), facts, completed, since="1994-12-01")
    return table(spark, sf, "orders").select("o_orderkey", verdict.alias("verdict"))


@query("""with p as (select doc_id as id, 'd' as kind, text as h from documents union all select page_id, 'p', html from pages)
 select kind, id, concat_ws(',', case when regexp_matches(h, '(?i)\\b(the|der) [a-z]+ion\\b') then 'ion' end, case when regexp_matches(h, '<[^>]*script') then 'script' end, case when regexp_matches(h, '[#%&*$]{3}') then 'marks' end) as flags from p""")
def injection_flags(spark, sf):
    """Named patterns that occur in documents and pages."""
    patterns = {"ion": r"(?i)\b(the|der) [a-z]+ion\b", "script": "<[^>]*script", "marks": "[#%&*$]{3}"}
    d = table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    rows = d.union(table(spark, sf, "pages").select(F.lit("p"), "page_id", "html"))
    return rows.select("kind", "id", F.array_join(R.pattern_flags(F.col("text"), patterns), ",").alias("flags"))


RELATIONS = {"wage": (["the", "er"], ["of", "and"]), "home": (["der"], ["und", "das"]), "family": (["les", "la"], ["que"])}
def _first_sql(terms):
    hit = "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])" + "%s" + "($|[^\\p{L}\\p{N}_])')"
    return "case " + " ".join(f"when {hit % t} then '{t}'" for t in terms) + " end"


ROLES_SQL = " union all ".join(f"select conv_id, turn, '{n}' as relation, {_first_sql(a)} as first, {_first_sql(b)} as second from conversations" for n, (a, b) in RELATIONS.items())


@query(f"select * from ({ROLES_SQL}) where first is not null and second is not null")
def role_signals(spark, sf):
    """Relations with a term of either side in a turn."""
    c = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return R.role_signals(c, "key", "text", RELATIONS).select("key.*", "relation", "first", "second")


@query()
def urgency_signals(spark, sf):
    """Actionable phrases by category, whole conversations."""
    phrases = {"harm": ["threat", "the that"], "time": ["in the", "today"], "loss": ["of the"]}
    c = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return R.urgency_signals(c, "key", "text", phrases).select("key.*", "category", "phrase")


@query()
def disallowed_requests(spark, sf):
    """Disallowed patterns without a warning before them."""
    c = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return R.disallowed_requests(c, "key", "text", {"forge": r"\bforge\b|\bthe th\w+", "evade": r"\bof \w+ly\b"}).select("key.*", "rule")


@query("""select c_custkey, concat_ws('+', case when c_nationkey % 6 = 0 then 'jurisdiction' end, case when c_custkey % 5 = 0 then 'domain' end, case when c_custkey % 4 = 0 and c_custkey % 5 in (1, 2) then 'date' end) as questions,
 case when c_custkey % 17 = 0 then 'unconfirmed' when c_acctbal < 0 then 'urgent' when c_custkey % 19 = 0 then 'refuse' when c_nationkey % 6 = 0 or c_custkey % 5 = 0 or (c_custkey % 4 = 0 and c_custkey % 5 in (1, 2)) then 'needs_info' else 'standard' end as route from customer""")
def case_routes(spark, sf):
    """Missing-fact questions and the cascade of routes."""
    k = F.col("c_custkey")
    domain = F.get(F.array(*[F.lit(x) for x in ("other", "civil", "labour", "tax", "family")]), (k % 5).cast("int"))
    ask = R.missing_facts(F.when(F.col("c_nationkey") % 6 != 0, "x"), domain, F.when(k % 4 != 0, F.lit("2024-01-01").cast("date")), ["civil", "labour"])
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.array_join(ask, "+").alias("questions"), R.route(F.col("c_acctbal") < 0, k % 19 == 0, ask, k % 17 != 0).alias("route"))


@query("""with o as (select o_orderkey as k, cast(o_orderdate as date) - case when o_orderkey % 4 = 0 then 2200 when o_orderkey % 29 = 0 then 14000 else 0 end as day, case o_orderkey % 11 when 0 then false when 1 then null else true end as area, case o_orderkey % 13 when 0 then true when 1 then null else false end as grant_,
  case o_orderkey % 7 when 0 then true when 1 then null else false end as owned, case when o_orderkey % 7 = 0 then case o_orderkey % 3 when 0 then true when 1 then false end when o_orderkey % 31 = 0 then true end as letting,
  case when o_orderkey % 6 <> 5 then cast(o_totalprice / 60 as decimal(18,2)) end as rent, case when o_orderkey % 5 <> 4 then cast(o_orderdate as date) - cast(o_orderkey % 5000 as int) end as completed from orders),
 p as (select *, case when not coalesce(owned, false) and letting is not null then 'letting_without_owner' when completed > day then 'completed_after_day' when grant_ and owned and letting then 'grant_and_letting' end as problem, day >= date '1988-12-01' as late from o),
 x as (select *, case when day < date '1959-02-09' then '1(3)' when not area then '1(2)' when grant_ then '3(b)' when owned and not letting then '3(a)' when late and rent > 3500 then '3(c)' when late and completed >= date '1988-12-01' and day < cast(completed + to_months(120) as date) then '3(d)' end as section,
  concat_ws('+', case when area is null then 'area' end, case when grant_ is null then 'grant' end, case when owned is null then 'owned' end, case when owned and letting is null then 'letting' end, case when late and rent is null then 'rent' end, case when late and completed is null then 'completed' end) as lacks from p)
 select k as o_orderkey, problem, case when problem is not null then null when section is not null then 'not_applicable' when lacks <> '' then 'needs_facts' else 'applicable' end as decision, case when problem is null then section end as section, case when problem is null and section is null then lacks else '' end as missing,
  case when problem is not null then '' when section is not null then section else '1(2)+1(3)+3(a)+3(b)' || case when late then '+3(c)+3(d)' else '' end end as cited from x""")
def rent_applicability(spark, sf):
    """Contradictions, ordered exclusions with their sections, missing facts, and the sections cited."""
    k = F.col("o_orderkey")
    flag = lambda n, zero: F.when(k % n == 0, zero).when(k % n == 1, None).otherwise(not zero)
    ordered = F.to_date("o_orderdate")
    day = F.date_sub(ordered, F.when(k % 4 == 0, 2200).when(k % 29 == 0, 14000).otherwise(0))
    letting = F.when(k % 7 == 0, F.when(k % 3 == 0, True).when(k % 3 == 1, False)).when(k % 31 == 0, True)
    got = R.rent_applicability(
        day, flag(11, False), flag(13, True), flag(7, True), letting, F.when(k % 6 != 5, (F.col("o_totalprice") / 60).cast("decimal(18,2)")), F.when(k % 5 != 4, F.date_sub(ordered, (k % 5000).cast("int"))),
    )
    out = table(spark, sf, "orders").select("o_orderkey", got.alias("r")).select("o_orderkey", "r.*")
    return out.withColumns({"missing": F.array_join("missing", "+"), "cited": F.array_join("cited", "+")})


@query("""with c as (select c_custkey as k, c_nationkey % 6 = 0 as j, c_acctbal < 0 as u, c_custkey % 23 = 0 as twice from customer)
 select k as c_custkey, case when k % 17 = 0 or twice and u then 'error' when u then 'urgent' when k % 19 = 0 then 'refuse' when j then 'needs_info' else 'standard' end as route, u and k % 17 <> 0 and not twice as human_help, k % 17 <> 0 and (u and not twice or not u and k % 19 = 0) as terminal,
  case when k % 17 = 0 then 'unconfirmed' when twice and u then 'duplicate_urgency' when u then 'urgent:harm+arrest' when k % 19 = 0 then 'disallowed_request' when j then 'missing:jurisdiction' end as reason from c""")
def route_decisions(spark, sf):
    """Routes with their flags and reasons; unconfirmed cases and repeated urgencies are errors."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    urgencies = F.when(F.col("c_acctbal") < 0, F.array(F.lit("harm"), F.when(k % 23 == 0, "harm").otherwise("arrest"))).otherwise(none)
    ask = F.when(F.col("c_nationkey") % 6 == 0, F.array(F.lit("jurisdiction"))).otherwise(none)
    return table(spark, sf, "customer").select("c_custkey", R.route_decision(urgencies, k % 19 == 0, ask, k % 17 != 0).alias("r")).select("c_custkey", "r.*")


def _claim_gate(lines):
    rows = lines.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("claim_id"), F.array("l_partkey").alias("cited"), "l_returnflag")
    claims = rows.dropDuplicates(["answer_id", "claim_id"]).select("answer_id", "claim_id", "cited")
    first = rows.groupBy("answer_id", "claim_id").agg(F.first("cited").alias("evidence"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("bad"))
    verdicts = first.where("not (answer_id % 97 = 0 and claim_id = 1)").select("answer_id", "claim_id", F.when(F.col("bad"), "insufficient").otherwise("supported").alias("verdict"), "evidence", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
    claims = claims.join(first.select("answer_id", "claim_id", F.col("evidence").alias("c")), ["answer_id", "claim_id"]).select("answer_id", "claim_id", F.col("c").alias("cited"))
    return R.claim_gate(claims, verdicts)


@query("""with l as (select l_orderkey, l_linenumber, l_orderkey % 97 = 0 and l_linenumber = 1 as lost, l_returnflag from lineitem)
 select l_orderkey as answer_id, case when bool_or(lost) or bool_or(n > 1) then 'error' when bool_and(l_returnflag <> 'R') then 'verified' else 'abstained' end as stage
 from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from l) group by l_orderkey""")
def claim_gate(spark, sf):
    """Answers (orders) whose claims (lines) all have one supported verdict on cited evidence."""
    return _claim_gate(table(spark, sf, "lineitem"))


@query("""select l_orderkey, l_linenumber, l_suppkey from lineitem l where not exists (select 1 from supplier s where s.s_suppkey = l.l_suppkey and s.s_suppkey % 3 <> 0)""")
def citation_antijoin(spark, sf):
    """Citations of sources that were not retrieved."""
    known = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(known, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""with c as (select doc_id, doc_id % 50 as section, doc_id % 3 as kind from documents)
 select doc_id as claim_id, 'section ' || section as ref from c where kind = 2""")
def citation_guard(spark, sf):
    """References of claims that their cited sections and excerpts don't hold."""
    d = table(spark, sf, "documents")
    section = (F.col("doc_id") % 50).cast("string")
    claims = d.select(F.col("doc_id").alias("claim_id"), F.concat(F.lit("As Section "), section, F.lit(" says.")).alias("text"))
    citations = d.select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("source_id"))
    evidence = d.select(
        F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, section).otherwise("0x").alias("section"),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see section "), section, F.lit(", there"))).otherwise("").alias("excerpt"),
    )
    return R.ungrounded_refs(claims, citations, evidence)


@query("""select l_orderkey, l_linenumber, case when l_linestatus = 'F' and l_returnflag = 'N' then 'error' when l_returnflag = 'R' then case when l_partkey % 2 = 0 then 'supported' else 'insufficient' end else case when l_returnflag = 'A' then 'contradicted' else 'insufficient' end end as verdict from lineitem""")
def verdict_rules(spark, sf):
    """R16."""
    raw = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), "sure").when(F.col("l_returnflag") == "R", "supported").when(F.col("l_returnflag") == "A", "contradicted").otherwise("insufficient")
    evidence = F.when(F.col("l_partkey") % 2 == 0, F.array("l_partkey")).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.settled_verdict(raw, evidence, F.array("l_partkey")).alias("verdict"))
