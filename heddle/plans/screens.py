"""Screens in words, over companies, parts and suppliers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from heddle.operators.screen import NOTHING, REFUSED, TOPICS, parse, plans, screen, topics
from heddle.plans.base import COMPANIES_SQL, companies
from heddle.registry import query
from heddle.session import dealt, table

SEGMENTS = ("building", "automobile", "machinery", "household", "furniture")


def _columns():
    return {c: F.col(c) for c in ("municipality", "legal_form", "employees", "revenue", "annual_result", "website", "financials", "industry")}


def _companies(spark, sf_dir):
    return companies(spark, sf_dir).withColumns({"website": F.when(F.col("custkey") % 3 == 0, F.concat(F.lit("https://"), F.lower("name"))), "financials": F.col("revenue").isNotNull(), "industry": F.col("legal_form")})


def _told(rows):
    return rows.select("organisation_number", "name", "municipality", "employees", "revenue", "cited_modules")


_COLUMNS = "organisation_number, name, municipality, employees, revenue"


@query("screen_filter_topk", f"with {COMPANIES_SQL} select {_COLUMNS}, 'financials,registry' as cited_modules from companies where lower(municipality) = 'nation_3' and employees > 5 and revenue > 1000000 order by revenue desc nulls last, organisation_number limit 10")
def screen_filter_topk(spark, sf_dir):
    plan = parse("companies in NATION_3 with more than 5 employees and revenue over 1 million top 10 by revenue", SEGMENTS)
    return _told(screen(_companies(spark, sf_dir), plan, _columns()))


@query("screen_default_order", f"with {COMPANIES_SQL} select {_COLUMNS}, 'registry' as cited_modules from companies where lower(legal_form) = 'building' and employees <= 4")
def screen_default_order(spark, sf_dir):
    return _told(screen(_companies(spark, sf_dir), parse("legal form building and at most 4 employees", SEGMENTS), _columns()))


@query("screen_loss_making", f"with {COMPANIES_SQL} select {_COLUMNS}, 'financials,registry' as cited_modules from companies where annual_result < 0 order by employees desc nulls last, organisation_number limit 25")
def screen_loss_making(spark, sf_dir):
    return _told(screen(_companies(spark, sf_dir), parse("unprofitable companies, top 25 by employees", SEGMENTS), _columns()))


@query("screen_present", f"with {COMPANIES_SQL} select {_COLUMNS}, 'financials,website' as cited_modules from companies where custkey % 3 = 0 and revenue is not null")
def screen_present(spark, sf_dir):
    return _told(screen(_companies(spark, sf_dir), parse("companies that have a website and with accounts", SEGMENTS), _columns()))


@query("screen_industry_contains", "select lpad(cast(p_partkey as varchar), 9, '0') as organisation_number, p_name as name, p_type as industry, 'registry' as cited_modules from part where contains(lower(p_type), 'steel')")
def screen_industry_contains(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("organisation_number"), F.col("p_name").alias("name"), F.col("p_type").alias("industry"))
    return screen(parts, parse("industry contains 'Steel'"), {"industry": F.col("industry")}).select("organisation_number", "name", "industry", "cited_modules")


#: Evidence of a company: the register always, accounts if it has any.
def _evidence():
    key = F.col("organisation_number")
    seen = lambda site, hashed: F.struct(F.concat(F.lit(f"https://{site}.example.com/"), key).alias("source_url"), F.lit("2024-02-01").alias("retrieved_at"), F.sha2(hashed, 256).alias("content_sha256"))
    return {"registry": seen("reg", key), "financials": F.when(F.col("revenue").isNotNull(), seen("acc", F.concat(key, F.lit("-a"))))}


@query(
    "screen_citations",
    f"""with {COMPANIES_SQL}, found as (select * from companies where employees >= 3 and annual_result > 0 order by revenue desc nulls last, organisation_number limit 60),
each as (select organisation_number, revenue, unnest(['financials', 'registry']) as module from found)
select organisation_number, module, case when module = 'registry' then 'https://reg.example.com/' || organisation_number when revenue is not null then 'https://acc.example.com/' || organisation_number end as source_url,
  case when module = 'registry' or revenue is not null then '2024-02-01' end as retrieved_at, case when module = 'registry' then sha256(organisation_number) when revenue is not null then sha256(organisation_number || '-a') end as content_sha256 from each""",
)
def screen_citations(spark, sf_dir):
    """QRY3: what each company that a screen finds is cited with."""
    plan = parse("profitable companies with at least 3 employees, top 60 by revenue", SEGMENTS)
    found = screen(_companies(spark, sf_dir), plan, _columns(), evidence=_evidence())
    return found.select("organisation_number", F.explode("citations").alias("c")).select("organisation_number", "c.*")


#: Screens made of rows: a part's place, size, price and brand in one of eight wordings.
_WORDINGS = [
    "companies in {place} with more than {n} employees", "revenue at least {price} million", "employees <= {n} and revenue over NOK {price} bn top {n} by revenue", "profitable companies in {place} that have an official website",
    "loss-making companies with annual accounts, top {k} by employees", "companies in {place} with good {term}", "industry contains \"{brand}\" and legal form is as", "{brand} and nothing else",
]
_TERMS = [*list(REFUSED)[:-1], "places without a website"]


def _wording_sql(w: str) -> str:
    fields = {"place": "place", "n": "cast(p_size as varchar)", "k": "cast(p_partkey % 300 as varchar)", "price": "price", "term": "term", "brand": "p_brand"}
    parts = [fields[x] if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(re.split(r"[{}]", w))]
    return " || ".join(p for p in parts if p != "''")


_PLAN_SQL = f"""with p as (select p_partkey, p_size, p_brand, 'Oslo ' || lower(split_part(p_type, ' ', 1)) as place, cast(p_partkey % 90 as varchar) || ',' || cast(p_partkey % 10 as varchar) as price, p_partkey % 90 + (p_partkey % 10) / 10 as amount,
  [{", ".join(f"'{t}'" for t in _TERMS)}][cast(p_partkey % {len(_TERMS)} as int) + 1] as term, [{", ".join(f"'{s}'" for s in REFUSED.values())}][cast(p_partkey % {len(_TERMS)} as int) + 1] as said, p_partkey % 8 as w from part),
q as (select *, case w {" ".join(f"when {i} then {_wording_sql(w)}" for i, w in enumerate(_WORDINGS))} end as query,
  cast(round(amount * 1000000) as bigint) as millions, cast(round(amount * 10) as bigint) * 100000000 as billions from p)
select p_partkey, query, case w when 0 then 'municipality eq ' || upper(place) || '; employees > ' || p_size when 1 then 'revenue >= ' || millions when 2 then 'employees <= ' || p_size || '; revenue > ' || billions
    when 3 then 'municipality eq ' || upper(place) || '; annual_result > 0; website present True' when 4 then 'annual_result < 0; financials available True' when 5 then 'municipality eq ' || upper(place)
    when 6 then 'legal_form eq AS; industry contains ' || lower(p_brand) else '' end as filters,
  case w when 2 then 'revenue' when 4 then 'employees' end as sort, cast(case w when 2 then least(p_size, 100) when 4 then least(p_partkey % 300, 100) end as int) as top,
  w not in (5, 7) as executable, case w when 5 then said when 7 then '{NOTHING}' end as reason from q"""


def _asked(spark, sf_dir):
    k = F.col("p_partkey")
    fields = {
        "place": F.concat(F.lit("Oslo "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))), "n": F.col("p_size").cast("string"), "k": (k % 300).cast("string"),
        "price": F.concat((k % 90).cast("string"), F.lit(","), (k % 10).cast("string")), "term": F.get(F.array(*map(F.lit, _TERMS)), (k % len(_TERMS)).cast("int")), "brand": F.col("p_brand"),
    }
    wording = F.lit(None).cast("string")
    for i, w in enumerate(_WORDINGS):
        parts = re.split(r"[{}]", w)
        wording = F.when(k % 8 == i, F.concat(*[fields[x] if j % 2 else F.lit(x) for j, x in enumerate(parts)])).otherwise(wording)
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type"), "p_partkey").select("p_partkey", wording.alias("query"))


@query("screen_plan_rows", _PLAN_SQL)
def screen_plan_rows(spark, sf_dir):
    """QRY1, QRY2: what the language makes of screens that are made of rows: criteria, order, limit, and why one isn't run."""
    rows = _asked(spark, sf_dir).withColumn("p", plans(F.col("query")))
    told = F.array_join(F.transform("p.filters", lambda f: F.concat_ws(" ", f["field"], f["operator"], f["value"])), "; ")
    return rows.select("p_partkey", "query", told.alias("filters"), "p.sort", "p.top", "p.executable", "p.reason")


@query("screen_refused", f"with p as (select p_partkey % {len(_TERMS)} as t from part where p_partkey % 8 = 5) select [{', '.join(f"'{s}'" for s in REFUSED.values())}][cast(t as int) + 1] as reason, count(*) as screens from p group by 1")
def screen_refused(spark, sf_dir):
    """QRY2: why screens that name what no data supports aren't run, however well the rest is understood, and how many there are."""
    rows = _asked(spark, sf_dir).withColumn("p", plans(F.col("query")))
    # A filter of rows would be moved before the rows are dealt over the tasks, and the screens read by the few that read the file.
    said = rows.groupBy(F.array_join("p.unsupported", "; ").alias("reason")).agg(F.count_if(F.size("p.unsupported") > 0).alias("screens"))
    return said.filter("screens > 0")


_T = {t: " or ".join(f"contains(q, '{w}')" for w in ws) for t, ws in TOPICS.items()}
_TOPIC_SQL = "list_sort(list_filter([" + ", ".join(f"case when {c} then '{t}' end" for t, c in _T.items()) + "], lambda x: x is not null))"


@query("qa_topics", f"with t as (select conv_id, turn, array_to_string({_TOPIC_SQL}, ',') as found from (select conv_id, turn, lower(coalesce(text, '')) as q from conversations where role = 'user')) select conv_id, turn, case when found = '' then 'all' else found end as topics from t")
def qa_topics(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", topics(F.col("text")).alias("topics"))


_FACTS = [("Registered name", "name"), ("Organisation number", "organisation_number"), ("Legal form", "legal_form"), ("Municipality", "municipality"), ("Registry employee count", "cast(employees as varchar)")]


@query("qa_facts", f"with {COMPANIES_SQL} " + " union all ".join(f"select organisation_number, '{label}' as claim, {e} as value, 'official_registry_fact' as classification from companies where coalesce({e}, '') <> ''" for label, e in _FACTS) + " union all select organisation_number, 'Revenue', cast(revenue as varchar), 'official_annual_account' from companies where revenue is not null")
def qa_facts(spark, sf_dir):
    """The facts that a question about employees and revenue is answered with; missing values give none."""
    c = companies(spark, sf_dir).withColumn("employees", F.col("employees").cast("string"))
    facts = [F.struct(F.lit(label).alias("claim"), F.col(e.replace("cast(", "").replace(" as varchar)", "")).alias("value"), F.lit("official_registry_fact").alias("classification")) for label, e in _FACTS]
    facts.append(F.struct(F.lit("Revenue").alias("claim"), F.col("revenue").cast("string").alias("value"), F.lit("official_annual_account").alias("classification")))
    return c.select("organisation_number", F.explode(F.array(*facts)).alias("f")).select("organisation_number", "f.*").filter("coalesce(value, '') <> ''")
