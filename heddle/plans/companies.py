"""Anchoring, integrity, strata, envelopes and briefs of companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import relational as rel
from heddle.operators.envelope import accounting_obligation, brief, claims, contract_errors, terminal_state
from heddle.plans.base import COMPANIES_SQL, companies
from heddle.registry import query
from heddle.session import table


def _manifest(spark, sf_dir):
    """All customer keys, and as many that no register has."""
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return keys.unionByName(keys.select((-F.col("c_custkey")).alias("c_custkey"))).withColumn("position", F.abs("c_custkey") * 2 + (F.col("c_custkey") < 0).cast("int"))


_MANIFEST_SQL = "manifest as (select c_custkey, abs(c_custkey) * 2 + (case when c_custkey < 0 then 1 else 0 end) as position from (select c_custkey from customer union all select -c_custkey from customer))"


@query("anchor_manifest_left", f"with {_MANIFEST_SQL} select m.c_custkey, position, c_name, case when c_name is null then 'not_available' else 'available' end as status from manifest m left join customer c using (c_custkey)")
def anchor_manifest_left(spark, sf_dir):
    bulk = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return rel.anchor(_manifest(spark, sf_dir), bulk, "c_custkey", "position").select("c_custkey", "position", "c_name", "status")


@query("anti_missing_seeds", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_missing_seeds(spark, sf_dir):
    return rel.missing(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("semi_audited", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def semi_audited(spark, sf_dir):
    return rel.audited(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("ref_integrity", "select count(*) as checked, count(*) filter (where o_orderkey is null) as dangling from (select distinct l_orderkey from lineitem) left join orders on o_orderkey = l_orderkey")
def ref_integrity(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    right = table(spark, sf_dir, "orders").select("o_orderkey")
    return left.join(right, F.col("l_orderkey") == F.col("o_orderkey"), "left").agg(F.count("*").alias("checked"), F.count(F.when(F.col("o_orderkey").isNull(), 1)).alias("dangling"))


@query("membership_full_outer", "select coalesce(s_suppkey, p_partkey) as k, case when p_partkey is null then 'only_left' when s_suppkey is null then 'only_right' else 'both' end as side from (select s_suppkey from supplier) full join (select p_partkey * 3 as p_partkey from part) on s_suppkey = p_partkey")
def membership_full_outer(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("p_partkey"))
    side = F.when(F.col("p_partkey").isNull(), "only_left").when(F.col("s_suppkey").isNull(), "only_right").otherwise("both")
    return s.join(p, s["s_suppkey"] == p["p_partkey"], "full").select(F.coalesce("s_suppkey", "p_partkey").alias("k"), side.alias("side"))


_BAND = "case when employees is null then 'missing' when employees = 0 then '0' when employees < 5 then '1-4' when employees < 20 then '5-19' when employees < 100 then '20-99' else '100+' end"


@query("stratum_counts", f"with {COMPANIES_SQL} select (case when legal_form in ('BUILDING', 'MACHINERY') then legal_form else 'OTHER' end) || '|' || {_BAND} || '|' || (case when revenue is null then 'no_accounts' else 'accounts' end) as stratum, count(*) as n from companies group by 1")
def stratum_counts(spark, sf_dir):
    c = companies(spark, sf_dir)
    form = F.when(F.col("legal_form").isin("BUILDING", "MACHINERY"), F.col("legal_form")).otherwise("OTHER")
    return c.groupBy(F.concat_ws("|", form, employee_band(F.col("employees")), F.when(F.col("revenue").isNull(), "no_accounts").otherwise("accounts")).alias("stratum")).agg(F.count("*").alias("n"))


def employee_band(n):
    """SCA30."""
    return F.when(n.isNull(), "missing").when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 100, "20-99").otherwise("100+")


@query("filer_stratum_counts", "select o_orderstatus || '|' || cast(year(o_orderdate) as varchar) as stratum, count(*) as n from orders where o_orderstatus <> 'P' group by 1")
def filer_stratum_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return o.groupBy(F.concat_ws("|", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("stratum")).agg(F.count("*").alias("n"))


@query("top_share", "select municipality, n, round_even(100.0 * n / t, 3) as share from (select n_name as municipality, count(*) as n, sum(count(*)) over () as t from customer join nation on n_nationkey = c_nationkey group by 1) order by n desc, municipality limit 10")
def top_share(spark, sf_dir):
    g = companies(spark, sf_dir).groupBy("municipality").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    # One row joins one row to all: the total is a scalar.
    return g.join(F.broadcast(total)).select("municipality", "n", F.bround(100.0 * F.col("n") / F.col("t"), 3).alias("share")).orderBy(F.desc("n"), "municipality").limit(10)


_CLAIMS_SQL = f"""with {COMPANIES_SQL}, c as (select organisation_number, 'ev-' || organisation_number || '-1' as ev1, 'ev-' || organisation_number || '-2' as ev2, name, legal_form, employees, municipality, revenue,
    case when custkey % 4 = 0 then null else 'https://' || lower(name) || '.example.com' end as website, case custkey % 3 when 0 then 'available' when 1 then 'source_error' else 'not_run' end as web_status from companies),
claims as (
  select organisation_number, 1 as seq, 'legal_name' as field, name as value, case when coalesce(name, '') <> '' then 'available' else 'not_available' end as availability, 1.0 as confidence, ev1 as evidence_id from c
  union all select organisation_number, 2, 'legal_form', legal_form, case when coalesce(legal_form, '') <> '' then 'available' else 'not_available' end, 1.0, ev1 from c
  union all select organisation_number, 3, 'employees', cast(employees as varchar), case when employees is not null then 'available' else 'not_available' end, 1.0, case when employees is not null then ev1 end from c
  union all select organisation_number, 4, 'municipality', municipality, case when coalesce(municipality, '') <> '' then 'available' else 'not_available' end, 1.0, case when coalesce(municipality, '') <> '' then ev1 end from c
  union all select organisation_number, 5, 'annual_revenue', cast(revenue as varchar), case when revenue is not null then 'available' when legal_form in ('ENK', 'FLI') then 'not_applicable' else 'not_available' end, 1.0, case when revenue is not null then ev2 end from c
  union all select organisation_number, 6, 'official_website', website, case when website is null then 'not_available' when web_status = 'source_error' then 'failed' else 'available' end,
    case when website is null then 1.0 when web_status = 'available' then 0.95 when web_status = 'source_error' then 0.5 else 1.0 end,
    case when website is null or web_status = 'source_error' then null when web_status = 'available' then (case when revenue is not null then 'ev-' || organisation_number || '-3' else ev2 end) else ev1 end from c
)"""


def _profiles(spark, sf_dir):
    c = companies(spark, sf_dir)
    return c.withColumns({"website": F.when(F.col("custkey") % 4 != 0, F.concat(F.lit("https://"), F.lower("name"), F.lit(".example.com"))), "web_status": F.when(F.col("custkey") % 3 == 0, "available").when(F.col("custkey") % 3 == 1, "source_error").otherwise("not_run")})


@query("envelope_claims", f"{_CLAIMS_SQL} select organisation_number, cast(seq as int) as seq, field, value, availability, cast(confidence as double) as confidence, evidence_id from claims")
def envelope_claims(spark, sf_dir):
    rows = _profiles(spark, sf_dir).select("organisation_number", F.posexplode(claims()).alias("seq", "claim"))
    return rows.select("organisation_number", (F.col("seq") + 1).alias("seq"), "claim.*")


@query("envelope_availability_hist", f"{_CLAIMS_SQL} select field, availability, count(*) as n from claims group by 1, 2")
def envelope_availability_hist(spark, sf_dir):
    return _profiles(spark, sf_dir).select(F.explode(claims()).alias("c")).groupBy("c.field", "c.availability").agg(F.count("*").alias("n"))


@query("envelope_violations", f"with {COMPANIES_SQL}, e as (select case when custkey % 50 = 0 then 'x' || organisation_number else organisation_number end as org, custkey, 'r' as run_id, case when custkey % 60 = 0 then null else 't' end as started_at from companies) select org, array_to_string(list_filter([case when length(org) <> 9 then 'Invalid organisation_number' end, case when started_at is null then 'Envelope missing valid run section' end, case when custkey % 70 = 0 then 'Claim has invalid availability' end, case when custkey % 80 = 0 then 'Claim cites unknown evidence' end], lambda x: x is not null), '; ') as errors from e where length(org) <> 9 or started_at is null or custkey % 70 = 0 or custkey % 80 = 0")
def envelope_violations(spark, sf_dir):
    """Envelopes with planted faults, and what the validator says of them."""
    k = F.col("custkey")
    base = _profiles(spark, sf_dir)
    claim = claims()
    claim = F.when(k % 70 == 0, F.transform(claim, lambda c: c.withField("availability", F.lit("maybe")))).otherwise(claim)
    claim = F.when(k % 80 == 0, F.transform(claim, lambda c: c.withField("evidence_id", F.lit("ev-none")))).otherwise(claim)
    org = F.col("organisation_number")
    env = base.select(
        F.when(k % 50 == 0, F.concat(F.lit("x"), org)).otherwise(org).alias("org"), F.struct(F.lit("r").alias("run_id"), F.when(k % 60 != 0, "t").alias("started_at"), F.lit("t").alias("completed_at")).alias("run"),
        claim.alias("claims"), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("ev-"), org, F.lit("-"), i.cast("string"))).alias("evidence_ids"),
    )
    return env.select("org", F.array_join(contract_errors(), "; ").alias("errors")).filter("errors <> ''")


@query("terminal_states", "select id, status, case when status = 'available' then 'complete' when status in ('not_applicable', 'not_found', 'source_error') then status when status = 'blocked' then case when contains(lower(coalesce(note, '')), 'robot') then 'blocked_robots' else 'blocked_policy' end else 'submission_error' end as state from (select event_id as id, case event_id % 7 when 0 then 'available' when 1 then 'not_applicable' when 2 then 'not_found' when 3 then 'blocked' when 4 then 'source_error' when 5 then 'odd' end as status, case when event_id % 2 = 0 then 'Robots.txt' end as note from events)")
def terminal_states(spark, sf_dir):
    e = F.col("event_id")
    status = F.when(e % 7 == 0, "available").when(e % 7 == 1, "not_applicable").when(e % 7 == 2, "not_found").when(e % 7 == 3, "blocked").when(e % 7 == 4, "source_error").when(e % 7 == 5, "odd")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), status.alias("status"), F.when(e % 2 == 0, "Robots.txt").alias("note"))
    return rows.select("id", "status", terminal_state(F.col("status"), F.col("note")).alias("state"))


def _money_sql(x: str) -> str:
    return f"case when {x} is null then 'N/A' when abs({x}) >= 1000000 then printf('%.1fM NOK', round_even({x} / 1000000, 1)) when abs({x}) >= 1000 then printf('%.1fk NOK', round_even({x} / 1000, 1)) else printf('%.0f NOK', round_even({x}, 0)) end"


@query(
    "company_brief",
    f"""with {COMPANIES_SQL}, p as (select *, cast(revenue as double) as r, cast(annual_result as double) as a, case when custkey % 3 = 0 then null else custkey end as staff, custkey % 4 as w from companies)
select organisation_number, name || ' (' || organisation_number || ') is a Norwegian ' || legal_form || ' based in ' || municipality || coalesce(' with ' || cast(staff as varchar) || ' registered employee' || (case when staff <> 1 then 's' else '' end), '') || ', active in commercial operations.'
  || (case custkey % 5 when 0 then ' Leadership: Ola (Daglig leder), Kari (Executive).' when 1 then ' Leadership: No official roles registered in the company register.' else '' end)
  || (case when last_year is not null then ' Financials (' || cast(last_year as varchar) || '): Operating revenue of ' || {_money_sql('r')} || ', operating result of ' || {_money_sql('a')} || ', total assets of N/A.' when custkey % 2 = 0 then ' Financials: Latest submitted annual accounts on record for year 2020.' else ' Financials: No filed annual accounts observed in official register.' end)
  || (case w when 0 then ' Web Presence: No official website URL registered.' when 1 then ' Verified official web domain: https://c.no/.' when 2 then ' Registered website URL (https://c.no/) was uncontactable or failed to respond.' else '' end)
  || coalesce(' Unobserved information: ' || nullif(array_to_string(list_filter([case when staff is null then 'registered employee headcount' end, case when last_year is null then 'detailed financial accounting breakdown' end, case when w = 0 then 'verified official web domain' end], lambda x: x is not null), ', '), '') || '.', '') as brief from p""",
)
def company_brief(spark, sf_dir):
    k = F.col("custkey")
    leader = lambda name, role: F.struct(F.lit(name).alias("name"), F.lit(role).cast("string").alias("role"))
    rows = companies(spark, sf_dir).select(
        "organisation_number", "name", "legal_form", "municipality", F.when(k % 3 != 0, k).alias("employees"), F.col("last_year").alias("period"), "revenue", F.col("annual_result").alias("operating_result"),
        F.when(k % 5 == 0, F.array(leader("Ola", "Daglig leder"), leader("Kari", None), leader("Per", "x"))).alias("leaders"), F.when(k % 5 == 1, "not_found").alias("roles_status"),
        F.when(k % 2 == 0, 2020).alias("latest_submitted_accounts"), F.when(k % 4 != 0, "https://c.no/").alias("website"), F.when(k % 4 == 1, "available").when(k % 4 == 2, "source_error").alias("website_status"),
    )
    return rows.select("organisation_number", brief(rows).alias("brief"))


@query("claims_per_company", f"{_CLAIMS_SQL} select n_claims, count(*) as companies from (select organisation_number, count(*) as n_claims from claims where availability = 'available' group by 1) group by 1")
def claims_per_company(spark, sf_dir):
    ok = F.size(F.filter(claims(), lambda c: c["availability"] == "available")).cast("bigint")
    return _profiles(spark, sf_dir).groupBy(ok.alias("n_claims")).agg(F.count("*").alias("companies"))


