"""Filers, strata, fields of screens and saved workspaces, over customers read as a register."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import register
from heddle.operators.screen import parse, screen
from heddle.registry import query
from heddle.session import dealt, table

_R_SQL = """r as (select c_custkey as k, case c_custkey % 5 when 0 then 'AS' when 1 then 'ASA' when 2 then 'ENK' when 3 then 'KF' end as form, case when c_custkey % 4 <> 0 then c_custkey % 130 end as staff, c_custkey % 11 = 0 as bankrupt, c_custkey % 13 = 0 as liquidating,
  c_custkey % 3 = 0 as web, case when c_custkey % 2 = 0 then '2025' when c_custkey % 7 <> 0 then '2024' end as filed, case when c_custkey % 6 <> 0 then (10 + c_custkey % 8) || '.' || (c_custkey % 100) end as industry, lpad(cast(c_custkey % 5600 as varchar), 4, '0') as place from customer),
b as (select *, case when staff is null then 'missing' when staff = 0 then '0' when staff < 5 then '1-4' when staff < 20 then '5-19' when staff < 100 then '20-99' else '100+' end as band from r)"""


def _register(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.lpad(k.cast("string"), 9, "0").alias("organisation_number"), F.get(F.array(*map(F.lit, ("AS", "ASA", "ENK", "KF", None))), (k % 5).cast("int")).alias("legal_form"), F.when(k % 4 != 0, (k % 130).cast("int")).alias("employees"), (k % 11 == 0).alias("bankrupt"), (k % 13 == 0).alias("liquidating"),
        F.when(k % 3 == 0, "f.no").otherwise(F.when(k % 3 == 1, "")).alias("website"), F.when(k % 2 == 0, "2025").when(k % 7 != 0, "2024").alias("latest_submitted_accounts"), F.when(k % 6 != 0, F.concat((10 + k % 8).cast("string"), F.lit("."), (k % 100).cast("string"))).alias("industry_code"),
        F.lpad((k % 5600).cast("string"), 4, "0").alias("municipality_number"),
    )


@query("register_strata", f"with {_R_SQL} select (case when form in ('AS', 'ASA', 'ENK') then form else 'OTHER' end) || '|' || band || '|' || (case when bankrupt or liquidating then 'adverse' else 'active' end) || '|' || (case when web then 'web' else 'no-web' end) as stratum, count(*) as n from b group by 1")
def register_strata(spark, sf_dir):
    """AGG4."""
    return _register(spark, sf_dir).groupBy(register.stratum().alias("stratum")).agg(F.count("*").alias("n"))


@query("eligible_filers", f"with {_R_SQL} select coalesce(form, 'missing') || '|' || band || '|' || coalesce(split_part(industry, '.', 1), 'missing') || '|' || place[:2] || '|' || (case when web then 'web' else 'no-web' end) as stratum, count(*) as n from b where filed = '2025' and not bankrupt and not liquidating group by 1")
def eligible_filers(spark, sf_dir):
    """FLT4, AGG4: the year's active filers, by their strata."""
    return _register(spark, sf_dir).filter(register.eligible_filer("2025")).groupBy(register.filer_stratum().alias("stratum")).agg(F.count("*").alias("n"))


@query("screen_resolved_fields", "select lpad(cast(c_custkey as varchar), 9, '0') as organisation_number, cast(c_acctbal as double) as revenue from customer where c_custkey % 2 = 0 and c_custkey % 3 <> 0 and c_acctbal > 100 and c_custkey % 5 <> 0 order by 2 desc, 1 limit 30")
def screen_resolved_fields(spark, sf_dir):
    """FLT2: a screen over profiles whose amounts are the latest record's and whose sites may be another's."""
    k = F.col("c_custkey")
    record = lambda x: F.struct(x.alias("revenue"), x.alias("annual_result"))
    money = F.col("c_acctbal").cast("double")
    rows = table(spark, sf_dir, "customer").select(
        F.lpad(k.cast("string"), 9, "0").alias("organisation_number"), F.lit("OSLO").alias("municipality"), F.lit("AS").alias("legal_form"), F.lit(1).alias("employees"), F.struct(F.when(k % 2 == 0, "available").otherwise("not_found").alias("status"), F.array(record(money), record(money * 100)).alias("records")).alias("financials"),
        F.struct(F.when(k % 3 != 0, "available").otherwise("blocked").alias("status"), F.when(k % 5 == 0, False).alias("publishable")).alias("site"), F.lit("10.1").alias("industry_code"), F.lit(None).cast("string").alias("industry_label"),
    )
    plan = parse("companies in Oslo that have a website and with accounts and revenue over 100 and industry contains '10.1' top 30 by revenue")
    fields = register.screen_fields()
    return screen(rows, plan, fields).select("organisation_number", fields["revenue"].alias("revenue"))


@query(
    "workspaces",
    """with w as (select c_custkey as k, c_custkey % 4 as w, 90 + c_custkey % 20 as n from customer) select k as c_custkey, case when w = 0 then cast(least(100, n + 1) as int) else 1 end as entries, case when w = 0 then 'a,b,new' else 'new' end as pins,
  case w when 1 then 'Workspace recovery reset invalid state: JSONDecodeError' when 2 then 'Workspace recovery reset invalid state: ValueError' end as warning, case when w = 0 and n >= 100 then '{"q":' || (n - 99) || '}' when w = 0 then '{"q":0}' else '{"q":"last"}' end as first from w""",
)
def workspaces(spark, sf_dir):
    """SNK6, WIN9: saved workspaces read, broken ones started anew, and one more screen noted in each."""
    k = F.col("c_custkey")
    history = F.transform(F.sequence(F.lit(0), (89 + k % 20).cast("int")), lambda i: F.concat(F.lit('{"q":'), i.cast("string"), F.lit("}")))
    whole = lambda version: F.concat(F.lit(f'{{"schema_version":{version},"pins":["b","a"],"history":['), F.array_join(history, ","), F.lit("]}"))
    body = F.when(k % 4 == 0, whole(1)).when(k % 4 == 1, "not json").when(k % 4 == 2, whole(2))
    w = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", register.workspace(body).alias("w"))
    w = w.select("c_custkey", register.recorded(F.col("w"), F.lit('{"q":"last"}'), F.array(F.lit("new"), F.lit("new"))).alias("w"))
    return w.select("c_custkey", F.size("w.history").alias("entries"), F.array_join("w.pins", ",").alias("pins"), "w.warning", F.get("w.history", F.lit(0)).alias("first"))
