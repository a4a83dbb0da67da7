"""Resumable runs, envelope packages and written tables, over customers and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.operators import package, written
from heddle.plans.base import COMPANIES_SQL, companies
from heddle.registry import query
from heddle.session import shared_folder, table
from heddle.sources import resumable

#: Rows of a batch: an eighth of the customers, at least 40.
ROWS_SQL = "greatest(40, (select count(*) from customer) // 8)"


def _rows(n: int) -> int:
    return max(40, n // 8)


MODULES = ["registry", "website", "accounting_obligation"]


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("resume_after_stop", f"with m as (select c_custkey, (row_number() over (order by c_custkey) - 1) // {ROWS_SQL} as batch from customer) select c_custkey, cast(batch as bigint) as batch, (select count(*) from orders where o_custkey = c_custkey) as orders from m")
def resume_after_stop(spark, sf_dir):
    """STR5, SNK2: a run that is stopped after two batches, and goes on."""
    manifest, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey")
    work = lambda batch, number: batch.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_custkey").alias("orders"))
    folder, options = _folder(spark, "resume"), {"key": "c_custkey", "position": "c_custkey", "rows": _rows(manifest.count()), "parameters": {"counted": "orders"}}
    resumable.run(manifest, work, folder, **options, most_batches=2)
    resumable.run(manifest, work, folder, **options, most_batches=None)
    return resumable.committed(spark, folder, "c_custkey long, orders long").select("c_custkey", "batch", "orders")


def _profiles(spark, sf_dir):
    """Companies with evidence: the register always, a site for three of four, of obligations one that some forms don't have."""
    c, k = companies(spark, sf_dir), F.col("custkey")
    web = F.when(k % 3 == 0, "available").when(k % 3 == 1, "source_error").otherwise("blocked")
    registry = package.evidence("registry", F.lit("available"), "official_registry_bulk", F.lit("https://reg.example.com/"), F.lit("2024-01-01T00:00:00Z"), source_row_key=F.col("organisation_number"))
    site = package.evidence("website", web, "company_website", F.lower("name"), F.lit("2024-01-02T00:00:00Z"), note=F.when(k % 2 == 0, "robots.txt disallows").otherwise("policy"), retry_count=(k % 4))
    duty = package.evidence("accounting_obligation", F.lit("not_applicable"), "rules", F.lit(""), F.lit(None))
    records = F.map_filter(F.create_map(F.lit("registry"), registry, F.lit("website"), F.when(k % 4 != 0, site), F.lit("accounting_obligation"), duty), lambda m, v: v.isNotNull())
    return c.select("custkey", "organisation_number", records.alias("evidence"))


_STATES_SQL = f"""with {COMPANIES_SQL}, p as (select custkey, organisation_number, (row_number() over (order by custkey) - 1) // {ROWS_SQL} as batch from companies),
s as (select *, 'registry' as module, 'complete' as module_state, 0 as retry_count, '2024-01-01T00:00:00Z' as final_timestamp from p
  union all select *, 'accounting_obligation', 'not_applicable', 0, '2024-02-01T00:00:00Z' from p
  union all select *, 'website', case when custkey % 4 = 0 then 'submission_error' when custkey % 3 = 0 then 'complete' when custkey % 3 = 1 then 'source_error' when custkey % 2 = 0 then 'blocked_robots' else 'blocked_policy' end,
    case when custkey % 4 = 0 then 0 else custkey % 4 end, case when custkey % 4 = 0 then '2024-02-01T00:00:00Z' else '2024-01-02T00:00:00Z' end from p)"""
_RUN = {"run_id": "r1", "started_at": "2024-01-31T00:00:00Z", "completed_at": "2024-02-01T00:00:00Z"}


@query("envelope_package", f"{_STATES_SQL} select organisation_number, cast(batch as bigint) as batch, case when custkey % 4 = 0 then 'submission_error' else 'complete' end as state, module, module_state, cast(retry_count as int) as retry_count, final_timestamp from s")
def envelope_package(spark, sf_dir):
    """SNK4, PRJ10: envelopes written in batches, each committed once its counts, keys and states were found right while it was written."""
    profiles = _profiles(spark, sf_dir)
    manifest = profiles.select("organisation_number", "custkey")
    n = manifest.count()
    size = _rows(n)
    expected = lambda b: min(size, n - size * b)
    built = lambda batch: package.envelopes(profiles.join(batch, "organisation_number", "left_semi"), MODULES, **_RUN)
    check = package.checked(built(manifest), expected)[1]
    folder = _folder(spark, "package")
    resumable.run(manifest, lambda b, number: package.checked(built(b), expected)[0], folder, key="organisation_number", position="custkey", rows=size, parameters=_RUN, check=check)
    found = resumable.committed(spark, folder, package.checked(built(manifest), expected)[0].schema)
    each = found.select("organisation_number", "batch", "state", F.explode("modules").alias("module", "x"))
    return each.select("organisation_number", "batch", "state", "module", F.col("x.state").alias("module_state"), "x.retry_count", "x.final_timestamp")


@query("envelope_validation", "select false as passed, count(*) filter (where c_custkey % 10 = 0) = 0 as exact_expected_count, count(*) filter (where c_custkey % 10 = 0) = 0 as unique_organisation_numbers, true as all_entity_states_terminal, count(*) filter (where c_custkey % 5 = 0) = 0 as all_module_states_terminal, count(*) filter (where c_custkey % 10 = 0) = 0 as zero_silent_drops, cast(count(*) filter (where c_custkey % 5 = 0) + count(*) filter (where c_custkey % 10 = 0) as bigint) as invalid_states from customer")
def envelope_validation(spark, sf_dir):
    """FLT15: envelopes of which every tenth is there twice and every fifth has a module that is still running."""
    profiles = _profiles(spark, sf_dir)
    rows = package.envelopes(profiles, MODULES, **_RUN)
    key = F.col("organisation_number").cast("long")
    running = F.map_concat(F.map_filter("modules", lambda m, v: m != "registry"), F.create_map(F.lit("registry"), F.col("modules")["registry"].withField("state", F.lit("running"))))
    rows = rows.withColumn("modules", F.when(key % 5 == 0, running).otherwise(F.col("modules")))
    return package.validated(rows.unionByName(rows.filter(key % 10 == 0)), profiles.count())


@query("envelope_resume_modules", "select c_custkey as custkey, true as registry, c_custkey % 4 <> 0 as website, false as roles from customer")
def envelope_resume_modules(spark, sf_dir):
    """FLT10: which modules a resumed run need not fetch again."""
    has = lambda m: package.module_complete(F.col("evidence"), [m]).alias(m)
    return _profiles(spark, sf_dir).select("custkey", has("registry"), has("website"), has("roles"))


def _written(spark, sf_dir):
    """Two written tables of orders: one in order, and one in which some keys are missing, repeated, moved behind, or new."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    odd = o.filter(k % 1009 != 3).select("o_orderkey", F.when(k % 997 == 5, k + 40.5).otherwise(k.cast("double")).alias("at"))
    twice = o.filter(k % 1013 == 7).select("o_orderkey", (k + 2000.25).alias("at"))
    new = o.filter(k % 1019 == 9).select((-k).alias("o_orderkey"), (k + 0.75).alias("at"))
    folder, out = _folder(spark, "orders"), []
    for name, rows, order in (("expected", o.withColumn("at", k.cast("double")), "at"), ("found", odd.unionByName(twice).unionByName(new), "at")):
        rows.orderBy(order).select("o_orderkey").write.parquet(f"{folder}/{name}")
        out.append(written.placed(spark, f"{folder}/{name}", "o_orderkey"))
    return out


_WRITTEN_SQL = """e as (select o_orderkey as k, row_number() over (order by o_orderkey) - 1 as place from orders),
f as (select k, row_number() over (order by spot) - 1 as place from (select o_orderkey as k, case when o_orderkey % 997 = 5 then o_orderkey + 40.5 else o_orderkey end as spot from orders where o_orderkey % 1009 <> 3
  union all select o_orderkey, o_orderkey + 2000.25 from orders where o_orderkey % 1013 = 7 union all select -o_orderkey, o_orderkey + 0.75 from orders where o_orderkey % 1019 = 9))"""


@query(
    "written_order_faults",
    f"""with {_WRITTEN_SQL}, x as (select k, min(place) as p, count(*) as n from e group by 1), y as (select k, min(place) as p, count(*) as n from f group by 1),
s as (select x.k, row_number() over (order by x.p) as a, row_number() over (order by y.p) as b from x join y using (k) where x.n = 1 and y.n = 1)
select coalesce(x.k, y.k) as o_orderkey, case when y.k is null then 'missing' when x.k is null then 'unexpected' when y.n > 1 then 'repeated' else 'moved' end as fault, x.p as expected_place, y.p as found_place
from x full join y on x.k = y.k left join s on s.k = x.k where y.k is null or x.k is null or y.n > 1 or s.a <> s.b""",
)
def written_order_faults(spark, sf_dir):
    """FLT14: missing, unexpected, repeated and moved keys of a written table told apart."""
    return written.order_faults(*_written(spark, sf_dir), "o_orderkey")


@query("written_first_mismatch", f"with {_WRITTEN_SQL}, j as (select coalesce(e.place, f.place) as place, e.k as expected, f.k as found from e full join f on e.place = f.place where e.k is distinct from f.k) select (place // 500) * 500 as range_start, min(place) as place, first(expected order by place) as expected, first(found order by place) as found from j group by 1")
def written_first_mismatch(spark, sf_dir):
    """FLT14: of each range of places the first at which two written tables differ."""
    return written.first_mismatches(*_written(spark, sf_dir), "o_orderkey", width=500)


@query("not_finite_paths", "select p_partkey, array_to_string(list_filter([case when p_partkey % 50 = 0 then 'ratio' end, case when p_partkey % 30 = 0 then 'sizes[0].v' end, case when p_partkey % 70 = 0 then 'named.price' end], lambda x: x is not null), ',') as bad from part")
def not_finite_paths(spark, sf_dir):
    """SCA42: NaN and infinities below structs, arrays and maps."""
    k, nan, inf = F.col("p_partkey"), F.lit(float("nan")), F.lit(float("-inf"))
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 50 == 0, nan).otherwise(1.0).alias("ratio"), F.array(F.struct(F.when(k % 30 == 0, inf).otherwise(F.col("p_size") * 1.0).alias("v")), F.struct(F.lit(1.0).alias("v"))).alias("sizes"),
        F.create_map(F.lit("price"), F.when(k % 70 == 0, nan).otherwise(F.col("p_retailprice").cast("double"))).alias("named"),
    )
    return p.select("p_partkey", F.array_join(written.not_finite_paths(p.schema), ",").alias("bad"))


@query("package_contract", "select fault, count(*) as n from (select unnest(list_filter([case when o_orderkey % 7 = 0 then 'missing converted to zero' end, case when o_orderkey % 11 = 0 then 'available claim without evidence' end, case when o_orderkey % 13 = 0 then 'unknown evidence' end, case when o_orderkey % 17 = 0 then 'evidence without mandatory fields' end], lambda x: x is not null)) as fault from orders) group by 1")
def package_contract(spark, sf_dir):
    """FLT14's rules on claims and evidence, with planted faults."""
    k = F.col("o_orderkey")
    claim = lambda a, v, e: F.struct(F.lit(a).alias("availability"), v.cast("string").alias("value"), e.alias("evidence_ids"))
    none = F.array().cast("array<string>")
    claims = F.array(
        claim("available", F.col("o_totalprice"), F.array(F.lit("e1"))), claim("not_available", F.when(k % 7 == 0, F.lit(0.0)), none),
        claim("available", F.lit(0), F.when(k % 11 == 0, none).otherwise(F.array(F.when(k % 13 == 0, "e9").otherwise("e1")))),
    )
    proof = F.array(F.struct(F.lit("e1").alias("id"), F.lit("u").alias("source_url"), F.when(k % 17 != 0, "t").alias("retrieved_at"), F.lit("h").alias("content_sha256")))
    # A claim without evidence can't cite unknown evidence: of keys divisible by 11 and 13 the first rule counts, so the second is planted in another claim.
    claims = F.when((k % 11 == 0) & (k % 13 == 0), F.concat(claims, F.array(claim("available", F.lit("x"), F.array(F.lit("e9")))))).otherwise(claims)
    e = table(spark, sf_dir, "orders").select(claims.alias("claims"), proof.alias("evidence"))
    faults = F.array_compact(F.array(*[F.when(v, F.lit(name)) for name, v in written.contract_faults().items()]))
    return e.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))
