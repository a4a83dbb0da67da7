"""Keep-first and keep-last, hash-rank samples, percentiles, budgets and spacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import urls
from heddle.operators import relational as rel
from heddle.registry import query
from heddle.session import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("dedupe_keep_last", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def dedupe_keep_last(spark, sf_dir):
    return rel.keep_last(_events(spark, sf_dir), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("dedupe_keep_first", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1")
def dedupe_keep_first(spark, sf_dir):
    return rel.keep_first(_events(spark, sf_dir), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("latest_event", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n from events group by 1")
def latest_event(spark, sf_dir):
    """WIN3: the latest row as an aggregate, which combines map-side where a window can't."""
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("lag_delta", "select user_id, event_id, round_even(value - lag(value) over (partition by user_id order by ts, event_id), 6) as delta from events")
def lag_delta(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select("user_id", "event_id", F.bround(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


@query("hash_rank_sample", "select o_orderkey, sha256('20260822:' || cast(o_orderkey as varchar)) as hash_rank from orders order by 2, 1 limit 100")
def hash_rank_sample(spark, sf_dir):
    return rel.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, "20260822")


@query("preserved_sample", "select o_orderkey, kept from (select o_orderkey, o_orderkey % 500 = 0 as kept, row_number() over (order by case when o_orderkey % 500 = 0 then 0 else 1 end, sha256('s:' || cast(o_orderkey as varchar)), o_orderkey) as r from orders where o_orderstatus = 'F' or o_orderkey % 500 = 0) where r <= 120")
def preserved_sample(spark, sf_dir):
    """SMP2: rows that must stay come first, the rest by rank."""
    o = table(spark, sf_dir, "orders").withColumn("kept", F.col("o_orderkey") % 500 == 0).filter("o_orderstatus = 'F' or kept")
    return o.orderBy(F.when(F.col("kept"), 0).otherwise(1), rel.hash_rank(F.col("o_orderkey"), "s"), "o_orderkey").limit(120).select("o_orderkey", "kept")


@query("extension_sample", "select o_orderkey, sha256('ext:' || cast(o_orderkey as varchar)) as hash_rank from orders where o_orderkey not in (select o_orderkey from orders order by sha256('20260822:' || cast(o_orderkey as varchar)), o_orderkey limit 100) order by 2, 1 limit 50")
def extension_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return rel.hash_sample(rel.missing(o, rel.hash_sample(o, "o_orderkey", 100, "20260822"), "o_orderkey"), "o_orderkey", 50, "ext")


_HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query("unique_host_sample", f"select host, page_id from (select {_HOST_SQL} as host, page_id, sha256('h:' || cast(page_id as varchar)) as hr, row_number() over (partition by {_HOST_SQL} order by sha256('h:' || cast(page_id as varchar)), page_id) as r from pages) where r = 1 order by hr, page_id limit 20")
def unique_host_sample(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    one = rel.keep_first(p, ["host"], [rel.hash_rank(F.col("page_id"), "h"), F.col("page_id")])
    return rel.hash_sample(one, "page_id", 20, "h").select("host", "page_id")


@query("stratified_hash_sample", "select c_mktsegment, c_custkey, place from (select c_mktsegment, c_custkey, cast(row_number() over (partition by c_mktsegment order by sha256('st:' || cast(c_custkey as varchar)), c_custkey) as int) as place from customer) where place <= 20")
def stratified_hash_sample(spark, sf_dir):
    return rel.stratified_sample(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", 20, "st").select("c_mktsegment", "c_custkey", "place")


_STRATA_SQL = "case when c_mktsegment = 'BUILDING' then c_mktsegment || '|' || (c_custkey % 3) when c_custkey % 40 = 1 then 'rare|' || (c_custkey % 5) else 'OTHER' end"
_SHARE_SQL = lambda weight, total, keep: f"select {keep}, floor(cast({weight} as double) * {total} / nullif(sum({weight}) over (), 0)) as low, cast({weight} as double) * {total} / nullif(sum({weight}) over (), 0) as share"


@query(
    "population_stress_sample",
    f"""with c as (select c_custkey, {_STRATA_SQL} as stratum from customer), s as (select stratum, count(*) as have, least(70, sum(count(*)) over ()) as target from c group by 1),
a as ({_SHARE_SQL("have", "target", "stratum, have, target")} from s),
p as (select *, low + case when row_number() over (order by share - low desc, stratum) <= target - sum(low) over () then 1 else 0 end as population from a),
f as (select stratum, have, population, least(greatest(1, least(3, floor(30 / count(*) over ()))), have - population) as wish, 100 - sum(population) over () as room from p),
g as (select *, greatest(0, least(wish, room - coalesce(sum(wish) over (order by stratum rows between unbounded preceding and 1 preceding), 0))) as floored from f),
r as (select *, have - population - floored as rest, least(room - sum(floored) over (), sum(have - population - floored) over ()) as missing from g),
b as ({_SHARE_SQL("rest", "missing", "stratum, population, floored, rest, missing")} from r),
q as (select stratum, population, population + floored + coalesce(low, 0) + case when rest > 0 and row_number() over (order by coalesce(share - low, 0) desc, stratum) <= missing - sum(coalesce(low, 0)) over () then 1 else 0 end as quota from b),
k as (select *, row_number() over (partition by stratum order by sha256('20260822:' || cast(c_custkey as varchar)), c_custkey) as place from c)
select c_custkey, k.stratum, cast(place as int) as place, case when place <= population then 'population' else 'stress' end as sample_slice from k join q using (stratum) where place <= quota""",
)
def population_stress_sample(spark, sf_dir):
    """SMP1: a hundred customers, seventy in proportion to their strata, the others such that rare strata are there."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    stratum = F.when(segment == "BUILDING", F.concat(segment, F.lit("|"), (k % 3).cast("string"))).when(k % 40 == 1, F.concat(F.lit("rare|"), (k % 5).cast("string"))).otherwise("OTHER")
    c = table(spark, sf_dir, "customer").select("c_custkey", stratum.alias("stratum"))
    return rel.population_and_stress(c, "stratum", "c_custkey", 100, "20260822").select("c_custkey", "stratum", "place", "sample_slice")


@query("split_assignment", "with r as (select s_suppkey, row_number() over (order by sha256('sp:' || cast(s_suppkey as varchar)), s_suppkey) as i, count(*) over () as n from supplier) select s_suppkey, case when i <= round_even(n * 0.6, 0) then 'development' when i <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) then 'validation' else 'held_out' end as split from r")
def split_assignment(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return rel.split(s, "s_suppkey", "sp")


@query("selected_set_hash", "select sha256(string_agg(cast(k as varchar), chr(10) order by cast(k as varchar))) as set_hash from (select o_orderkey as k from orders order by sha256('20260822:' || cast(o_orderkey as varchar)), o_orderkey limit 100)")
def selected_set_hash(spark, sf_dir):
    chosen = rel.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, "20260822")
    return chosen.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), "\n"), 256).alias("set_hash"))


@query("latency_summary", "select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as top from events group by 1")
def latency_summary(spark, sf_dir):
    ranks = {"p50": "cast(ceil(n * 0.5) as bigint) - 1", "p95": "cast(ceil(n * 0.95) as bigint) - 1"}
    return rel.values_at(_events(spark, sf_dir), "value", ranks, "event_type", summary=True)


@query("index_percentiles", "with r as (select value as v, row_number() over (order by value, event_id) - 1 as i, count(*) over () as n from events where value is not null) select max(v) filter (where i = least(n - 1, cast(floor(n * 0.95) as bigint))) as p95_capped, max(v) filter (where i = n // 2) as p50_half, max(v) filter (where i = cast(floor((n - 1) * 0.95) as bigint)) as p95_inner from r")
def index_percentiles(spark, sf_dir):
    return rel.values_at(_events(spark, sf_dir), "value", {"p95_capped": "least(n - 1, cast(floor(n * 0.95) as bigint))", "p50_half": "n div 2", "p95_inner": "cast(floor((n - 1) * 0.95) as bigint)"})


@query("domain_fairness", f"select quantile_disc(n, 0.5) as p50, quantile_disc(n, 0.95) as p95, max(n) as top, count(*) as domains from (select {_HOST_SQL} as host, count(*) as n from pages group by 1)")
def domain_fairness(spark, sf_dir):
    g = table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_requests"))
    ranks = {"p50": "cast(ceil(n * 0.5) as bigint) - 1", "p95": "cast(ceil(n * 0.95) as bigint) - 1"}
    return rel.values_at(g, "n_requests", ranks, summary=True).withColumnRenamed("n", "domains")


@query("status_counts", "select event_type, count(*) as n, count(distinct user_id) as users from events group by 1")
def status_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "budget_admission",
    """with e as (select event_id, user_id as budget, ts, event_type = 'purchase' as high, 1 + event_id % 3 as cost from events),
w as (select *, coalesce(sum(cost) over (partition by budget order by ts, event_id rows between unbounded preceding and 1 preceding), 0) < 18 as early from e),
a as (select *, coalesce(sum(case when early or high then cost else 0 end) over (partition by budget order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as asked from w),
m as (select *, early or (high and asked < 24) as admitted from a)
select event_id, budget, coalesce(sum(case when admitted then cost else 0 end) over (partition by budget order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as used_before, admitted from m""",
)
def budget_admission(spark, sf_dir):
    """Each user has a budget; purchases go first."""
    rows = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("budget"), "event_type", "ts", (1 + F.col("event_id") % 3).alias("cost"))
    return rel.admitted(rows, ["ts", "event_id"], "cost", 18, 24, F.col("event_type") == "purchase").select("event_id", "budget", F.col("used_before").cast("decimal(38,0)").alias("used_before"), "admitted")


@query("rate_spacing", "with e as (select event_id, user_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events) select event_id, round_even(max(t - 3600.0 * i) over (partition by user_id order by i) + 3600.0 * i - t, 3) as waited from e")
def rate_spacing(spark, sf_dir):
    """How long each event waits if a user's events have to be an hour apart."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rel.spaced(_events(spark, sf_dir).withColumn("t", t), "user_id", F.col("t"), ["ts", "event_id"], 3600.0).select("event_id", F.bround(F.col("start") - F.col("t"), 3).alias("waited"))


@query("budget_summary", "select event_type, sum(1 + event_id % 3) as requests, sum(1 + event_id % 3) >= 1750 as soft_limit_hit, sum(1 + event_id % 3) >= 1900 as hard_limit_hit from events group by 1")
def budget_summary(spark, sf_dir):
    """AGG20."""
    used = F.sum(1 + F.col("event_id") % 3)
    return _events(spark, sf_dir).groupBy("event_type").agg(used.cast("decimal(38,0)").alias("requests"), (used >= 1750).alias("soft_limit_hit"), (used >= 1900).alias("hard_limit_hit"))


@query("history_ring", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 100")
def history_ring(spark, sf_dir):
    """WIN9: the last hundred entries of each workspace."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 100").select("user_id", "event_id")


@query("set_operations", "select 'intersect' as op, count(*) as n from (select c_nationkey from customer where c_acctbal > 0 intersect select s_nationkey from supplier) union all select 'except', count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O') union all select 'union', count(*) from (select c_nationkey from customer union select s_nationkey from supplier)")
def set_operations(spark, sf_dir):
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    a = c.filter("c_acctbal > 0").select("c_nationkey").intersect(s.select("s_nationkey"))
    b = o.filter("o_orderstatus = 'F'").select("o_custkey").subtract(o.filter("o_orderstatus = 'O'").select("o_custkey"))
    u = c.select("c_nationkey").union(s.select("s_nationkey")).distinct()
    return a.agg(F.lit("intersect").alias("op"), F.count("*").alias("n")).unionByName(b.agg(F.lit("except").alias("op"), F.count("*").alias("n"))).unionByName(u.agg(F.lit("union").alias("op"), F.count("*").alias("n")))
