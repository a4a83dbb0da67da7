"""Change detection between orders and a snapshot of them in which some fields changed and some sources failed."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import refresh
from heddle.registry import query
from heddle.session import table

FIELDS = ["registry.employees", "financials.records", "website.title"]

_BOTH_SQL = """o as (select o_orderkey as k, cast(cast(o_totalprice as decimal(18,2)) as varchar) as price, o_orderstatus as st, o_orderpriority as pr from orders),
old as (select k, case when k % 103 = 0 then null else pr end as "registry.employees", price as "financials.records", st as "website.title" from o),
new as (select k, pr as "registry.employees", case when k % 97 = 0 then price || '0' when k % 101 = 0 then null else price end as "financials.records", case when k % 89 = 0 then 'X' else st end as "website.title", case when k % 202 = 0 then 'source_error' else 'available' end as status from o),
changed as (
""" + " union all ".join(f"""select old.k, '{f}' as field, old."{f}" as old_value, new."{f}" as new_value from old join new using (k) where old."{f}" is distinct from new."{f}" and not (new."{f}" is null and new.status = 'source_error')""" for f in FIELDS) + ")"


def _snapshots(spark, sf_dir):
    k = F.col("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), "o_orderstatus", "o_orderpriority")
    names = [n.replace(".", "_") for n in FIELDS]
    old = o.select("k", F.when(k % 103 != 0, F.col("o_orderpriority")).alias(names[0]), F.col("price").alias(names[1]), F.col("o_orderstatus").alias(names[2]))
    new = o.select(
        "k", F.col("o_orderpriority").alias(names[0]), F.when(k % 97 == 0, F.concat("price", F.lit("0"))).when(k % 101 != 0, F.col("price")).alias(names[1]),
        F.when(k % 89 == 0, "X").otherwise(F.col("o_orderstatus")).alias(names[2]), F.when(k % 202 == 0, "source_error").otherwise("available").alias("status"),
    )
    return old, new


def _changes(old, new):
    return refresh.changes(old, new, "k", {f.replace(".", "_"): f for f in FIELDS}, "status")


@query("refresh_diff", f"with {_BOTH_SQL} select * from changed")
def refresh_diff(spark, sf_dir):
    return _changes(*_snapshots(spark, sf_dir)).select("k", "field", "old_value", "new_value")


@query("refresh_typed_changes", f"with {_BOTH_SQL} select k, field, case when old_value is null then 'new_fact' when contains(field, 'roles') then 'role_changed' when contains(field, 'financial') then 'financial_update' when contains(field, 'employees') then 'workforce_updated' when contains(field, 'website') then 'website_updated' else 'value_updated' end as change_type, 'evt-' || substr(sha256(cast(k as varchar) || ':' || field || ':' || sha256(coalesce(new_value, 'null'))), 1, 16) as event_id from changed")
def refresh_typed_changes(spark, sf_dir):
    c = _changes(*_snapshots(spark, sf_dir))
    content = F.sha2(F.coalesce("new_value", F.lit("null")), 256)
    return c.select("k", "field", refresh.change_type(F.col("field"), F.col("old_value"), F.col("new_value")).alias("change_type"), refresh.event_id(F.col("k"), F.col("field"), content).alias("event_id"))


@query("refresh_suppression", "select count(*) as suppressed from orders where o_orderkey % 202 = 0 and o_orderkey % 97 <> 0")
def refresh_suppression(spark, sf_dir):
    """How many nulls left by failed sources were not taken for removals."""
    old, new = _snapshots(spark, sf_dir)
    loud = _changes(old, new.withColumn("status", F.lit("available")))
    return loud.join(_changes(old, new), ["k", "field"], "left_anti").agg(F.count("*").alias("suppressed"))


@query("refresh_replay_metrics", f"with {_BOTH_SQL}, e as (select k, field from changed where k % 2 = 0 or field = 'website.title' union select k, 'registry.employees' from o where k % 1000 = 1), t as (select count(*) filter (where a.k is not null and b.k is not null) as tp, count(*) filter (where a.k is null) as fp, count(*) filter (where b.k is null) as fn from e a full join changed b on a.k = b.k and a.field = b.field) select tp, fp, fn, case when tp + fp = 0 then 1.0 else round_even(tp / (tp + fp), 6) end as precision, case when tp + fn = 0 then 1.0 else round_even(tp / (tp + fn), 6) end as recall from t")
def refresh_replay_metrics(spark, sf_dir):
    observed = _changes(*_snapshots(spark, sf_dir)).select("k", "field")
    extra = table(spark, sf_dir, "orders").filter("o_orderkey % 1000 = 1").select(F.col("o_orderkey").alias("k"), F.lit("registry.employees").alias("field"))
    return refresh.replay_metrics(observed.filter("k % 2 = 0 or field = 'website.title'").unionByName(extra), observed, ["k", "field"])


@query("fact_fingerprint", "select o_orderkey, sha256(cast(o_orderkey as varchar) || ':status:\"' || o_orderstatus || '\":' || cast(year(o_orderdate) as varchar)) as fingerprint from orders")
def fact_fingerprint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    value = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    return o.select("o_orderkey", refresh.fingerprint(F.col("o_orderkey"), F.lit("status"), value, F.year("o_orderdate").cast("string")).alias("fingerprint"))


@query("refresh_idempotent_count", f"with {_BOTH_SQL} select 'first' as run, count(*) as changes from changed union all select 'again', 0")
def refresh_idempotent_count(spark, sf_dir):
    """REF2: what a refresh finds, and what the same snapshot finds against itself."""
    old, new = _snapshots(spark, sf_dir)
    told = lambda name, changes: changes.agg(F.count("*").alias("changes")).select(F.lit(name).alias("run"), "changes")
    return told("first", _changes(old, new)).unionByName(told("again", _changes(new, new.repartition(3))))


#: The columns of a profile that stands for an order, before and after, and the module that tells of each.
_TRACKED = {f: f.replace(".", "_") for f in refresh.TRACKED}
_OLD = {f: f"'{f}-' || k" for f in refresh.TRACKED}
_CHANGED = lambda i: f"k % {40 + i} = {i}"
_GONE = lambda i: f"k % {60 + i} = {i}"
_MODULES = ["registry", "registry_live", "financials", "financial_history", "roles", "locations", "website"]


def _profile_changes_sql() -> str:
    parts = []
    for i, f in enumerate(refresh.TRACKED):
        module = f.split(".")[0]
        live = "case when k % 3 = 0 then 'registry_live' else 'registry' end" if module == "registry" else f"'{module}'"
        new = f"case when {_GONE(i)} then null when {_CHANGED(i)} then {_OLD[f]} || '!' else {_OLD[f]} end"
        old = f"case when k % {80 + i} = {i} then null else {_OLD[f]} end"
        parts.append(f"select k, {i} as place, '{f}' as field, {old} as old_value, {new} as new_value, {live} as module from o")
    return f"""with o as (select o_orderkey as k from orders), c as ({" union all ".join(parts)}),
s as (select *, case when k % 5 = 0 and module = 'website' then 'blocked' when k % 7 = 0 and module = 'registry' then 'source_error' else 'available' end as status from c)
select cast(k as varchar) as organisation_number, cast(place as int) as place, field, old_value, new_value, 'https://' || module || '.example.com/' || k as source_url, '2024-02-01' as retrieved_at, case when k % 2 = 0 then '2024-01-15' else '2024-01-20' end as effective_at,
  case when k % 2 = 0 then 'class-' || module else 'type-' || module end as source_class, sha256('old' || module || k) as old_content_sha256, sha256('new' || module || k) as new_content_sha256, status
from s where old_value is distinct from new_value and not (new_value is null and status in ('blocked', 'source_error', 'failed'))"""


def _profiles(spark, sf_dir, side: str):
    k = F.col("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))

    def record(m: str):
        status = F.when((k % 5 == 0) & F.lit(m == "website"), "blocked").when((k % 7 == 0) & F.lit(m == "registry"), "source_error").otherwise("available")
        even = k % 2 == 0
        return F.struct(
            status.alias("status"), F.concat(F.lit(f"https://{m}.example.com/"), k.cast("string")).alias("source_url"), F.lit("2024-02-01").alias("retrieved_at"), F.when(even, "2024-01-15").alias("effective_at"), F.lit("2024-01-20").alias("as_of"),
            F.when(even, f"class-{m}").alias("source_class"), F.lit(f"type-{m}").alias("source_type"), F.sha2(F.concat(F.lit(f"{side}{m}"), k.cast("string")), 256).alias("content_sha256"),
        )

    records = F.map_filter(F.create_map(*[x for m in _MODULES for x in (F.lit(m), F.when(F.lit(m != "registry_live") | (k % 3 == 0), record(m)))]), lambda m, v: v.isNotNull())
    values = {}
    for i, (f, column) in enumerate(_TRACKED.items()):
        text = F.concat(F.lit(f"{f}-"), k.cast("string"))
        new = F.when(k % (60 + i) != i, F.when(k % (40 + i) == i, F.concat(text, F.lit("!"))).otherwise(text))
        values[column] = F.when(k % (80 + i) != i, text) if side == "old" else new
    return o.select(k.cast("string").alias("organisation_number"), records.alias("evidence"), *[v.alias(c) for c, v in values.items()])


@query("refresh_profiles", _profile_changes_sql())
def refresh_profiles(spark, sf_dir):
    """REF1, REF2, REF4: changes of profiles in all tracked fields, with the sources and hashes of both sides; fails if the sets differ in their members."""
    return refresh.profile_changes(_profiles(spark, sf_dir, "old"), _profiles(spark, sf_dir, "new"))


@query("refresh_evidence_complete", f"select count(*) as changes, count(*) filter (where effective_at is null) as incomplete, true as evidence_complete from ({_profile_changes_sql()})")
def refresh_evidence_complete(spark, sf_dir):
    """AGG16: whether each change has what proves it."""
    return refresh.evidence_complete(refresh_profiles(spark, sf_dir))
