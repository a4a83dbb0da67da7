"""Numbers, accounts, roles, addresses, workforce and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import numbers
from heddle.operators import extract
from heddle.registry import query
from heddle.session import table

def _sql(x):
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else f"cast({x} as double)" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _rows(*rows) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


@query("financial_normalise", "select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as double) * 1000 as revenue, case when o_orderstatus = 'P' then null else -cast(cast(o_totalprice as decimal(18,2)) as double) * 1000 end as result from orders")
def financial_normalise(spark, sf_dir):
    """PRJ4: amounts in thousands, written with a decimal comma, losses in brackets."""
    money = F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",")
    o = table(spark, sf_dir, "orders").select("o_orderkey", money.alias("raw"), F.when(F.col("o_orderstatus") == "P", "-").otherwise(F.concat(F.lit("("), money, F.lit(")"))).alias("raw_result"))
    scale = numbers.scale_factor(F.lit("i hele tusen"))
    return o.select("o_orderkey", numbers.norwegian_number(F.col("raw"), scale).alias("revenue"), numbers.norwegian_number(F.col("raw_result"), scale).alias("result"))


@query("address_format", "select s_suppkey, 'Vei ' || cast(s_suppkey as varchar) || (case when s_suppkey % 2 = 0 then ', 0' || cast(100 + s_suppkey % 800 as varchar) || ' ' || n_name else '' end) as address from supplier join nation on n_nationkey = s_nationkey")
def address_format(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k, even = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.select("s_suppkey", extract.address(F.concat(F.lit("Vei "), k.cast("string")), F.when(even, F.concat(F.lit("0"), (100 + k % 800).cast("string"))), F.when(even, F.col("n_name"))).alias("address"))


@query("locations_union", "select k, place, count(*) as n from (select c_custkey as k, 'registered' as kind, n_name as place from customer join nation on n_nationkey = c_nationkey union all select o_custkey, 'subunit', o_orderpriority from orders) group by 1, 2")
def locations_union(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    a = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("k"), F.col("n_name").alias("place"))
    return a.unionByName(o.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("place"))).groupBy("k", "place").agg(F.count("*").alias("n"))


@query("review_labels", "select event_id, case when rating <= 2 then 'negative' when rating >= 4 then 'positive' else 'neutral' end as label from (select event_id, (event_id % 9) / 2.0 + 1 as rating from events)")
def review_labels(spark, sf_dir):
    rating = (F.col("event_id") % 9) / 2.0 + 1
    return table(spark, sf_dir, "events").select("event_id", extract.review_label(rating).alias("label"))


@query("years_history", "select user_id, array_to_string(list_sort(list_distinct(list(cast(day(ts) as varchar)))), ',') as days from events group by 1")
def years_history(spark, sf_dir):
    """PRJ5: the different periods of an entity, sorted."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.dayofmonth("ts").cast("string"))), ",").alias("days"))


@query("event_property_sums", "select event_type, cast(json_extract_string(props, '$.k') as bigint) % 10 as bucket, count(*) as n from events group by 1, 2")
def event_property_sums(spark, sf_dir):
    """SCA37: a nested path of a JSON column; null where it is missing."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))
