"""Parsers over captured feeds, pages and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions import captures, numbers, udfs
from heddle.registry import query
from heddle.session import table

@query("channel_groups", "select user_id, event_type as channel, n, mean_views, cast(row_number() over (partition by user_id order by n desc, event_type) as int) as place from (select user_id, event_type, count(*) as n, round_even(avg(event_id), 3) as mean_views from events group by 1, 2)")
def channel_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "channel")
    return captures.channels(e, "user_id", "channel", "event_id")


@query("not_finite", "select p_partkey, case when p_partkey % 50 = 0 then 'ratio' else '' end as bad from part")
def not_finite(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.when(F.col("p_partkey") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") * 1.0).alias("ratio"))
    return p.select("p_partkey", F.array_join(captures.not_finite(p), ",").alias("bad"))


@query("latest_accounts", "select c_custkey, o_orderkey, place from (select o_custkey as c_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as int) as place from orders) where place <= 3")
def latest_accounts(spark, sf_dir):
    """PRJ3: a company's latest three records, by a rank that is cut before the shuffle too."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return o.withColumn("place", place).filter("place <= 3").drop("o_orderdate")


@query("ascii_fold")
def ascii_fold(spark, sf_dir):
    """T1's general form over all documents, by an Arrow UDF."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(udfs.ascii_folded(F.col("text")), 256).alias("folded_sha256"))
