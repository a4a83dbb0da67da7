"""Streaming queries, compared by their final state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.registry import query
from heddle.session import shared_folder, table
from heddle.streaming import crawl, events

#: The state store that keeps state on disk, which timers and maps need.
ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_dedupe", "select user_id, event_type, count(*) as n from (select distinct user_id, event_type, date_trunc('day', ts) as d from events) group by 1, 2")
def stream_dedupe(spark, sf_dir):
    """One event of each user, type and day."""
    rows = events.stream(spark, sf_dir).withColumn("d", F.date_trunc("day", "ts"))
    got = events.run_to_table(events.deduplicated(rows, ["user_id", "event_type", "d"], "60 days").select("user_id", "event_type"), _folder(spark))
    return got.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_upsert", "select user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def stream_upsert(spark, sf_dir):
    rows = events.stream(spark, sf_dir).select("user_id", "event_id", F.struct("ts", "event_id").alias("version"))
    return events.upsert_batches(rows, "user_id", "version", _folder(spark)).select("user_id", "event_id")


@query("stream_window_counts", "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n, sum(cast(value as decimal(18,2))) as total from events group by 1, 2")
def stream_window_counts(spark, sf_dir):
    """Extension: daily counts; in complete mode, so that the last day is there too."""
    got = events.run_to_table(events.window_counts(events.stream(spark, sf_dir)), _folder(spark), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("decimal(38,2)").alias("total"))


#: A crawl of all customers' sites that starts and ends for all at once.
START, DEADLINE, MOST_PAGES = "2024-01-01 00:00:00", "2024-01-11 00:00:00", 16


def pages(rows):
    """Events as pages of a crawl: 20 addresses a company, homepages that announce up to 19 others."""
    e = F.col("event_id")
    return rows.select(
        F.col("user_id").cast("string").alias("organisation_number"), F.when(F.col("event_type") == "view", "homepage").otherwise("priority").alias("page_kind"),
        F.concat("event_type", F.lit("/"), (e % 4).cast("string")).alias("final_url"), F.when(F.col("event_type") == "error", "source_error").otherwise("available").alias("status"),
        (e % 20).cast("int").alias("links"), F.col("ts").cast("timestamp").alias("ts"),
    )


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("organisation_number"), F.lit(START).cast("timestamp").alias("started_at"), F.lit(DEADLINE).cast("timestamp").alias("deadline"))


_TERMINAL_SQL = f"""with e as (select cast(user_id as varchar) as org, case when event_type = 'view' then 'homepage' else 'priority' end as kind, event_type || '/' || cast(event_id % 4 as varchar) as url,
  case when event_type = 'error' then 'source_error' else 'available' end as status, cast(event_id % 20 as int) as links, ts from events where ts between timestamp '{START}' and timestamp '{DEADLINE}'),
f as (select org, url, min(ts) as ts, arg_min(kind, (ts, kind, status, links)) as kind, arg_min(status, (ts, kind, status, links)) as status, arg_min(links, (ts, kind, status, links)) as links from e group by 1, 2),
n as (select *, row_number() over (partition by org order by ts, kind, status, links, url) as n, count(*) over (partition by org) as have from f),
h as (select org, min(n) as hn, arg_min(links, n) as links, arg_min(status, n) as status from n where kind = 'homepage' group by 1),
d as (select n.*, h.hn, h.status as home, coalesce(greatest(h.hn, least(1 + h.links, {MOST_PAGES})), {MOST_PAGES}) as need from n left join h using (org)),
t as (select org, any_value(have) as have, any_value(need) as need, any_value(hn) as hn, any_value(home) as home, count(*) filter (where n <= need) as pages, count(*) filter (where n <= need and status <> 'available') as errors, max(ts) filter (where n <= need) as last_page_at from d group by 1)
select cast(c_custkey as varchar) as organisation_number, case when t.org is null then 'synthetic' when have >= need then 'complete' else 'timeout' end as outcome,
  coalesce(case when hn <= pages then home end, 'source_error') as status, cast(coalesce(pages, 0) as int) as pages, cast(coalesce(errors, 0) as int) as errors, last_page_at,
  case when t.org is null then '{crawl.NO_PAGE}' end as error from customer left join t on t.org = cast(c_custkey as varchar)"""


@query("crawl_terminal_events", _TERMINAL_SQL)
def crawl_terminal_events(spark, sf_dir):
    got = crawl.terminal_events(pages(table(spark, sf_dir, "events")), seeds(spark, sf_dir), most_pages=MOST_PAGES)
    return got.withColumn("last_page_at", F.col("last_page_at").cast("timestamp_ntz"))


@query("stream_terminal_events", _TERMINAL_SQL)
def stream_terminal_events(spark, sf_dir):
    """STR4: as ``crawl_terminal_events``, from a stream with state and timers for each company."""
    ended = crawl.terminal_stream(pages(events.stream(spark, sf_dir)), seeds(spark, sf_dir), most_pages=MOST_PAGES)
    return events.run_to_table(ended, _folder(spark), **ON_DISK).withColumn("last_page_at", F.col("last_page_at").cast("timestamp_ntz"))


@query("stream_counters", "select event_type as page, status, count(*) as n from (select event_type, case when event_type = 'error' then 'source_error' else 'available' end as status from events) group by all")
def stream_counters(spark, sf_dir):
    """STR6: running counts by page kind and status."""
    rows = pages(events.stream(spark, sf_dir)).select(F.regexp_extract("final_url", "^[^/]*", 0).alias("page"), "status")
    return events.run_to_table(crawl.counters(rows, "page", "status"), _folder(spark), "complete")
