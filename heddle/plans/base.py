"""Tables and derived views that several queries share, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import table

MONEY = "decimal(18,2)"

#: Companies: a customer with its nation as municipality, its segment as legal form, its orders as employees, their sum as revenue.
COMPANIES_SQL = """
companies as (
  select lpad(cast(c.c_custkey as varchar), 9, '0') as organisation_number, c.c_custkey as custkey, c.c_name as name, n.n_name as municipality,
         c.c_mktsegment as legal_form, coalesce(o.n, 0) as employees, o.revenue, o.last_year,
         cast(c.c_acctbal as decimal(18,2)) as annual_result
  from customer c join nation n on n.n_nationkey = c.c_nationkey
  left join (select o_custkey, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as revenue, max(year(o_orderdate)) as last_year from orders group by 1) o
    on o.o_custkey = c.c_custkey
)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"), F.max(F.year("o_orderdate")).alias("last_year"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(orders, c["c_custkey"] == orders["o_custkey"], "left")
    return joined.select(
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("organisation_number"), F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("n_name").alias("municipality"),
        F.col("c_mktsegment").alias("legal_form"), F.coalesce("n", F.lit(0)).alias("employees"), "revenue", "last_year", F.col("c_acctbal").cast(MONEY).alias("annual_result"),
    )


#: Observations: an event as what was seen of a company on a platform.
OBSERVATIONS_SQL = """
observations as (
  select cast(event_id as varchar) as id, cast(user_id as varchar) as organisation_number,
    case event_id % 7 when 0 then 'linkedin' when 1 then 'google_places' when 2 then 'news' when 3 then 'wikidata' when 4 then 'facebook' when 5 then 'fax' else 'company_site' end as platform,
    case event_id % 9 when 0 then 'profile_handle' when 1 then 'profile_metrics' when 2 then 'place_summary' when 3 then 'review' when 4 then 'job_posting' when 5 then 'public_post' when 6 then 'public_mention' when 7 then 'review_summary' else 'company_profile' end as signal_type,
    case when event_id % 31 = 0 then null else 'https://www.h' || cast(event_id % 13 as varchar) || '.example.com/' || event_type || '/' || cast(event_id % 50 as varchar) end as source_url,
    'h' || cast(event_id % 13 as varchar) || '.example.com' as host0,
    ts as retrieved_at, sha256(cast(event_id as varchar)) as content_sha256, event_id % 11 <> 0 as exact_entity,
    case when event_id % 17 = 0 then '' else 'org' end as identity_proof,
    case event_id % 5 when 0 then 'official_api' when 1 then 'licensed_api' when 2 then 'jobspy_experiment' else 'permitted_public_page' end as acquisition_mode,
    case when event_id % 19 = 0 then 'unclear' else 'approved' end as rights_status,
    case when event_id % 23 = 0 then null else 'span' end as evidence_span,
    case when event_id % 3 = 0 then case event_id % 4 when 0 then 'positive' when 1 then 'negative' when 2 then 'neutral' else 'mixed' end end as sentiment_label,
    case when event_id % 2 = 0 then 'public_news' else 'customer_review' end as source_class, 'm1' as sentiment_model_version,
    cast(event_id % 40 as varchar) as reviewer_id, cast(floor(value) as bigint) as engagement
  from events
), judged as (
  select *, case when source_url is null then '' else host0 end as host,
    list_filter([case when trim(coalesce(id, '')) = '' then 'missing observation id' end,
      case when not regexp_matches(coalesce(organisation_number, ''), '^[0-9]+$') then 'missing or invalid organisation number' end,
      case when platform = 'fax' then 'unsupported platform' end,
      case when source_url is null then 'missing or invalid source URL' end,
      case when retrieved_at is null then 'missing retrieval time' end,
      case when length(content_sha256) <> 64 then 'missing content hash' end,
      case when not exact_entity then 'exact legal entity is not verified' end,
      case when identity_proof = '' then 'missing exact-entity proof' end,
      case when acquisition_mode = 'jobspy_experiment' then 'acquisition mode is not approved for publication' end,
      case when rights_status <> 'approved' then 'source rights are not approved' end,
      case when signal_type in ('review', 'public_post', 'public_mention') and evidence_span is null then 'missing evidence span' end], lambda x: x is not null) as reasons
  from observations
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.functions import urls
    from heddle.operators.footprint import observation_reasons

    e = F.col("event_id")

    def pick(n: int, *values: str):
        out = F.lit(values[-1])
        for i, v in enumerate(values[:-1]):
            out = F.when(e % n == i, v).otherwise(out)
        return out

    rows = table(spark, sf_dir, "events").select(
        e.cast("string").alias("id"), F.col("user_id").cast("string").alias("organisation_number"),
        pick(7, "linkedin", "google_places", "news", "wikidata", "facebook", "fax", "company_site").alias("platform"),
        pick(9, "profile_handle", "profile_metrics", "place_summary", "review", "job_posting", "public_post", "public_mention", "review_summary", "company_profile").alias("signal_type"),
        F.when(e % 31 != 0, F.concat(F.lit("https://www.h"), (e % 13).cast("string"), F.lit(".example.com/"), F.col("event_type"), F.lit("/"), (e % 50).cast("string"))).alias("source_url"),
        F.col("ts").cast("timestamp").alias("retrieved_at"), F.sha2(e.cast("string"), 256).alias("content_sha256"), (e % 11 != 0).alias("exact_entity"),
        F.when(e % 17 == 0, "").otherwise("org").alias("identity_proof"), pick(5, "official_api", "licensed_api", "jobspy_experiment", "permitted_public_page").alias("acquisition_mode"),
        F.when(e % 19 == 0, "unclear").otherwise("approved").alias("rights_status"), F.when(e % 23 != 0, "span").alias("evidence_span"),
        F.when(e % 3 == 0, pick(4, "positive", "negative", "neutral", "mixed")).alias("sentiment_label"), pick(2, "public_news", "customer_review").alias("source_class"),
        F.lit("m1").alias("sentiment_model_version"), (e % 40).cast("string").alias("reviewer_id"), F.floor("value").cast("bigint").alias("engagement"),
    )
    rows = rows.withColumn("host", urls.host(F.col("source_url")))
    return rows.withColumn("reasons", observation_reasons(F.col("host")))
