"""Connectors over sites, directories, registers and models made of the driver's rows; the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import urls
from heddle.operators import connectors, envelope, profile
from heddle.plans.base import COMPANIES_SQL, companies
from heddle.registry import query
from heddle.session import dealt, table

_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '')"
_SITES_SQL = f"""p as (select {_HOST} as org, page_id, url, sha256(html) as sha, 'T' || page_id as title, case page_id % 4 when 0 then '/news/' || page_id when 1 then '/press/2024/' || page_id when 2 then '/newsroom' else '/om' end as path from pages where regexp_matches(url, '^[A-Za-z]+://')),
s as (select org, list({{'url': 'https://' || org || path, 'title': title, 'sha': sha, 'd': len(list_filter(string_split(path, '/'), lambda x: x <> ''))}}) as pages, count(*) as n, max(page_id) as k from p group by 1),
g as (select *, sha256(org) as sha from s where k % 3 <> 0 and k % 5 <> 0)"""


def _sites(spark, sf_dir):
    """Hosts as companies' sites: their pages put at four kinds of addresses; every third isn't exactly the company's, every fifth wasn't available."""
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("/news/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("/press/2024/"), k.cast("string"))).when(k % 4 == 2, "/newsroom").otherwise("/om")
    p = table(spark, sf_dir, "pages").filter(F.col("url").rlike("^[A-Za-z]+://")).withColumn("organisation_number", urls.host(F.col("url")))
    page = F.struct(F.concat(F.lit("https://"), "organisation_number", path).alias("url"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.sha2("html", 256).alias("content_sha256"))
    s = p.groupBy("organisation_number").agg(F.collect_list(page).alias("pages"), F.max("page_id").alias("k"))
    links = F.transform(F.sequence(F.lit(1), (F.col("k") % 3).cast("int")), lambda i: F.struct(F.lit("x").alias("platform"), i.cast("string").alias("url")))
    return s.select(
        "organisation_number", F.when(F.col("k") % 5 == 0, "source_error").otherwise("available").alias("status"), F.when(F.col("k") % 3 == 0, 0.85).otherwise(0.95).alias("identity_score"), F.concat(F.lit("https://"), "organisation_number", F.lit("/")).alias("source_url"),
        F.lit("2024-01-01").alias("retrieved_at"), F.sha2("organisation_number", 256).alias("content_sha256"), F.lit("static_complete").alias("extraction_state"), "pages", links.alias("social_links"),
    )


@query("site_activity", f"with {_SITES_SQL} select 'company-site-activity-' || org || '-' || sha[:16] as id, org as organisation_number, 'Exact company site snapshot with ' || n || ' bounded pages and ' || (k % 3) || ' verified social links.' as evidence_span, cast(n as int) as pages from g")
def site_activity(spark, sf_dir):
    """PRJ13, DRV7."""
    return connectors.site_activity(_sites(spark, sf_dir)).select("id", "organisation_number", "evidence_span", F.col("bounded_pages_captured").alias("pages"))


@query("site_news", f"with {_SITES_SQL}, e as (select org, unnest(pages) as x from g), f as (select org, x.url as url, x.title as title, x.d as d from e where regexp_matches(x.url, '/(news|press)(/|$)')), r as (select *, row_number() over (partition by org order by d desc, url) as r, count(*) over (partition by org) as n from f) select 'company-site-news-' || sha256(org || '|' || url)[:24] as id, org as organisation_number, url as source_url, title as evidence_span, cast(n as int) as captured from r where r = 1")
def site_news(spark, sf_dir):
    """FLT17, DRV7: the deepest page of news of each exact site."""
    return connectors.site_news(_sites(spark, sf_dir)).select("id", "organisation_number", "source_url", "evidence_span", F.col("captured_news_pages").alias("captured"))


def _directory(spark, sf_dir):
    k = F.col("c_custkey")
    org = F.concat(F.lit("9"), F.lpad(k.cast("string"), 8, "0"))
    profiles = table(spark, sf_dir, "customer").select(org.alias("organisation_number"), F.concat(F.lit("Fjord "), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.lit(" AS")).alias("name"), k.alias("position"), "c_custkey")
    rating = F.concat(F.lit('{"@type":"LocalBusiness","aggregateRating":{"ratingValue":"'), F.when(k % 7 == 0, "6").otherwise(F.concat((1 + k % 4).cast("string"), F.lit(".5"))), F.lit('","reviewCount":'), (k % 9).cast("string"), F.lit("}}"))
    body = F.concat(
        F.when(k % 5 != 0, F.concat(F.lit('<script type="application/ld+json">['), rating, F.lit("]</script>"))).otherwise(""), F.lit("<h1>"), F.upper(F.when(k % 4 == 0, F.lit("Annet AS")).otherwise(F.col("name"))), F.lit("</h1><p>Org. "),
        F.regexp_replace("organisation_number", "(...)(...)(...)", "$1 $2 $3"), F.lit("</p>"),
    )
    captured = profiles.filter(k % 3 != 0).select("organisation_number", F.concat(F.lit("https://d.example.com/"), "organisation_number").alias("url"), body.alias("body"))
    return connectors.directory_ratings(profiles, captured, "t")


_DIRECTORY_SQL = "d as (select c_custkey as k, case when c_custkey % 3 = 0 then 'not_captured' when c_custkey % 4 = 0 then 'identity_mismatch' when c_custkey % 5 = 0 then 'not_rated' when c_custkey % 7 = 0 or c_custkey % 9 = 0 then 'invalid_rating' else 'rated' end as status from customer)"


@query("directory_status", f"with {_DIRECTORY_SQL} select k as position, status from d")
def directory_status(spark, sf_dir):
    """DRV5: what a directory's pages say of customers."""
    return _directory(spark, sf_dir)[1].select("position", "status")


@query("directory_ratings", f"with {_DIRECTORY_SQL} select k as position, unnest(['review_summary', 'profile_metrics', 'buzz_metrics']) as signal_type, (1 + k % 4) + 0.5 as rating, k % 9 as review_count from d where status = 'rated'")
def directory_ratings(spark, sf_dir):
    return _directory(spark, sf_dir)[0].select("position", "signal_type", "rating", "review_count")


@query("reviewed_observations", "select 'verified-observation-' || sha256(cast(c_custkey as varchar) || '|https://n.example.com/' || o_orderkey || '|public_mention')[:24] as id, cast(c_custkey as varchar) as organisation_number, c_name as legal_name, case when o_orderkey % 2 = 0 then 'independent_news_discovery' else 'exact_entity_article_capture' end as strategy from orders join customer on c_custkey = o_custkey")
def reviewed_observations(spark, sf_dir):
    """PRJ14, DRV8: each order as a source that was reviewed for its customer."""
    k = F.col("o_orderkey")
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("organisation_number"), F.col("c_name").alias("name"))
    seeds = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("organisation_number"), F.concat(F.lit("https://n.example.com/"), k.cast("string")).alias("source_url"), F.lit("public_mention").alias("signal_type"), F.sha2(k.cast("string"), 256).alias("content_sha256"), F.lit("seen").alias("proof"), F.when(k % 2 == 0, "").otherwise("exact_entity_article_capture").alias("strategy"))
    out = connectors.reviewed_observations(profiles, seeds, "t")
    return out.select("id", "organisation_number", F.get("identity_proof", F.lit(0))["legal_name"].alias("legal_name"), "strategy")


_REGISTER_SQL = "r as (select cast(c_custkey as varchar) as org, 'h' || (c_custkey * 7 % 60) || '.no' as host from customer where c_custkey % 4 <> 0), x as (select *, sha256('20260823:' || org) as hr from r where org not in (select cast(o_custkey as varchar) from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')), f as (select * from x where host not in ('h7.no', 'h14.no'))"


@query("website_audit_sample", f"with {_REGISTER_SQL} select org as organisation_number, host from (select *, row_number() over (partition by host order by hr, org) as n from f) where n = 1 order by hr, org limit 20")
def website_audit_sample(spark, sf_dir):
    """SMP4: customers with different hosts, without some of either."""
    return _website_sample(spark, sf_dir)[0].select("organisation_number", "host")


@query("website_audit_counts", f"with {_REGISTER_SQL} select (select count(*) from customer) as registry_rows, (select count(*) from x) as rows_with_website, 0 as rows_without_host, (select count(distinct host) from f) as hosts, (select count(*) from x) - least(20, (select count(distinct host) from f)) as skipped_rows")
def website_audit_counts(spark, sf_dir):
    return _website_sample(spark, sf_dir)[1]


def _website_sample(spark, sf_dir):
    k = F.col("c_custkey")
    host = F.concat(F.lit("h"), (k * 7 % 60).cast("string"), F.lit(".no"))
    register = table(spark, sf_dir, "customer").select(k.cast("string").alias("organisation_number"), F.when(k % 4 == 1, F.concat(F.lit("https://www."), host, F.lit("/x"))).when(k % 4 != 0, host).otherwise(" ").alias("website"))
    excluded = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("organisation_number"))
    return connectors.website_sample(register, 20, excluded, spark.createDataFrame([("h7.no",), ("h14.no",)], "host string"))


@query("manifest_annotations", "select s_suppkey, case when s_suppkey % 3 = 0 then 'held_out' when s_suppkey % 2 = 0 then 'development' end as evaluation_split from supplier")
def manifest_annotations(spark, sf_dir):
    """JN11: what a manifest notes of suppliers, over what is known of them."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, "development").alias("evaluation_split"))
    return connectors.annotated(s, s.filter(k % 3 == 0).select("s_suppkey", F.lit("held_out").alias("evaluation_split")), ("evaluation_split",), "s_suppkey")


@query("reports_wanted", "select cast(c_custkey as varchar) as organisation_number, -c_custkey as position from customer where c_custkey % 2 = 0 and (c_custkey % 3 = 0 or c_custkey % 5 = 0) and exists (select 1 from orders where o_custkey = c_custkey)")
def reports_wanted(spark, sf_dir):
    """JN12: wanted customers without a registered headcount that have reports."""
    k = F.col("c_custkey")
    pdfs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("pdfs"))
    c = table(spark, sf_dir, "customer").join(pdfs, "c_custkey", "left").select("c_custkey", k.cast("string").alias("organisation_number"), F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "ukjent").otherwise(k.cast("string")).alias("registered_employees"), "pdfs")
    wanted = c.filter(k % 2 == 0).select("organisation_number", (-k).alias("position"))
    return connectors.reports_wanted(c.drop("c_custkey"), wanted).select("organisation_number", "position")


def _load():
    """A model that goes by a text's length; it stands for one that is loaded."""
    return lambda texts: [(" Positive." if len(t) % 3 == 0 else "NEGATIVE" if len(t) % 3 == 1 else "unsure", {"positive": 1.0}, float(len(t) % 100)) for t in texts]


_ITEMS_SQL = "i as (select doc_id, length(text) as n, text is not null and text <> '' as filled, doc_id % 5 <> 0 as exact, doc_id % 7 <> 0 as independent from documents)"


def _inferred(spark, sf_dir):
    k = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(
        k.cast("string").alias("id"), F.lit("1").alias("organisation_number"), "text", (k % 5 != 0).alias("exact_entity"), F.when(k % 7 == 0, "blog").otherwise("public_news").alias("source_class"), F.lit("u").alias("source_url"), F.lit("t").alias("retrieved_at"), F.lit("s").alias("evidence_span"), F.lit("h").alias("content_sha256"),
    )
    return connectors.inferred(items, _load, "by-length")


@query("sentiment_inference", f"with {_ITEMS_SQL} select cast(doc_id as varchar) as id, case n % 3 when 0 then 'positive' when 1 then 'negative' end as label from i where filled and exact and independent")
def sentiment_inference(spark, sf_dir):
    """DRV9, UDF4, SCA23: a model's words on the documents that it may see, as labels."""
    return _inferred(spark, sf_dir)[0].select("id", "label")


@query("sentiment_rejected", f"with {_ITEMS_SQL} select cast(doc_id as varchar) as id, array_to_string(list_filter([case when not exact then 'exact company identity is not verified' end, case when not independent then 'source is not an allowed independent class' end, case when not filled then 'missing text' end], lambda x: x is not null), '; ') as reasons from i where not (filled and exact and independent)")
def sentiment_rejected(spark, sf_dir):
    return _inferred(spark, sf_dir)[1].select("id", F.array_join("reasons", "; ").alias("reasons"))


@query("inference_latency", f"with {_ITEMS_SQL}, l as (select cast(n % 100 as double) as ms, row_number() over (order by n % 100) - 1 as r, count(*) over () as n from i where filled and exact and independent) select max(ms) filter (where r = (n - 1) // 2) as p50, max(ms) filter (where r = cast(floor((n - 1) * 0.95) as bigint)) as p95, any_value(n) as n, max(ms) as top from l")
def inference_latency(spark, sf_dir):
    """AGG7 over a model's milliseconds."""
    return connectors.latencies(_inferred(spark, sf_dir)[0])


_ACCOUNT_SQL = "a as (select o_orderkey as k, case o_orderkey % 3 when 0 then 1000.0 when 1 then 1.0 else 1000000.0 end as unit, cast(o_custkey as double) as v from orders)"


@query("account_normalise", f"with {_ACCOUNT_SQL} select k as o_orderkey, 'r' || k as record_id, case when k % 2 = 0 then 'EUR' else 'NOK' end as currency, case when k % 4 = 0 then v * unit when k % 4 = 1 then 0.0 else (v + 1) * unit end as revenue, case when k % 5 <> 0 then -v * unit end as annual_result, case when k % 7 = 0 then null else 0.0 end as equity from a")
def account_normalise(spark, sf_dir):
    """PRJ4: records with own and nested amounts, as numbers and as texts, in three units."""
    k, v = F.col("o_orderkey"), F.col("o_custkey")
    scale = F.when(k % 3 == 0, "beløp i hele tusen").when(k % 3 == 2, "MNOK")
    nested = F.struct(
        F.struct(F.struct((v + 1).alias("sumDriftsinntekter")).alias("driftsinntekter")).alias("driftsresultat"), F.when(k % 5 != 0, F.concat(F.lit("("), v.cast("string"), F.lit(",0)"))).otherwise("–").alias("aarsresultat"),
    )
    record = F.struct(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "EUR").alias("valuta"), scale.alias("scale"), F.when(k % 4 == 0, v.cast("string")).when(k % 4 == 1, "0").alias("revenue"), F.when(k % 7 != 0, "0,0").alias("equity"), nested.alias("resultatregnskapResultat"))
    a = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", profile.normalized_account(F.to_json(record)).alias("a"))
    return a.select("o_orderkey", "a.record_id", "a.currency", "a.revenue", "a.annual_result", "a.equity")


@query("typed_locations", "with s as (select s_suppkey as k, n_name as city from supplier join nation on n_nationkey = s_nationkey) select k as s_suppkey, 'registered_office' as type, 'Vei ' || k || ', 0' || (100 + k % 800) || ' ' || city as address, cast(null as bigint) as employees from s union all select k, 'postal_address', 'Postboks 1, Sverige', null from s where k % 2 = 0 union all select k, 'subunit', case when i = 1 then 'Kai ' || k end, i * 10 from s, (select unnest(range(1, 3)) as i) where i <= k % 3")
def typed_locations(spark, sf_dir):
    """PRJ7: registered offices, postal addresses that differ, and subunits of suppliers."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    home = F.struct(F.array(F.concat(F.lit("Vei "), k.cast("string"))).alias("adresse"), F.concat(F.lit("0"), (100 + k % 800).cast("string")).alias("postnummer"), F.col("n_name").alias("poststed"), F.lit("Norge").alias("land"))
    away = F.struct(F.array(F.lit("Postboks 1")).alias("adresse"), F.lit(None).cast("string").alias("postnummer"), F.lit(None).cast("string").alias("poststed"), F.lit("Sverige").alias("land"))
    entity = F.to_json(F.struct(home.alias("forretningsadresse"), F.when(k % 2 == 0, away).otherwise(home).alias("postadresse")))
    unit = lambda i: F.struct(i.cast("string").alias("organisasjonsnummer"), F.when(i == 1, F.struct(F.array(F.concat(F.lit("Kai "), k.cast("string"))).alias("adresse"))).alias("beliggenhetsadresse"), (i * 10).alias("antallAnsatte"))
    units = F.filter(F.transform(F.sequence(F.lit(1), F.lit(2)), unit), lambda u: u["organisasjonsnummer"].cast("int") <= k % 3)
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.explode(profile.typed_locations(entity, F.to_json(F.struct(F.struct(units.alias("underenheter")).alias("_embedded"))))).alias("x"))
    return rows.select("s_suppkey", "x.type", "x.address", "x.employees")


def _envelopes(spark, sf_dir):
    c, k = companies(spark, sf_dir), F.col("custkey")
    record = lambda status, url, sha, *more: F.struct(status.alias("status"), url.alias("source_url"), F.lit(None).cast("string").alias("source_class"), F.lit("2024-01-01").alias("retrieved_at"), sha.alias("content_sha256"), *more)
    none, own = F.lit(None).cast("string"), F.concat(F.lit("https://"), F.lower("name"), F.lit(".no"))
    money = F.when(F.col("revenue").isNotNull(), record(F.lit("available"), none, F.sha2("organisation_number", 256), F.lit(True).alias("has_records"), F.col("revenue").cast("double").alias("revenue"), F.when(k % 2 == 0, F.col("annual_result").cast("double")).alias("operating_result"), F.col("last_year").cast("string").alias("reporting_period")))
    site = F.when(k % 5 != 0, record(F.when(k % 3 == 0, "source_error").otherwise("available"), own, none, F.lit(None).cast("string").alias("title")))
    rows = c.select("custkey", "organisation_number", "name", F.when(k % 4 == 0, "ENK").otherwise(F.col("legal_form")).alias("legal_form"), F.when(k % 6 != 0, F.col("employees")).alias("employees"), "municipality", F.when(k % 5 == 0, F.when(k % 10 == 0, own)).otherwise(own).alias("website"), record(F.lit("available"), none, none).alias("registry"), money.alias("financials"), site.alias("site"))
    return rows.select("custkey", "organisation_number", *[v.alias(n) for n, v in envelope.output_envelope("r1", "t0", "t9").items()])


_OUT_SQL = f"""{COMPANIES_SQL}, e as (select custkey as k, organisation_number as org, name, case when custkey % 4 = 0 then 'ENK' else legal_form end as form, case when custkey % 6 <> 0 then employees end as staff, municipality, revenue, case when custkey % 2 = 0 then annual_result end as result,
  case when custkey % 10 = 0 or custkey % 5 <> 0 then 'https://' || lower(name) || '.no' end as site, case when custkey % 5 = 0 then null when custkey % 3 = 0 then 'source_error' else 'available' end as web from companies),
c as (select org, 0 as n, 'legal_name' as field, 'available' as availability, '0' as cites from e union all select org, 1, 'legal_form', 'available', '0' from e union all select org, 2, 'employees', case when staff is null then 'not_available' else 'available' end, case when staff is not null then '0' else '' end from e
  union all select org, 3, 'municipality', 'available', '0' from e union all select org, 4, 'annual_revenue', case when revenue is not null then 'available' when form in ('ENK', 'FLI') then 'not_applicable' else 'not_available' end, case when revenue is not null then '1' else '' end from e
  union all select org, 5, 'operating_result', case when result is null then 'not_available' else 'available' end, case when result is null then '' else '1' end from e where revenue is not null
  union all select org, case when revenue is null then 5 else 6 end, 'official_website', case when site is null then 'not_available' when web = 'source_error' then 'failed' else 'available' end, case when site is null or web = 'source_error' then '' when web = 'available' then (case when revenue is null then '1' else '2' end) else '0' end from e)"""


@query("output_envelopes", f"with {_OUT_SQL} select org as organisation_number, cast(n as int) as place, field, availability, case when cites = '' then '' else 'ev-' || org || '-' || cites end as evidence from c")
def output_envelopes(spark, sf_dir):
    """PRJ9, PRJ11: the claims of each company's envelope by the contract, and what they cite."""
    rows = _envelopes(spark, sf_dir).select("organisation_number", F.posexplode("claims").alias("place", "c"))
    return rows.select("organisation_number", "place", "c.field", "c.availability", F.array_join("c.evidence_ids", ",").alias("evidence"))


@query("envelope_evidence", f"with {_OUT_SQL}, p as (select org, '0' as n, 'official_registry' as kind, 'https://data.brreg.no/enhetsregisteret/api/enheter/' || org as url from e union all select org, '1', 'official_annual_accounts', 'https://data.brreg.no/regnskapsregisteret/regnskap/' || org from e where revenue is not null union all select org, case when revenue is null then '1' else '2' end, 'company_owned', site from e where site is not null and web = 'available') select org as organisation_number, 'ev-' || org || '-' || n as id, kind as source_class, url as source_url from p")
def envelope_evidence(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).select("organisation_number", F.explode("evidence").alias("e"))
    return rows.select("organisation_number", "e.id", "e.source_class", "e.source_url")


@query("envelope_contract_errors", "select error, count(*) as n from (select unnest(list_filter([case when c_custkey % 7 = 0 then 'Envelope missing valid ''run'' section' end, case when c_custkey % 11 = 0 then 'Claim #1 missing ''field''' end, case when c_custkey % 13 = 0 then 'Evidence #0 missing required fields (id, source_url, retrieved_at)' end, case when c_custkey % 17 = 0 then 'Envelope missing valid ''operations'' section' end], lambda x: x is not null)) as error from customer) group by 1")
def envelope_contract_errors(spark, sf_dir):
    """FLT13: faults planted in envelopes, as the validator tells them."""
    k = F.col("custkey")
    e = _envelopes(spark, sf_dir)
    broken = e.withColumns(
        {
            "run": F.when(k % 7 == 0, F.col("run").withField("run_id", F.lit(""))).otherwise(F.col("run")), "claims": F.when(k % 11 == 0, F.transform("claims", lambda x, i: F.when(i == 1, x.withField("field", F.lit(""))).otherwise(x))).otherwise(F.col("claims")),
            "evidence": F.when(k % 13 == 0, F.transform("evidence", lambda x, i: F.when(i == 0, x.withField("source_url", F.lit(None).cast("string"))).otherwise(x))).otherwise(F.col("evidence")), "operations": F.when(k % 17 != 0, F.col("operations")),
        }
    )
    return broken.select(F.explode(envelope.envelope_errors()).alias("error")).groupBy("error").agg(F.count("*").alias("n"))
