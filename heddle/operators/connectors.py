"""PRJ13, PRJ14, FLT17, DRV5, DRV7-DRV9, SMP4, JN11, JN12, SCA23, UDF4: observations from sites, directories, reviewed sources and models, over captured tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import graphs, urls
from heddle.operators import pages as markup
from heddle.operators.footprint import blank, eligibility_reasons
from heddle.operators.relational import hash_rank, values_at

NEWS_PATH = "(?i)/(news|press|aktuelt|nyheter|artikler|blog)(/|$)"
#: Labels that a model may give (fixed values).
OUTPUT_LABELS = ["positive", "neutral", "negative"]
APPROVED = {"acquisition_mode": "permitted_public_page", "rights_status": "approved", "source_class": "company_site", "platform": "company_site", "strategy": "company_site_activity"}


def _fixed(values: dict[str, str]) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def _exact_sites(sites: DataFrame) -> DataFrame:
    """Merged websites (see :func:`heddle.operators.pages.merged`) that are available and exactly the company's (``identity_score`` of 0.9 and more)."""
    return sites.filter((F.col("status") == "available") & (F.col("identity_score") >= 0.9))


def site_activity(sites: DataFrame) -> DataFrame:
    """PRJ13, DRV7: of each exact site one observation on how much of it was captured; none without address or content hash."""
    c = F.col
    good = _exact_sites(sites).filter(~blank(c("source_url")) & (F.length(F.coalesce("content_sha256", F.lit(""))) == 64))
    pages, links = F.size("pages"), F.size("social_links")
    span = F.concat(F.lit("Exact company site snapshot with "), pages.cast("string"), F.lit(" bounded pages and "), links.cast("string"), F.lit(" verified social links."))
    return good.select(
        F.concat(F.lit("company-site-activity-"), "organisation_number", F.lit("-"), F.substring("content_sha256", 1, 16)).alias("id"), "organisation_number", F.lit("profile_metrics").alias("signal_type"), "source_url", "retrieved_at", "content_sha256",
        F.lit(True).alias("exact_entity"), F.concat(F.lit("website_identity_gate:"), c("identity_score").cast("string")).alias("identity_proof"), span.alias("evidence_span"), pages.alias("bounded_pages_captured"), links.alias("verified_social_links"), "extraction_state", *_fixed(APPROVED),
    )


def site_news(sites: DataFrame, most_characters: int = 1200) -> DataFrame:
    """FLT17, DRV7: of each exact site one page of news, the one deepest in the site, then by address; with how many there are. None if that page has no
    absolute address or no hash."""
    c = F.col
    path = lambda u: F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    depth = lambda u: F.size(F.filter(F.split(path(u), "/"), lambda x: x != ""))
    news = F.array_sort(F.transform(F.filter("pages", lambda p: path(p["url"]).rlike(NEWS_PATH)), lambda p: F.struct((-depth(p["url"])).alias("d"), p["url"].alias("url"), p["title"].alias("title"), p["content_sha256"].alias("sha"))))
    rows = _exact_sites(sites).select("organisation_number", "retrieved_at", "identity_score", news.alias("_news")).withColumn("_p", F.get("_news", F.lit(0)))
    good = rows.filter(c("_p.url").rlike("^https?://") & (F.length(F.coalesce("_p.sha", F.lit(""))) == 64))
    title = F.coalesce(F.nullif(F.trim("_p.title"), F.lit("")), F.lit("Company news/activity page"))
    return good.select(
        F.concat(F.lit("company-site-news-"), F.substring(F.sha2(F.concat("organisation_number", F.lit("|"), "_p.url"), 256), 1, 24)).alias("id"), "organisation_number", F.lit("public_post").alias("signal_type"), c("_p.url").alias("source_url"), "retrieved_at", c("_p.sha").alias("content_sha256"),
        F.lit(True).alias("exact_entity"), F.concat(F.lit("website_identity_gate:"), c("identity_score").cast("string")).alias("identity_proof"), F.substring(title, 1, most_characters).alias("evidence_span"), F.size("_news").alias("captured_news_pages"), *_fixed(APPROVED),
    )


def directory_ratings(profiles: DataFrame, captured: DataFrame, retrieved_at: str) -> tuple[DataFrame, DataFrame]:
    """DRV5: ratings that directory pages (``organisation_number, url, body``) hold in JSON-LD, of pages that show exactly the company's name and number; three observations each,
    and a row of status for each profile (``organisation_number, name, position``)."""
    c = F.col
    read = markup.with_parts(captured.select("organisation_number", "url", "body"), "body", "html.")
    rated = lambda n: F.try_variant_get(n, "$.aggregateRating", "map<string,variant>").isNotNull() & graphs.text_at(n, "$.aggregateRating.ratingValue").isNotNull()
    count = lambda n: F.coalesce(graphs.text_at(n, "$.aggregateRating.ratingCount"), graphs.text_at(n, "$.aggregateRating.reviewCount"))
    top = F.get(F.filter(graphs.graph(c("json_ld")), lambda n: rated(n) & count(n).isNotNull()), F.lit(0))
    google = F.get(F.filter(F.transform("links", lambda x: x["href"]), lambda h: h.rlike(r"search\.google\.com/local/reviews")), F.lit(0))
    text = F.concat_ws(" ", "title", "identity_text", "main_text", F.array_join(F.transform("links", lambda x: x["label"]), " "), F.regexp_replace(F.coalesce("body", F.lit("")), "(?s)<(script|style).*?</(script|style)>|<[^>]*>", " "))
    rows = read.select("organisation_number", "url", F.sha2("body", 256).alias("_sha"), F.lower(text).alias("_text"), graphs.text_at(top, "$.aggregateRating.ratingValue").try_cast("double").alias("rating"), count(top).try_cast("long").alias("review_count"), google.alias("google_review_url"))
    both = profiles.select("organisation_number", "name", "position").join(rows, "organisation_number", "left")
    exact = F.contains("_text", F.lower(F.regexp_replace(c("name"), r"\s+", " "))) & F.contains(F.regexp_replace("_text", r"\D", ""), c("organisation_number"))
    valid = (c("rating") > 0) & (c("rating") <= 5) & (c("review_count") > 0)
    status = F.when(c("url").isNull(), "not_captured").when(~F.coalesce(exact, F.lit(False)), "identity_mismatch").when(c("rating").isNull() | c("review_count").isNull(), "not_rated").when(~valid, "invalid_rating").otherwise("rated")
    told = both.withColumn("status", status)
    number = F.format_string("%s/5 based on %d reviews", c("rating").cast("string"), c("review_count"))
    span = F.concat(F.lit("Google aggregate rating "), number, F.lit(", embedded on exact Fagfolkguiden company page."))
    kinds = [("fagfolk-review-", "review_summary", "places_rating_reviews"), ("fagfolk-metrics-", "profile_metrics", "social_profile_metrics"), ("fagfolk-buzz-", "buzz_metrics", "buzz_peer_normalization")]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("signal_type"), F.lit(t).alias("strategy")) for p, s, t in kinds])).alias("k")
    fixed = {"platform": "company_directory", "acquisition_mode": "rights_review_experiment", "rights_status": "review_required", "source_class": "customer_review", "retrieved_at": retrieved_at}
    found = told.filter("status = 'rated'").select("*", span.alias("evidence_span"), each)
    out = found.select(F.concat("k.prefix", "organisation_number", F.lit("-"), F.substring("_sha", 1, 16)).alias("id"), "organisation_number", "position", "k.signal_type", "k.strategy", c("url").alias("source_url"), c("_sha").alias("content_sha256"), "rating", "review_count", "google_review_url", "evidence_span", F.lit(True).alias("exact_entity"), *_fixed(fixed))
    return out, told.select("organisation_number", "position", "status", "rating", "review_count")


def reviewed_observations(profiles: DataFrame, seeds: DataFrame, retrieved_at: str) -> DataFrame:
    """PRJ14, DRV8: observations of sources that were reviewed by hand (``organisation_number, source_url, signal_type, content_sha256, proof`` and, if there, ``acquisition_mode, rights_status, source_class,
    strategy``). An unknown company, or a hash that isn't one, fails the query."""
    c = F.col
    rows = seeds.join(profiles.select("organisation_number", c("name").alias("_name")).withColumn("_known", F.lit(True)), "organisation_number", "left")
    fault = F.when(c("_known").isNull(), F.concat(F.lit("unknown organisation number: "), "organisation_number")).when(~F.coalesce(c("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.concat(F.lit("invalid content hash for "), "organisation_number"))
    checked = rows.withColumn("_ok", F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).filter("_ok")
    given = lambda name, other: F.coalesce(F.nullif(c(name), F.lit("")), F.lit(other)) if name in seeds.columns else F.lit(other)
    proof = F.struct(F.lit("manual_exact_entity_review").alias("type"), c("_name").alias("legal_name"), c("proof").alias("basis"))
    key = F.concat_ws("|", "organisation_number", "source_url", "signal_type")
    kept = [x for x in seeds.columns if x not in ("proof", "acquisition_mode", "rights_status", "source_class", "strategy")]
    defaults = {"acquisition_mode": "rights_review_experiment", "rights_status": "review_required", "source_class": "public_news", "strategy": "independent_news_discovery"}
    return checked.select(F.concat(F.lit("verified-observation-"), F.substring(F.sha2(key, 256), 1, 24)).alias("id"), *kept, F.lit(retrieved_at).alias("retrieved_at"), F.lit(True).alias("exact_entity"), F.array(proof).alias("identity_proof"), *[given(k, v).alias(k) for k, v in defaults.items()])


def website_sample(register: DataFrame, count: int, excluded: DataFrame, excluded_hosts: DataFrame, seed: str = "20260823") -> tuple[DataFrame, DataFrame]:
    """SMP4: the ``count`` first companies by hash of those with a website, one a host, without excluded companies (``organisation_number``) and hosts (``host``); and a row that
    counts what was left out. Of a host the company that ranks first stands for it, so no more than hosts are ranked."""
    c = F.col
    host = urls.host(F.when(c("website").contains("://"), F.trim("website")).otherwise(F.concat(F.lit("https://"), F.trim("website"))))
    sites = register.filter(~blank(c("website"))).join(excluded.select("organisation_number"), "organisation_number", "left_anti").select("organisation_number", "website", host.alias("host"), hash_rank(c("organisation_number"), seed).alias("hash_rank"))
    free = sites.filter("host <> ''").join(excluded_hosts.select("host"), "host", "left_anti")
    first = free.groupBy("host").agg(F.min(F.struct("hash_rank", "organisation_number", "website")).alias("x")).select("x.*", "host")
    chosen = first.orderBy("hash_rank", "organisation_number").limit(count).withColumns({"sample_slice": F.lit("fresh_website_audit"), "evaluation_split": F.lit("independent_final")})
    told = register.agg(F.count("*").alias("registry_rows")).join(sites.agg(F.count("*").alias("rows_with_website"), F.count_if(c("host") == "").alias("rows_without_host"))).join(first.agg(F.count("*").alias("hosts")))
    return chosen, told.withColumn("skipped_rows", c("rows_with_website") - F.least(c("hosts"), F.lit(count)))


def annotated(profiles: DataFrame, manifest: DataFrame, columns: tuple[str, ...] = ("evaluation_split", "sample_slice"), key: str = "organisation_number") -> DataFrame:
    """JN11: profiles with what the manifest notes of them, where it notes anything."""
    notes = manifest.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = profiles.join(notes, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in profiles.columns], *[F.col(f"_{c}").alias(c) for c in columns if c not in profiles.columns])


def reports_wanted(profiles: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """JN12: of the wanted companies, in their order (``organisation_number, position``), those whose registered headcount (``registered_employees``) is no number and that have a
    report (``pdfs``, an array); a wanted company without a profile fails the query."""
    c = F.col
    both = wanted.select("organisation_number", "position").join(profiles.withColumn("_known", F.lit(True)), "organisation_number", "left")
    lacking = ~F.coalesce(c("registered_employees").cast("string").rlike("^[0-9]+$"), F.lit(False)) & (F.coalesce(F.size("pdfs"), F.lit(0)) > 0)
    unknown = F.raise_error(F.concat(F.lit("unknown organisation number: "), "organisation_number")).cast("boolean")
    out = both.filter(F.when(c("_known").isNull(), unknown).otherwise(lacking)).drop("_known")
    return out.orderBy("position").limit(limit) if limit else out


def generated_label(value: Column) -> Column:
    """SCA23: a model's word as one of the labels, without marks around it; null for others."""
    word = F.btrim(F.lower(F.trim(value)), F.lit(".,:;!?\"'"))
    return F.when(word.isin(OUTPUT_LABELS), word)


PREDICTION = "id string, organisation_number string, said string, probabilities map<string,double>, latency_ms double, source_class string, source_url string, retrieved_at string, evidence_span string, content_sha256 string"


def inferred(items: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, dict[str, float], float]]]], model_id: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """DRV9, UDF4: sentiment of the items that may be given to a model, and those that may not with the reasons; of the first ``limit`` by id.

    ``load`` makes the model, once for each task; the model maps texts to its word, the labels' probabilities and the milliseconds that it took. A word that is no label is null.
    """
    some = items if limit is None else items.orderBy("id").limit(limit)
    judged = some.withColumn("reasons", eligibility_reasons())
    kept = ["id", "organisation_number", "text", "source_class", "source_url", "retrieved_at", "evidence_span", "content_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            if len(pdf):
                said = model(pdf["text"].tolist())
                yield pdf.drop(columns="text").assign(said=[x[0] for x in said], probabilities=[x[1] for x in said], latency_ms=[float(x[2]) for x in said])[[c.split()[0] for c in PREDICTION.split(", ")]]

    eligible = judged.filter(F.size("reasons") == 0).select(*[F.col(c).cast("string") for c in kept])
    out = eligible.mapInPandas(run, PREDICTION).withColumns({"label": generated_label(F.col("said")), "exact_entity": F.lit(True), "model_id": F.lit(model_id)})
    return out, judged.filter(F.size("reasons") > 0).select("id", "reasons")


def latencies(predictions: DataFrame) -> DataFrame:
    """AGG7: the median and the 95th percentile of the milliseconds, by index."""
    return values_at(predictions, "latency_ms", {"p50": "(n - 1) div 2", "p95": "cast(floor((n - 1) * 0.95) as bigint)"}, summary=True)


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def display_slices(observations: DataFrame, order: str, most: int = 10) -> DataFrame:
    """PRJ8: what a company's page shows of its exact observations, in the order in which they came: the last profile and headcount, the first ``most`` posts and postings, and each
    handle once. Rows are cut to what is shown before a company's are gathered."""
    c = F.col
    told = F.struct(c("source_url").alias("source"), c("retrieved_at").alias("retrieved_at"), c("content_sha256").alias("hash"), c("rights_status").alias("rights_status"), c("evidence_span").alias("text"))
    exact = observations.filter(F.coalesce("exact_entity", F.lit(False)))
    network = exact.filter("platform = 'linkedin'")
    lasts = network.filter(c("signal_type").isin("profile_metrics", "workforce_snapshot")).groupBy("organisation_number").agg(
        F.max_by(F.when(c("signal_type") == "profile_metrics", told), F.when(c("signal_type") == "profile_metrics", c(order))).alias("profile"), F.max_by(F.when(c("signal_type") == "workforce_snapshot", told), F.when(c("signal_type") == "workforce_snapshot", c(order))).alias("workforce")
    )
    placed = network.filter(c("signal_type").isin("public_post", "job_posting")).withColumn("_n", F.row_number().over(Window.partitionBy("organisation_number", "signal_type").orderBy(order))).filter(c("_n") <= most)
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(c("signal_type") == kind, F.struct("_n", told.alias("t"))))), lambda x: x["t"])
    lists = placed.groupBy("organisation_number").agg(listed("public_post").alias("posts"), listed("job_posting").alias("jobs"))
    handles = exact.filter((c("signal_type") == "profile_handle") & ~blank(c("source_url"))).select("organisation_number", "platform", c("source_url").alias("url")).distinct()
    named = handles.groupBy("organisation_number").agg(F.array_sort(F.collect_list(F.struct("platform", "url"))).alias("handles"))
    return lasts.join(lists, "organisation_number", "full").join(named, "organisation_number", "full")
