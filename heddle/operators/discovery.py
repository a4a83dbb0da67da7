"""DRV1, JN8, JN10, JN13, PRJ16, SCA11, SCA22: sites found by search and judged by their own pages, and observations, seeds and handles put to companies.

All plans read tables of what was captured; nothing is fetched. Profiles have ``organisation_number, name, municipality, website`` (null or blank: none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import identity, text, urls
from heddle.operators import pages as markup


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit("")) == ""


def search_query(name: Column, number: Column, municipality: Column) -> Column:
    """PRJ16: what a company is searched for with: its name in quotes, its number, its place; fails the query without name or number."""
    plain = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    digits, place = F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", ""), plain(municipality)
    told = F.concat(F.lit('"'), plain(name), F.lit('" '), digits, F.when(place != "", F.concat(F.lit(" "), place)).otherwise(""))
    return F.when((plain(name) == "") | (digits == ""), F.raise_error(F.lit("Company discovery requires a legal name and organisation number")).cast("string")).otherwise(told)


def best_result(profiles: DataFrame, results: DataFrame) -> DataFrame:
    """TOP2: of each profile's search results (``organisation_number, rank, url, title, snippet``) the one that may be fetched: by score, rank, address; a row for each
    profile that was searched for, with ``candidates`` and, if there is one, ``selected``."""
    c = F.col
    own = profiles.select("organisation_number", c("name").alias("_name"), c("municipality").alias("_place"))
    found = results.join(own, "organisation_number").withColumn("_home", urls.homepage(c("url")))
    judged = identity.candidate(c("_name"), c("organisation_number"), c("_place"), F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), urls.host(c("_home")))
    # Of equal scores the least rank counts, one without rank last.
    one = F.struct((-c("_c.score")).alias("order"), F.coalesce("rank", F.lit(10_000)).alias("rank"), c("_home").alias("url"), c("_c.score").alias("score"))
    rows = found.withColumn("_c", judged).withColumn("_one", F.when(c("_c.publishable") & c("_home").isNotNull(), one))
    return profiles.select("organisation_number").join(rows.groupBy("organisation_number").agg(F.count("*").alias("candidates"), F.min("_one").alias("selected")), "organisation_number", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def site_identity(site: DataFrame, name: Column, number: Column) -> Column:
    """SCA4 of a merged website (see :func:`heddle.operators.pages.merged`): headers are title, description, identity text and host; other pages' titles count as pages."""
    c = F.col
    headers = [c("title"), c("description"), c("identity_text_excerpt"), urls.host(c("source_url"))]
    rest = F.concat_ws(" ", F.transform(F.coalesce("pages", F.array().cast("array<struct<url:string,title:string,content_sha256:string>>")), lambda p: p["title"]))
    return identity.site_score_v1(name, number, headers, c("main_text_excerpt"), rest)


def discovered(profiles: DataFrame, results: DataFrame, fetched: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """DRV1: for profiles without a website (the first ``limit`` by number) the best search result, its captured pages, and whether they are exactly the company's.

    ``fetched`` has captured pages by ``requested_url`` (see :func:`heddle.operators.pages.page_events`, without number). Returns a row for each profile with its
    outcome, and one row of counts over all profiles, from one frame.
    """
    c = F.col
    without = profiles.filter(blank(c("website")))
    asked = without if limit is None else without.orderBy("organisation_number").limit(limit)
    chosen = best_result(asked, results).join(asked.select("organisation_number", "name"), "organisation_number")
    wanted = chosen.filter("selected is not null").select("organisation_number", "name", c("selected.url").alias("requested_url"))
    caught = wanted.join(fetched.drop("organisation_number"), "requested_url")
    site = markup.merged(markup.page_events(caught.drop("name"))).join(wanted.select("organisation_number", "name"), "organisation_number")
    score = site_identity(site, c("name"), c("organisation_number"))
    judged = site.select("organisation_number", c("status").alias("site_status"), c("source_url").alias("site_url"), F.when(c("status") == "available", score).alias("site_score"), identity.quarantined(c("social_links"), c("name"), score >= 0.9).alias("social_links"))
    rows = chosen.join(judged, "organisation_number", "left")
    good = (c("site_status") == "available") & (c("site_score") >= 0.9)
    outcome = F.when(c("selected").isNull(), "abstained_before_crawl").when(c("site_status").isNull(), "not_captured").when(good, "verified").otherwise("quarantined")
    told = rows.select("organisation_number", "candidates", c("selected.url").alias("selected_url"), c("selected.score").alias("candidate_score"), outcome.alias("outcome"), "site_score", F.when(good, c("site_url")).alias("website"), F.when(good, c("social_links")).alias("social_links"))
    n = lambda x: F.count_if(c("outcome") == x)
    skipped = profiles.agg(F.count_if(~blank(c("website"))).alias("registry_website_present_skipped"))
    counts = told.agg(F.count("*").alias("queried"), n("abstained_before_crawl").alias("abstained_before_crawl"), n("not_captured").alias("not_captured"), n("verified").alias("verified_sites"), n("quarantined").alias("quarantined_sites"))
    return told, counts.join(skipped)


def with_observations(profiles: DataFrame, observations: DataFrame, key: str = "organisation_number") -> DataFrame:
    """JN8: profiles with their external observations, each id once, by id. Observations of other companies are left out.

    Ids are made unique before they are gathered, so a company gathers no more than it has different ones.
    """
    whole = F.struct("id", *[c for c in observations.columns if c not in ("id", key)])
    once = observations.filter(F.col("id").isNotNull()).groupBy(key, "id").agg(F.min(whole).alias("_o"))
    lists = once.groupBy(key).agg(F.array_sort(F.collect_list("_o")).alias("external_observations"))
    kind = once.select(F.array("_o").alias("_o")).schema["_o"].dataType
    return profiles.join(lists, key, "left").withColumn("external_observations", F.coalesce("external_observations", F.array().cast(kind)))


def with_seeds(profiles: DataFrame, seeds: DataFrame, key: str = "organisation_number") -> DataFrame:
    """JN10: profiles whose website a verified seed (``website, proof_url, proof``) replaces, with where it is from.

    Fails the query on a seed of an unknown company, on two of one, and on one whose addresses aren't absolute.
    """
    c = F.col
    once = seeds.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(F.trim("website").alias("website"), F.trim("proof_url").alias("proof_url"), F.coalesce("proof", F.lit("")).alias("proof"))).alias("_seed"))
    both = profiles.withColumn("_known", F.lit(True)).join(once, key, "full")
    absolute = c("_seed.website").rlike("^https?://") & c("_seed.proof_url").rlike("^https?://")
    fault = (
        F.when(c("_known").isNull(), F.concat(F.lit("verified seeds contain unknown organisations: "), c(key)))
        .when(c("_n") > 1, F.concat(F.lit("verified seeds contain an organisation twice: "), c(key)))
        .when(c("_seed").isNotNull() & ~F.coalesce(absolute, F.lit(False)), F.concat(F.lit("seed needs absolute website and proof_url: "), c(key)))
    )
    site = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).when(c("_seed").isNotNull(), c("_seed.website")).otherwise(c("website"))
    rows = both.withColumns({"website": site, "website_seed_source": F.when(c("_seed").isNotNull(), "independently_verified_exact_entity"), "website_seed_proof": F.when(c("_seed").isNotNull(), F.struct("_seed.proof_url", "_seed.proof"))})
    return rows.drop("_known", "_n", "_seed")


def without_handle(candidates: DataFrame, handles: DataFrame, platform: str, wanted: DataFrame | None = None, key: str = "organisation_number") -> DataFrame:
    """JN13: candidates that have no handle on a platform yet and, if ``wanted`` is given, are among those."""
    known = handles.filter(F.col("platform") == platform).select(key)
    left = candidates.join(known, key, "left_anti")
    return left if wanted is None else left.join(wanted.select(key), key, "left_semi")


#: Titles that tell no name (fixed values).
NO_ALIAS = ["home", "homepage", "forside", "welcome", "velkommen", "official site"]
LEADER_CODES = ["DAGL", "LEDE", "INNH"]


def site_aliases(name: Column, titles: Column, most: int = 3) -> Column:
    """SCA22: other names that a company's site gives it: what stands before a bar or dash in its titles, of 3 to 80 characters, not its own name."""
    head = lambda t: F.trim(F.regexp_extract(F.coalesce(t, F.lit("")), r"(?s)^(.*?)(?:\s+[|–—]\s+.*)?$", 1))
    plain = text.full_name
    good = lambda t: urls.bound(plain(t), lambda x: ~x.isin(NO_ALIAS) & (x != plain(name)) & F.length(x).between(3, 80))
    return F.slice(F.array_distinct(F.filter(F.transform(titles, head), good)), 1, most)


def leaders(roles: Column, most: int = 5) -> Column:
    """SCA22: the names of a company's leaders among its roles (``name, role_code``)."""
    found = F.filter(roles, lambda r: r["role_code"].isin(LEADER_CODES) & ~blank(r["name"]))
    return F.slice(F.transform(found, lambda r: r["name"]), 1, most)


def profile_identity(name: Column, site_host: Column, found_name: Column, found_site: Column, found_url: Column) -> Column:
    """SCA11: whether a page on a platform is a company's: its name without legal forms, or the domain that it links back to, agrees."""
    own, other = text.company_name(name), text.company_name(found_name)
    exact = (own != "") & (own == other)
    back = urls.host(F.when(found_site.contains("://"), found_site).otherwise(F.concat(F.lit("https://"), found_site)))
    reverse = (F.coalesce(site_host, F.lit("")) != "") & (site_host == back)
    return F.struct((found_url.isNotNull() & (exact | F.coalesce(reverse, F.lit(False)))).alias("publishable_candidate"), exact.alias("exact_legal_name_core"), F.coalesce(reverse, F.lit(False)).alias("reverse_domain_match"))


def discovery_identity(facts: DataFrame) -> DataFrame:
    """SCA11: whether a page that was found is exactly a company, by five pairs of facts. Needs ``name, municipality, site_host, aliases, leaders`` of the company and ``found_name, found_site,
    found_place, found_text, by_job_link`` of the page; adds ``exact_entity`` and each fact."""
    c = F.col
    full, core = text.full_name, text.company_name
    same = lambda a, b: (a != "") & (a == b)
    back = urls.host(F.when(c("found_site").contains("://"), c("found_site")).otherwise(F.concat(F.lit("https://"), c("found_site"))))
    domain = F.coalesce((c("site_host") != "") & (c("site_host") == back), F.lit(False))
    place = full(c("municipality"))
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (full(a) == c("_full")) | (core(a) == c("_core")))
    said = F.filter(F.coalesce("leaders", F.array().cast("array<string>")), lambda x: F.contains(c("_text"), full(x)))
    rows = facts.withColumns({"_full": full(c("found_name")), "_core": core(c("found_name")), "_text": full(c("found_text"))})
    rows = rows.withColumns({"full_legal_name_match": same(full(c("name")), c("_full")), "legal_name_core_match": same(core(c("name")), c("_core")), "reverse_domain_match": domain, "location_match": (place != "") & F.contains(full(c("found_place")), place), "official_site_alias_match": alias, "matched_registered_leaders": said})
    exact = (
        c("legal_name_core_match") & c("reverse_domain_match") | c("official_site_alias_match") & c("reverse_domain_match") | c("full_legal_name_match") & c("location_match")
        | c("full_legal_name_match") & F.coalesce("by_job_link", F.lit(False)) | c("official_site_alias_match") & c("location_match") & (F.size("matched_registered_leaders") > 0)
    )
    return rows.withColumn("exact_entity", exact).drop("_full", "_core", "_text")


def keep_first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
