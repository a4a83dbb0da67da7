"""DRV2, DRV3, SCA18, SCA39, SCA43, SCA44: a network's pages as a visitor without account sees them: company profiles and job postings, from captured responses.

Responses have ``url, body, content_sha256``, each url once. A request is the url that it would have; what wasn't captured is missing like what failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import graphs, text, urls
from heddle.operators import pages as markup
from heddle.operators.discovery import discovery_identity, keep_first_by, profile_identity
from heddle.session import durable, spread

#: Addresses of the network's open services (fixed values).
TYPEAHEAD = "https://www.linkedin.com/jobs-guest/api/typeaheadHits?typeaheadType=COMPANY&query="
JOBS = "https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/search?"
DETAIL = "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/"
JOB_CARD, ACTIVITY_CARD, ABOUT = "div.base-search-card", "article.main-feed-activity-card", "[data-test-id=about-us__]"
FOLLOWERS = r"(?i)([\d\s .,]+)\s+(?:followers|follower|følgere|Follower:innen|seguidores)"
COMPANY_IDS = r"(?is)facetCurrentCompany(?:%3D|=)(?:%255B|%5B|\[)(.*?)(?:%255D|%5D|\])"


def company_url(url: Column) -> Column:
    """SCA18: the one address of a company's page, by its name in small letters; null for others."""
    where = urls.host(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)

    def named(parts: Column) -> Column:
        slug = F.lower(F.trim(F.coalesce(F.try_url_decode(F.get(parts, F.lit(1))), F.lit(""))))
        encoded = F.replace(F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
        return F.when((F.lower(F.get(parts, F.lit(0))) == "company") & (slug != ""), F.concat(F.lit("https://linkedin.com/company/"), F.replace(encoded, F.lit("*"), F.lit("%2A"))))

    own = (where == "linkedin.com") | F.endswith(where, F.lit(".linkedin.com"))
    return F.when(own, urls.bound(F.filter(F.split(path, "/"), lambda x: F.trim(x) != ""), named))


def whole_number(value: Column) -> Column:
    """The digits of a text as a number, null if it has none."""
    return F.nullif(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", ""), F.lit("")).try_cast("long")


def _attribute(element: Column, name: str) -> Column:
    return element["attributes"][name]


def _first(card: Column, fits) -> Column:
    """The first element of a card that fits."""
    return F.get(F.filter(card, fits), F.lit(0))


def _classed(element: Column, tag: str, name: str) -> Column:
    return (element["tag"] == tag) & F.array_contains(F.split(F.coalesce(_attribute(element, "class"), F.lit("")), r"\s+"), name)


def profiles(captured: DataFrame) -> DataFrame:
    """DRV2, SCA43: company pages (``url, body``) that hold a structured organisation, read: name, address, followers, ids, what it says of itself, and posts of its own
    with their reactions and comments. The last organisation of a page counts; a page without one has ``name`` null."""
    c = F.col
    parts = markup.with_parts(captured, "body", f"{ACTIVITY_CARD},{ABOUT}")
    rows = parts.select(*captured.columns, graphs.graph(c("json_ld")).alias("_graph"), "metas", "cards")
    kind = lambda n, t: graphs.text_at(n, "$.@type") == t
    rows = rows.withColumn("_org", F.element_at(F.concat(F.array(F.lit(None).cast("variant")), F.filter("_graph", lambda n: kind(n, "Organization"))), -1))
    said = F.array_join(F.transform("metas", lambda m: m["content"]), " ")
    encoded = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(COMPANY_IDS), F.lit(1))
    twice = lambda x: F.coalesce(F.try_url_decode(F.coalesce(F.try_url_decode(x), x)), x)
    numbers = F.transform(F.flatten(F.transform(encoded, lambda x: F.regexp_extract_all(twice(x), F.lit(r"(\d+)"), F.lit(1)))), lambda x: x.try_cast("long"))
    rows = rows.withColumns({"page_url": company_url(graphs.text_at(c("_org"), "$.url")), "linkedin_organisation_ids": F.transform(F.array_sort(F.array_distinct(numbers)), lambda x: x.cast("string")), "followers": whole_number(F.regexp_extract(said, FOLLOWERS, 1))})

    def about(name: str) -> Column:
        """What stands under a heading: its definitions, or else its whole text."""
        card = F.get(F.filter("cards", lambda k: _attribute(F.get(k, F.lit(0)), "data-test-id") == f"about-us__{name}"), F.lit(0))
        told = F.filter(card, lambda e: e["tag"] == "dd")
        return F.nullif(F.when(F.size(told) > 0, F.array_join(F.transform(told, lambda e: e["text"]), " ")).otherwise(F.get(card, F.lit(0))["text"]), F.lit(""))

    def counted(card: Column, name: str) -> Column:
        return F.coalesce(whole_number(_attribute(_first(card, lambda e: _attribute(e, "data-test-id") == f"social-actions__{name}"), f"data-num-{name}")), F.lit(0))

    cards = F.filter("cards", lambda k: _attribute(F.get(k, F.lit(0)), "data-activity-urn").isNotNull())
    rows = rows.withColumn("_activity", F.transform(cards, lambda k: F.struct(F.element_at(F.split(_attribute(F.get(k, F.lit(0)), "data-activity-urn"), ":"), -1).alias("id"), counted(k, "reactions").alias("likes"), counted(k, "comments").alias("comments"))))

    def post(n: Column) -> Column:
        url = F.coalesce(graphs.text_at(n, "$.url"), graphs.text_at(n, "$.mainEntityOfPage"), F.lit(""))

        def told(x: Column) -> Column:
            number = F.regexp_extract(F.coalesce(F.try_url_decode(x), x), r"activity-(\d+)", 1)
            own = F.get(F.filter("_activity", lambda a: a["id"] == number), F.lit(0))
            return F.struct(x.alias("url"), graphs.text_at(n, "$.datePublished").alias("date_published"), F.trim(F.coalesce(graphs.text_at(n, "$.text"), F.lit(""))).alias("text"), F.coalesce(own["likes"], F.lit(0)).alias("likes"), F.coalesce(own["comments"], F.lit(0)).alias("comments"))

        return urls.bound(url, told)

    own_post = lambda n: kind(n, "DiscussionForumPosting") & (c("page_url").isNull() | (company_url(graphs.text_at(n, "$.author.url")) == c("page_url")))
    text_of = lambda path: graphs.text_at(c("_org"), path)
    site = F.get(F.filter(F.coalesce(F.get(F.filter("cards", lambda k: _attribute(F.get(k, F.lit(0)), "data-test-id") == "about-us__website"), F.lit(0)), F.array().cast("array<struct<tag:string,attributes:map<string,string>,text:string>>")), lambda e: e["tag"] == "a"), F.lit(0))["text"]
    return rows.select(
        *captured.columns, F.when(c("_org").isNotNull(), F.coalesce(text_of("$.name"), F.lit(""))).alias("name"), "page_url", "linkedin_organisation_ids", "followers", whole_number(text_of("$.numberOfEmployees.value")).alias("visible_employees"),
        about("size").alias("employee_size_label"), F.coalesce(text_of("$.description"), F.lit("")).alias("description"), F.nullif(site, F.lit("")).alias("website"), about("industry").alias("industry"), about("headquarters").alias("headquarters"),
        F.transform(F.filter("_graph", own_post), post).alias("posts"),
    )


def job_cards(captured: DataFrame, body: str = "body") -> DataFrame:
    """SCA39: pages of job cards with ``cards``, how many there are, and ``jobs``, those with a number: id, address, title, company, place and day, in order."""
    parts = markup.with_parts(captured, body, JOB_CARD)

    def job(card: Column) -> Column:
        link = _first(card, lambda e: (e["tag"] == "a") & _attribute(e, "href").isNotNull() & ~_classed(e, "a", "base-card__full-link"))
        full = F.coalesce(_attribute(_first(card, lambda e: _classed(e, "a", "base-card__full-link")), "href"), F.lit(""))
        urn = F.coalesce(_attribute(F.get(card, F.lit(0)), "data-entity-urn"), F.lit(""))
        number = F.coalesce(F.nullif(F.regexp_extract(urn, r"(\d{6,})", 1), F.lit("")), F.nullif(F.regexp_extract(full, r"-(\d{6,})(?:[/?]|$)", 1), F.lit("")))
        said = lambda tag, name: F.coalesce(_first(card, lambda e: _classed(e, tag, name))["text"], F.lit(""))
        posted = F.coalesce(_attribute(_first(card, lambda e: e["tag"] == "time"), "datetime"), F.lit(""))
        return F.struct(
            number.alias("job_id"), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number).alias("job_url"), said("span", "sr-only").alias("title"), F.coalesce(link["text"], F.lit("")).alias("company"),
            company_url(_attribute(link, "href")).alias("company_url"), said("span", "job-search-card__location").alias("location"), posted.alias("date_posted"),
        )

    return parts.select(*captured.columns, F.size("cards").alias("cards"), F.filter(F.transform("cards", job), lambda j: j["job_id"].isNotNull()).alias("jobs"))


def typeahead(body: Column, legal_name: Column) -> Column:
    """SCA44: the companies that a search box suggests: id, name, and whether the name without legal forms is exactly the company's."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(body), "$", "array<variant>"), F.array().cast("array<variant>"))
    own = text.company_name(legal_name)
    one = lambda v: F.struct(graphs.text_at(v, "$.id").alias("id"), F.coalesce(graphs.text_at(v, "$.displayName"), F.lit("")).alias("name"), (text.company_name(graphs.text_at(v, "$.displayName")) == own).alias("exact"))
    company = lambda v: (graphs.text_at(v, "$.type") == "COMPANY") & (F.coalesce(graphs.text_at(v, "$.id"), F.lit("")) != "")
    return F.transform(F.filter(items, company), one)


def detail_urls(links: Column) -> Column:
    """The companies' pages that a posting links to."""
    return F.array_distinct(F.filter(F.transform(links, lambda x: F.when(F.contains(x["href"], F.lit("linkedin.com/company/")), company_url(x["href"]))), lambda u: u.isNotNull()))


def jobs(handles: DataFrame, captured: DataFrame, search_pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """DRV3: of verified handles (``organisation_number, name, profile_url, company_ids``) the job postings whose company is exactly the handle's, and a report on each handle.

    Ids of the company are those known and those that the search box suggests under exactly its name. They are tried in order until one shows postings of the
    handle's own page, which confirms it; then the pages of a search for the name, until one is empty. A posting counts once, where it is
    met first, and only if its own page links to the handle's page as well.
    """
    c = F.col
    rows = handles.withColumns({"expected_url": company_url(c("profile_url")), "_query": F.coalesce(F.nullif(text.company_name(c("name")), F.lit("")), c("name"))})
    good = rows.filter("expected_url is not null")
    bodies = captured.select(c("url").alias("_request"), c("body").alias("_body"), c("content_sha256").alias("_sha"))
    suggested = good.select("organisation_number", "name", "expected_url", F.concat(F.lit(TYPEAHEAD), F.url_encode("_query")).alias("_request")).join(spread(bodies), "_request", "left").select("organisation_number", "expected_url", typeahead(c("_body"), c("name")).alias("suggested"))
    known = good.join(spread(suggested), ["organisation_number", "expected_url"], "left")
    exact = F.transform(F.filter("suggested", lambda s: s["exact"]), lambda s: s["id"])
    ids = F.array_sort(F.array_distinct(F.concat(F.filter(F.coalesce("company_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), F.coalesce(exact, F.array().cast("array<string>")))))
    base = known.select("organisation_number", "expected_url", "_query", ids.alias("_ids"))
    tried = base.select("organisation_number", "expected_url", F.posexplode("_ids").alias("at", "company_id")).select("*", F.concat(F.lit(f"{JOBS}f_C="), F.url_encode("company_id"), F.lit("&location=Norway&start=0")).alias("_request")).withColumn("stage", F.lit(0))
    paged = base.select("organisation_number", "expected_url", "_query", F.explode(F.sequence(F.lit(0), F.lit(max(1, search_pages) - 1))).alias("at")).select(
        "organisation_number", "expected_url", "at", F.lit(None).cast("string").alias("company_id"), F.concat(F.lit(f"{JOBS}keywords="), F.url_encode("_query"), F.lit("&location=Norway&start="), (c("at") * 10).cast("string")).alias("_request"), F.lit(1).alias("stage")
    )
    # Each different response is read once, for all that ask for it.
    asked = tried.unionByName(paged.select(tried.columns))
    read = durable(job_cards(bodies.join(spread(asked.select("_request").distinct()), "_request", "left_semi"), "_body").select("_request", "_sha", "cards", c("jobs").alias("found")))
    met = asked.join(spread(read), "_request").withColumn("exact", F.filter("found", lambda j: j["company_url"] == c("expected_url")))
    handle = ["organisation_number", "expected_url"]
    # The first id with postings of its own ends the ids; the first page that is empty or wasn't captured ends the pages.
    first_id = met.filter("stage = 0 and size(exact) > 0").groupBy(*handle).agg(F.min_by("company_id", "at").alias("confirmed_id"), F.min("at").alias("_last_id"))
    empty = asked.filter("stage = 1").join(spread(met.filter("stage = 1 and cards > 0").select(*handle, "at", F.lit(True).alias("_some"))), [*handle, "at"], "left").filter("_some is null").groupBy(*handle).agg(F.min("at").alias("_end"))
    seen = met.join(spread(first_id), handle, "left").join(spread(empty), handle, "left")
    seen = seen.filter((c("stage") == 0) & (c("at") <= F.coalesce("_last_id", c("at"))) | (c("stage") == 1) & (c("at") <= F.coalesce("_end", c("at"))))
    each = seen.select(*handle, "stage", "at", "company_id", "confirmed_id", "_sha", F.posexplode("exact").alias("place", "job"))
    once = keep_first_by(each.withColumn("_job", c("job.job_id")), ["organisation_number", "_job"], [c("stage"), c("at"), c("place")]).drop("_job")
    wanted = once.withColumn("_request", F.concat(F.lit(DETAIL), c("job.job_id")))
    details = markup.with_parts(bodies.join(spread(wanted.select("_request").distinct()), "_request", "left_semi"), "_body").select("_request", c("_sha").alias("detail_sha256"), detail_urls(c("links")).alias("_linked"))
    checked = wanted.join(spread(details), "_request", "left").withColumn("verified", F.coalesce(F.array_contains("_linked", c("expected_url")), F.lit(False)))
    span = F.array_join(F.filter(F.array("job.title", "job.company", "job.location"), lambda x: x != ""), " — ")
    out = checked.filter("verified").select(
        F.concat(F.lit("linkedin-guest-job-"), F.substring(F.sha2(F.concat("organisation_number", F.lit("|"), "job.job_id"), 256), 1, 24)).alias("id"), "organisation_number", c("_request").alias("source_url"), c("detail_sha256").alias("content_sha256"), span.alias("evidence_span"),
        "job.job_id", "job.title", "job.location", "job.date_posted", c("expected_url").alias("company_url"), c("confirmed_id").alias("linkedin_company_id"), *[F.lit(v).alias(k) for k, v in {"platform": "linkedin", "signal_type": "job_posting", "acquisition_mode": "jobspy_experiment", "rights_status": "experimental", "source_class": "job_board", "strategy": "jobs_feed_discovery"}.items()],
    )
    pages_read = seen.groupBy(*handle).agg(F.count("*").alias("pages_read"), F.sum("cards").alias("candidate_cards"))
    verified = checked.groupBy(*handle).agg(F.count_if("verified").alias("exact_jobs"), F.count_if(~c("verified")).alias("detail_errors"))
    number = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    told = rows.select("organisation_number", "expected_url", F.when(c("expected_url").isNull(), "invalid LinkedIn company handle").alias("error")).join(spread(first_id.drop("_last_id")), handle, "left").join(spread(pages_read), handle, "left").join(spread(verified), handle, "left")
    report = told.select("organisation_number", "expected_url", "error", "confirmed_id", *[number(c(x)).alias(x) for x in ("pages_read", "candidate_cards", "exact_jobs", "detail_errors")])
    return out, report


def search_results(payload: Column) -> Column:
    """SRC14: the results of a search provider's response, as JSON, in their rank: address, title, snippet; entries that aren't objects or have no address are left out but keep
    their rank."""
    listed = F.coalesce(F.try_variant_get(F.try_parse_json(payload), "$.web.results", "array<variant>"), F.array().cast("array<variant>"))
    one = lambda v, i: F.struct((i + 1).alias("rank"), graphs.text_at(v, "$.url").alias("url"), F.coalesce(graphs.text_at(v, "$.title"), F.lit("")).alias("title"), F.coalesce(graphs.text_at(v, "$.description"), F.lit("")).alias("snippet"))
    return F.filter(F.transform(listed, one), lambda r: F.coalesce(r["url"], F.lit("")) != "")


def legal_name_url(name: Column) -> Column:
    """The address that a company's page would have by its legal name; null for a name without letters and digits."""
    slug = F.array_join(text.map_tokens(name), "-")
    return F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/company/"), slug))


def _observed(rows: DataFrame, prefix: str, key: Column, signal: str, strategy: str, source: Column, span: Column, **metrics: Column) -> DataFrame:
    fixed = {"platform": "linkedin", "signal_type": signal, "strategy": strategy, "acquisition_mode": "unofficial_api_experiment", "rights_status": "experimental", "source_class": "professional_network"}
    name = F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", "organisation_number", key), 256), 1, 24))
    told = {"followers": "long", "employees": "long", "likes": "long", "comments": "long", "date_published": "string"}
    numbers = [metrics[m].alias(m) if m in metrics else F.lit(None).cast(kind).alias(m) for m, kind in told.items()]
    return rows.select(name.alias("id"), "organisation_number", source.alias("source_url"), "content_sha256", span.alias("evidence_span"), *numbers, F.lit(True).alias("exact_entity"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def handle_profiles(handles: DataFrame, companies: DataFrame, captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DRV2: of verified handles (``position, organisation_number, profile_url``) the observations of the pages behind them, and a row of outcome for each.

    ``companies`` have ``organisation_number, name, site_host``; ``captured`` is ``url, status, body``. A handle whose page is gone (404) is tried under the legal name once. A page counts
    only if its name or the site that it links back to is the company's, and once a company, for its first handle. It gives its metrics, its size if it tells any, and its posts.
    """
    c = F.col
    pages_ = captured.select(c("url").alias("_url"), c("status").alias("_status"), c("body").alias("_body"))
    asked = handles.withColumn("expected_url", company_url(c("profile_url"))).join(spread(companies), "organisation_number", "left").withColumn("_fallback", legal_name_url(c("name")))
    first = asked.join(spread(pages_), c("profile_url") == c("_url"), "left")
    # The legal name's address is looked up only for pages that are gone, and only if it is another page.
    again = first.filter((c("_status") == 404) & c("_fallback").isNotNull() & ~company_url(c("_fallback")).eqNullSafe(c("expected_url")))
    second = again.select("position", "_fallback").join(spread(pages_), c("_fallback") == c("_url"), "left").select("position", c("_status").alias("_status2"), c("_body").alias("_body2"))
    both = first.join(spread(second), "position", "left")
    body = F.when(c("_status") == 200, c("_body")).when(c("_status2") == 200, c("_body2"))
    got = both.select("position", "organisation_number", "name", "site_host", "profile_url", "expected_url", F.when(c("_status") == 200, c("profile_url")).when(c("_status2") == 200, c("_fallback")).alias("final_url"), body.alias("body"))
    read = profiles(got.withColumnsRenamed({"name": "_legal", "site_host": "_host"})).withColumn("content_sha256", F.sha2(F.coalesce("body", F.lit("")), 256))
    judged = read.withColumn("_i", profile_identity(c("_legal"), c("_host"), c("name"), c("website"), c("page_url")))
    outcome = F.when(c("body").isNull(), "not_captured").when(c("name").isNull(), "no_structured_profile").when(~c("_i.publishable_candidate"), "identity_not_established").otherwise("extracted")
    rows = judged.withColumn("outcome", outcome)
    place = F.row_number().over(Window.partitionBy("organisation_number", "page_url", "outcome").orderBy("position"))
    rows = rows.withColumn("outcome", F.when((c("outcome") == "extracted") & (place > 1), "duplicate").otherwise(c("outcome"))).drop("body")
    good = rows.filter("outcome = 'extracted'")
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    metrics = _observed(good, "linkedin-profile-", F.concat("expected_url", F.lit("|profile")), "profile_metrics", "social_profile_metrics", c("final_url"), F.concat("name", F.lit(" — "), shown(c("followers")), F.lit(" followers — "), shown(c("visible_employees")), F.lit(" visible employee profiles")), followers=c("followers"), employees=c("visible_employees"))
    sized = good.filter("visible_employees is not null or employee_size_label is not null")
    staff = _observed(sized, "linkedin-workforce-", F.concat("expected_url", F.lit("|workforce")), "workforce_snapshot", "linkedin_workforce_snapshot", c("final_url"), F.concat(F.lit("LinkedIn structured company profile reports "), shown(c("visible_employees")), F.lit(" associated employee profiles and size "), shown(c("employee_size_label")), F.lit(".")), employees=c("visible_employees"))
    posts = good.select("organisation_number", "content_sha256", F.explode("posts").alias("p")).filter("p.url <> '' and p.text <> ''")
    said = _observed(posts, "linkedin-post-", c("p.url"), "public_post", "social_profile_metrics", c("p.url"), c("p.text"), likes=c("p.likes").cast("long"), comments=c("p.comments").cast("long"), date_published=c("p.date_published"))
    return metrics.unionByName(staff).unionByName(said), rows.select("position", "organisation_number", "expected_url", "outcome", "page_url", "followers", F.size("posts").alias("posts"))


def discovered_handles(companies: DataFrame, captured: DataFrame, fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """DRV4: network pages of companies that nobody linked: those that the search box suggests under exactly the name lead to candidates, by the name's own address and by the postings of
    every suggested id, however many there are, and the first candidate that is exactly the company is taken.

    ``companies`` are ``position, organisation_number, name, municipality, site_host, aliases, leaders``; aliases are asked for only if ``fuzzy``. Returns the handles, and a row for each
    company with what was suggested, tried and taken.
    """
    c = F.col
    full = text.full_name
    bodies = captured.select(c("url").alias("_request"), c("body").alias("_body"))
    names = F.concat(F.array(F.struct(F.lit(0).alias("n"), c("name").alias("query"), F.lit(False).alias("alias"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a, i: F.struct((i + 1).alias("n"), a.alias("query"), F.lit(True).alias("alias"))) if fuzzy else F.array().cast("array<struct<n:int,query:string,alias:boolean>>"))
    asked = companies.select("organisation_number", F.explode(names).alias("q")).select("organisation_number", "q.*")
    heard = asked.join(spread(bodies), F.concat(F.lit(TYPEAHEAD), F.url_encode("query")) == c("_request"))
    suggested = heard.select("organisation_number", "n", "query", "alias", F.posexplode(F.filter(typeahead(c("_body"), c("query")), lambda s: full(s["name"]) == full(c("query")))).alias("at", "s"))
    exact = durable(suggested.select("organisation_number", "n", "at", "query", "alias", c("s.id").alias("company_id")))
    # Only companies that are suggested at all have candidates; the ids come in the order of the names asked for and of their answers.
    known = exact.groupBy("organisation_number").agg(F.array_sort(F.collect_set("company_id")).alias("company_ids"), F.count("*").alias("suggested"))
    own = asked.join(spread(known), "organisation_number").select("organisation_number", F.lit(0).alias("stage"), "n", F.lit(0).alias("at"), F.lit(0).alias("link"), F.coalesce(company_url(legal_name_url(c("query"))), legal_name_url(c("query"))).alias("url"), F.when(c("alias"), F.concat(F.lit("official_site_alias:"), "query")).otherwise("legal_name_slug").alias("source"))
    jobs_ = exact.withColumn("_request", F.concat(F.lit(f"{JOBS}f_C="), F.url_encode("company_id"), F.lit("&location=Norway&start=0")))
    linked = job_cards(bodies.join(spread(jobs_.select("_request").distinct()), "_request", "left_semi"), "_body").select("_request", F.array_distinct(F.filter(F.transform("jobs", lambda j: j["company_url"]), lambda u: u.isNotNull())).alias("_urls"))
    by_job = jobs_.join(spread(linked), "_request").select("organisation_number", "n", "at", "alias", "query", F.posexplode("_urls").alias("link", "url"))
    sources = F.array_compact(F.array(F.lit("company_id_job_link"), F.when(c("alias"), F.concat(F.lit("official_site_alias:"), "query"))))
    through = by_job.select("organisation_number", F.lit(1).alias("stage"), "n", "at", "link", "url", F.explode(sources).alias("source"))
    met = durable(own.unionByName(through).filter("url is not null").groupBy("organisation_number", "url").agg(F.min(F.struct("stage", "n", "at", "link")).alias("first"), F.array_sort(F.collect_set("source")).alias("sources")))
    pages_ = profiles(met.join(spread(bodies), c("url") == c("_request")).withColumnRenamed("_body", "body").drop("_request").withColumnRenamed("url", "candidate_url"))
    said = F.concat_ws(" ", "description", F.array_join(F.transform("posts", lambda p: p["text"]), " "))
    facts = pages_.filter("name is not null").select("organisation_number", "candidate_url", "first", "sources", "page_url", F.sha2("body", 256).alias("content_sha256"), c("name").alias("found_name"), c("website").alias("found_site"), F.coalesce("headquarters", F.lit("")).alias("found_place"), said.alias("found_text"), F.array_contains("sources", "company_id_job_link").alias("by_job_link"))
    alias = F.transform(F.filter("sources", lambda s: F.startswith(s, F.lit("official_site_alias:"))), lambda s: F.substring_index(s, "official_site_alias:", -1))
    judged = discovery_identity(facts.join(spread(companies.drop("aliases")), "organisation_number").withColumn("aliases", alias))
    taken = judged.filter("exact_entity").groupBy("organisation_number").agg(F.min_by(F.struct("candidate_url", F.coalesce("page_url", "candidate_url").alias("resolved_url"), "content_sha256"), "first").alias("t"))
    rows = companies.select("position", "organisation_number").join(spread(known), "organisation_number", "left").join(spread(met.groupBy("organisation_number").agg(F.count("*").alias("candidates"))), "organisation_number", "left").join(spread(taken), "organisation_number", "left")
    fixed = {"platform": "linkedin", "signal_type": "profile_handle", "acquisition_mode": "unofficial_api_experiment", "rights_status": "experimental", "source_class": "professional_network", "strategy": "verified_handle_extraction"}
    found = rows.filter("t is not null")
    handles = found.select(F.concat(F.lit("linkedin-discovered-handle-"), F.substring(F.sha2(F.concat_ws("|", "organisation_number", "t.resolved_url"), 256), 1, 24)).alias("id"), "organisation_number", c("t.resolved_url").alias("profile_url"), "company_ids", c("t.content_sha256").alias("content_sha256"), F.lit(True).alias("exact_entity"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    number = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return handles, rows.select("position", "organisation_number", number("suggested"), number("candidates"), c("t.resolved_url").alias("accepted_url"))
