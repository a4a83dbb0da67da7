"""Sites found by search, seeds and handles, pages and postings of a network, on captured responses."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from heddle.operators import discovery, guest

PROFILE = "organisation_number string, name string, municipality string, website string"


def test_search_queries_need_name_and_number(spark):
    ask = lambda *v: spark.createDataFrame([v], "a string, b string, c string").select(discovery.search_query(F.col("a"), F.col("b"), F.col("c"))).head()[0]
    assert ask(" Fjord  Kraft AS", "912 345 678", " Nore  og Uvdal ") == '"Fjord Kraft AS" 912345678 Nore og Uvdal' and ask("F", "1", None) == '"F" 1'
    for bad in ((None, "1", "x"), ("F", "abc", "x"), (" ", "1", "")):
        with pytest.raises(Exception, match="requires a legal name"):
            ask(*bad)


def test_sites_are_found_and_judged_by_their_own_pages(spark):
    profiles = spark.createDataFrame([("912345678", "Fjord Kraft AS", "BERGEN", None), ("812345678", "Nord Fisk AS", "BODØ", " "), ("712345678", "Vest Bygg AS", "OSLO", None), ("612345678", "Sør Mat AS", "MANDAL", ""), ("512345678", "Har Side AS", "OSLO", "har.no"), ("412345678", "Ingen Treff AS", "OSLO", None)], PROFILE)
    results = spark.createDataFrame(
        [
            ("912345678", 1, "https://www.proff.no/fjord", "Fjord Kraft AS 912345678", "Bergen"), ("912345678", 2, "fjordkraft.no", "Fjord Kraft", "strøm i Bergen"), ("912345678", 3, "https://fjordkraft.no/om?x=1", "Fjord Kraft", "Bergen"),
            ("812345678", 1, "https://nordfisk.no", "Nord Fisk", ""), ("712345678", 1, "https://vestbygg.no/", "Vest Bygg", ""), ("612345678", 1, "https://soermat.no/", "Noe annet", ""), ("412345678", 1, None, None, None), ("x", 1, "https://x.no", "", ""),
        ], "organisation_number string, rank int, url string, title string, snippet string",
    )
    html = lambda t, more="": f"<title>{t}</title><p>{'vi selger og leverer ' * 8}</p>{more}"
    page = lambda u, body, kind="homepage", code=200: (u, u, code, "text/html", kind, "t1", body)
    fetched = spark.createDataFrame(
        [page("https://fjordkraft.no", html("Fjord Kraft", "<a href='https://x.com/fjordkraft'>x</a><a href='https://facebook.com/annet'>f</a>")), page("https://nordfisk.no", html("Domain for sale")), page("https://vestbygg.no/", "x", code=500)],
        "requested_url string, final_url string, status_code int, content_type string, page_kind string, retrieved_at string, body string",
    ).withColumn("organisation_number", F.lit(None).cast("string"))
    told, counts = discovery.discovered(profiles, results, fetched)
    got = {r.organisation_number: r for r in told.collect()}
    assert {k: (r.candidates, r.selected_url, r.outcome, r.website) for k, r in got.items()} == {
        "912345678": (3, "https://fjordkraft.no", "verified", "https://fjordkraft.no"), "812345678": (1, "https://nordfisk.no", "quarantined", None), "712345678": (1, "https://vestbygg.no/", "quarantined", None),
        "612345678": (1, None, "abstained_before_crawl", None), "412345678": (1, None, "abstained_before_crawl", None),
    }
    assert [tuple(x) for x in got["912345678"].social_links] == [("x", "https://x.com/fjordkraft")]
    assert counts.head().asDict() == {"queried": 5, "abstained_before_crawl": 2, "not_captured": 0, "verified_sites": 1, "quarantined_sites": 2, "registry_website_present_skipped": 1}
    assert {r.organisation_number for r in discovery.discovered(profiles, results, fetched, limit=2)[0].collect()} == {"412345678", "612345678"}


def test_observations_of_profiles(spark):
    profiles = spark.createDataFrame([("1",), ("2",)], "organisation_number string")
    seen = spark.createDataFrame([("1", "b", 1), ("1", "a", 2), ("1", "a", 1), ("1", None, 1), ("9", "c", 1)], "organisation_number string, id string, v int")
    got = {r.organisation_number: [(o.id, o.v) for o in r.external_observations] for r in discovery.with_observations(profiles, seen).collect()}
    assert got == {"1": [("a", 1), ("b", 1)], "2": []}


def test_seeds_replace_websites_or_fail(spark):
    profiles = spark.createDataFrame([("1", "old.no"), ("2", "b.no")], "organisation_number string, website string")
    seeds = lambda *rows: spark.createDataFrame(rows, "organisation_number string, website string, proof_url string, proof string")
    got = {r.organisation_number: r for r in discovery.with_seeds(profiles, seeds(("1", " https://new.no ", "https://p.no", None))).collect()}
    assert (got["1"].website, got["1"].website_seed_source, tuple(got["1"].website_seed_proof)) == ("https://new.no", "independently_verified_exact_entity", ("https://p.no", "")) and (got["2"].website, got["2"].website_seed_proof) == ("b.no", None)
    for rows, fault in (([("7", "https://x", "https://p", "")], "unknown organisations: 7"), ([("1", "x.no", "https://p", "")], "absolute website"), ([("1", "https://x", None, "")], "absolute website"), ([("1", "https://x", "https://p", ""), ("1", "https://y", "https://p", "")], "twice: 1")):
        with pytest.raises(Exception, match=fault):
            discovery.with_seeds(profiles, seeds(*rows)).collect()


def test_candidates_without_a_handle(spark):
    of = lambda *k: spark.createDataFrame([(x,) for x in k], "organisation_number string")
    handles = spark.createDataFrame([("1", "youtube"), ("2", "x")], "organisation_number string, platform string")
    assert sorted(r[0] for r in discovery.without_handle(of("1", "2", "3", "4"), handles, "youtube", of("2", "3", "9")).collect()) == ["2", "3"]
    assert sorted(r[0] for r in discovery.without_handle(of("1", "2"), handles, "youtube").collect()) == ["2"]


def test_aliases_and_leaders(spark):
    r = spark.createDataFrame([("Fjord Kraft AS", ["Fjordkraft | Strøm", "Velkommen – x", "Fjord Kraft AS", "ab", "Kraftlaget", "Kraftlaget — om", "C side", None, "D side"], [("Ola", "DAGL"), ("Kari", "MEDL"), ("", "LEDE"), ("Per", "INNH")])], "n string, t array<string>, r array<struct<name:string,role_code:string>>")
    got = r.select(discovery.site_aliases(F.col("n"), F.col("t")).alias("a"), discovery.leaders(F.col("r")).alias("l")).head()
    assert (got.a, got.l) == (["Fjordkraft", "Kraftlaget", "C side"], ["Ola", "Per"])


def test_pages_of_platforms_are_a_companys_by_pairs_of_facts(spark):
    schema = "name string, municipality string, site_host string, aliases array<string>, leaders array<string>, found_name string, found_site string, found_place string, found_text string, by_job_link boolean"
    base = dict(name="Fjord Kraft AS", municipality="BERGEN", site_host="fjord.no", aliases=[], leaders=["Ola Nord"], found_name="Annet", found_site="https://a.no", found_place="Oslo", found_text="", by_job_link=False)
    cases = [
        ({}, False), ({"found_name": "FJORD KRAFT"}, False), ({"found_name": "Fjord Kraft", "found_site": "www.fjord.no/x"}, True), ({"aliases": ["Kraftlaget"], "found_name": "Kraftlaget AS", "found_site": "fjord.no"}, True),
        ({"found_name": "fjord kraft as", "found_place": "Sentrum, Bergen, NO"}, True), ({"found_name": "fjord kraft as", "by_job_link": True}, True), ({"found_name": "fjord kraft", "by_job_link": True}, False),
        ({"aliases": ["Kraftlaget"], "found_name": "Kraftlaget", "found_place": "Bergen", "found_text": "Vår leder Ola Nord sier"}, True), ({"aliases": ["Kraftlaget"], "found_name": "Kraftlaget", "found_place": "Bergen"}, False), ({"aliases": None, "leaders": None, "found_site": None, "site_host": None}, False),
    ]
    rows = spark.createDataFrame([tuple((base | c)[f.split()[0]] for f in schema.split(", ")) for c, _ in cases], schema)
    assert [r.exact_entity for r in discovery.discovery_identity(rows).collect()] == [x for _, x in cases]
    one = lambda *v: spark.range(1).select(discovery.profile_identity(*[F.lit(x).cast("string") for x in v]).alias("x")).head().x
    assert one("Fjord AS", "fjord.no", "FJORD ASA", None, "u").publishable_candidate and one("Fjord AS", "fjord.no", "Annet", "http://www.fjord.no/om", "u").publishable_candidate
    assert not one("Fjord AS", "fjord.no", "Fjord", "fjord.no", None).publishable_candidate and not one("Fjord AS", None, "Annet", None, "u").publishable_candidate


def test_addresses_of_companies(spark):
    cases = {"https://no.linkedin.com/company/Fjord-Kraft/about?x": "https://linkedin.com/company/fjord-kraft", "https://linkedin.com/company/%C3%85s%20AS": "https://linkedin.com/company/%C3%A5s%20as", "https://linkedin.com/in/ola": None, "https://linkedin.com/company/": None, "https://notlinkedin.com/company/x": None, "": None, None: None}
    got = {r.u: r.x for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", guest.company_url(F.col("u")).alias("x")).collect()}
    assert got == cases


def test_company_pages_are_read(spark):
    graph = [{"@type": "Organization", "name": "Old"}, {"@type": "Organization", "name": "Fjord", "url": "https://no.linkedin.com/company/FJORD", "numberOfEmployees": {"value": "1 234"}, "description": "Kraft"},
             {"@type": "DiscussionForumPosting", "url": "https://l.com/posts/x-activity-77-y", "datePublished": "d", "text": " Hei ", "author": {"url": "https://linkedin.com/company/fjord"}},
             {"@type": "DiscussionForumPosting", "mainEntityOfPage": "https://l.com/posts/activity-88", "author": {"url": "https://linkedin.com/company/fjord"}}, {"@type": "DiscussionForumPosting", "url": "u", "author": {"url": "https://linkedin.com/company/other"}}]
    html = f"""<meta name="description" content="Fjord | 12,345 followers on L"><script type="application/ld+json">{json.dumps({"@graph": graph})}</script><script type="application/ld+json">bad</script>
    <a href="/jobs?facetCurrentCompany=%5B42%2C7%5D&x">j</a><a href="/jobs?facetCurrentCompany%3D%255B7%252C9%255D">j</a>
    <div data-test-id="about-us__size"><dt>Size</dt><dd>51-200 </dd></div><div data-test-id="about-us__website"><dt>Web</dt><dd><a href="r?u=x">https://fjord.no</a></dd></div><div data-test-id="about-us__industry">Energy</div>
    <article class="x main-feed-activity-card" data-activity-urn="urn:li:activity:77"><p>t</p><a data-test-id="social-actions__reactions" data-num-reactions="5">5</a><a data-test-id="social-actions__comments" data-num-comments="2">2</a></article>"""
    rows = spark.createDataFrame([("a", html), ("b", "<p>login</p>"), ("c", None)], "url string, body string")
    got = {r.url: r for r in guest.profiles(rows).collect()}
    r = got["a"]
    assert (r.name, r.page_url, r.linkedin_organisation_ids, r.followers, r.visible_employees) == ("Fjord", "https://linkedin.com/company/fjord", ["7", "9", "42"], 12345, 1234)
    assert (r.employee_size_label, r.website, r.industry, r.headquarters, r.description) == ("51-200", "https://fjord.no", "Energy", None, "Kraft")
    assert [tuple(p) for p in r.posts] == [("https://l.com/posts/x-activity-77-y", "d", "Hei", 5, 2), ("https://l.com/posts/activity-88", None, "", 0, 0)]
    assert got["b"].name is None and got["c"].name is None and got["c"].posts == [] and got["b"].followers is None


def card(number, company, title="T", place="Oslo", day="2024-01-01", urn=True):
    urn_part = f' data-entity-urn="urn:li:jobPosting:{number}"' if urn else ""
    return f'<div class="base-card base-search-card"{urn_part}><a class="base-card__full-link" href="https://l.com/jobs/view/x-{number}?a"><span class="sr-only">{title}</span></a><h4 class="base-search-card__subtitle"><a href="https://no.linkedin.com/company/{company}?t">{company.title()}</a></h4><span class="job-search-card__location">{place}</span><time datetime="{day}"></time></div>'


def test_postings_of_exactly_the_company(spark):
    ask = lambda q: guest.TYPEAHEAD + q
    by_id = lambda i: f"{guest.JOBS}f_C={i}&location=Norway&start=0"
    page = lambda q, n: f"{guest.JOBS}keywords={q}&location=Norway&start={n}"
    captured = {
        ask("fjord"): json.dumps([{"type": "COMPANY", "id": "20", "displayName": "Fjord AS"}, {"type": "COMPANY", "id": "30", "displayName": "Fjord Inn"}, {"type": "TITLE", "id": "40", "displayName": "Fjord"}]),
        by_id("10"): card(111111, "other"), by_id("20"): card(222222, "fjord", "Leder") + card(333333, "other") + card(222222, "fjord", "Again"), by_id("30"): card(999999, "fjord"),
        page("fjord", 0): card(222222, "fjord", "Later") + card(444444, "Fjord", urn=False) + card(55, "fjord"), page("fjord", 10): "<p>none</p>", page("fjord", 20): card(666666, "fjord"),
        guest.DETAIL + "222222": '<a href="https://www.linkedin.com/company/fjord/?x">c</a>', guest.DETAIL + "444444": '<a href="https://www.linkedin.com/company/other">c</a>',
        page("nord+fisk", 0): card(777777, "nordfisk"), guest.DETAIL + "777777": '<a href="https://www.linkedin.com/company/nordfisk">c</a>', ask("nord+fisk"): "not json",
    }
    bodies = spark.createDataFrame([(u, b) for u, b in captured.items()], "url string, body string").withColumn("content_sha256", F.sha2("body", 256))
    handles = spark.createDataFrame([("1", "Fjord AS", "https://linkedin.com/company/Fjord/", ["10", "", None]), ("2", "Nord Fisk AS", "https://linkedin.com/company/nordfisk", None), ("3", "X", "https://x.com/x", None), ("4", "Tom AS", "https://linkedin.com/company/tom", [])], "organisation_number string, name string, profile_url string, company_ids array<string>")
    found, report = guest.jobs(handles, bodies)
    got = {r.job_id: r for r in found.collect()}
    assert {k: (r.organisation_number, r.title, r.evidence_span, r.linkedin_company_id) for k, r in got.items()} == {"222222": ("1", "Leder", "Leder — Fjord — Oslo", "20"), "777777": ("2", "T", "T — Nordfisk — Oslo", None)}
    assert got["222222"].source_url == guest.DETAIL + "222222"
    assert {r.organisation_number: (r.error, r.confirmed_id, r.pages_read, r.candidate_cards, r.exact_jobs, r.detail_errors) for r in report.collect()} == {
        "1": (None, "20", 4, 1 + 3 + 3 + 0, 1, 1), "2": (None, None, 1, 1, 1, 0), "3": ("invalid LinkedIn company handle", None, 0, 0, 0, 0), "4": (None, None, 0, 0, 0, 0),
    }


def test_results_of_a_provider(spark):
    body = json.dumps({"web": {"results": [{"url": "u1", "title": "T"}, "x", {"title": "no url"}, {"url": "u4", "description": "S"}]}})
    rows = spark.createDataFrame([(body,), ("no",), (None,), ('{"web":null}',)], "b string").select(guest.search_results(F.col("b")).alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in rows] == [[(1, "u1", "T", ""), (4, "u4", "", "S")], [], [], []]


def page_of(name, url, site=None, staff=None, place=None, about="", posts=()):
    graph = [{"@type": "Organization", "name": name, "url": url, "description": about} | ({"numberOfEmployees": {"value": staff}} if staff else {})] + [{"@type": "DiscussionForumPosting", "url": u, "text": t, "author": {"url": url}} for u, t in posts]
    extra = (f'<div data-test-id="about-us__website"><dd><a href="x">{site}</a></dd></div>' if site else "") + (f'<div data-test-id="about-us__headquarters"><dd>{place}</dd></div>' if place else "")
    return f'<meta name="description" content="{name} | 12 followers"><script type="application/ld+json">{json.dumps({"@graph": graph})}</script>{extra}'


def test_pages_behind_handles(spark):
    link = lambda x: f"https://www.linkedin.com/company/{x}"
    handles = [(0, "1", link("fjord")), (1, "1", link("FJORD")), (2, "2", link("gone")), (3, "3", link("other")), (4, "4", link("none")), (5, "5", link("login")), (6, "6", link("site"))]
    names = [("1", "Fjord AS", None), ("2", "Nord Ås AS", None), ("3", "Vest AS", "vest.no"), ("4", "X AS", None), ("5", "Y AS", None), ("6", "Z AS", "z.no")]
    captured = [
        (link("fjord"), 200, page_of("FJORD", link("fjord"), staff=5, posts=[("https://l/activity-1", "Hei"), ("", "x"), ("https://l/activity-2", "")])), (link("FJORD"), 200, page_of("Fjord", link("fjord"))), (link("gone"), 404, ""), (link("nord-as-as"), 200, page_of("Nord Ås", link("nord"))),
        (link("other"), 200, page_of("Annet", link("other"), site="https://annet.no")), (link("login"), 200, "<p>log in</p>"), (link("site"), 200, page_of("Zeta", link("site"), site="www.z.no/om")),
    ]
    out, told = guest.handle_profiles(spark.createDataFrame(handles, "position int, organisation_number string, profile_url string"), spark.createDataFrame(names, "organisation_number string, name string, site_host string"), spark.createDataFrame(captured, "url string, status int, body string"))
    assert [r.outcome for r in told.orderBy("position").collect()] == ["extracted", "duplicate", "extracted", "identity_not_established", "not_captured", "no_structured_profile", "extracted"]
    got = sorted((r.organisation_number, r.signal_type, r.evidence_span) for r in out.collect())
    assert got == [
        ("1", "profile_metrics", "FJORD — 12 followers — 5 visible employee profiles"), ("1", "public_post", "Hei"), ("1", "workforce_snapshot", "LinkedIn structured company profile reports 5 associated employee profiles and size None."),
        ("2", "profile_metrics", "Nord Ås — 12 followers — None visible employee profiles"), ("6", "profile_metrics", "Zeta — 12 followers — None visible employee profiles"),
    ]


def test_handles_that_nobody_linked(spark):
    link = lambda x: f"https://linkedin.com/company/{x}"
    suggest = lambda *items: json.dumps([{"type": "COMPANY", "id": i, "displayName": n} for i, n in items])
    by_id = lambda i: f"{guest.JOBS}f_C={i}&location=Norway&start=0"
    companies = [(0, "1", "Fjord Kraft AS", "BERGEN", "fjord.no", [], []), (1, "2", "Nord AS", "OSLO", None, ["Nordlaget"], ["Ola Nord"]), (2, "3", "Ingen AS", "OSLO", None, [], []), (3, "4", "Vest AS", "OSLO", None, [], []), (4, "5", "Øst AS", "Oslo", None, [], [])]
    captured = {
        guest.TYPEAHEAD + "Fjord+Kraft+AS": suggest(("10", "FJORD kraft as"), ("11", "Fjord Kraft")), link("fjord-kraft-as"): page_of("Fjord Kraft", link("fjord-kraft-as"), site="https://fjord.no"),
        guest.TYPEAHEAD + "Nord+AS": suggest(("20", "Nord AS")), by_id("20"): card(222222, "nordnorge") + card(222223, "nord"), link("nord-as"): page_of("Annet", link("nord-as")), link("nordnorge"): page_of("Nord AS", link("nordnorge")), link("nord"): page_of("Nord AS", link("nord")),
        guest.TYPEAHEAD + "Nordlaget": suggest(("21", "Nordlaget")), guest.TYPEAHEAD + "Vest+AS": suggest(("40", "Vest Inn")), guest.TYPEAHEAD + "%C3%98st+AS": suggest(("50", "Øst AS")), link("ost-as"): page_of("Øst AS", link("ost"), place="Sentrum, Oslo"),
    }
    bodies = spark.createDataFrame(list(captured.items()), "url string, body string")
    rows = spark.createDataFrame(companies, "position int, organisation_number string, name string, municipality string, site_host string, aliases array<string>, leaders array<string>")
    handles, told = guest.discovered_handles(rows, bodies)
    assert [(r.suggested, r.candidates, r.accepted_url) for r in told.orderBy("position").collect()] == [(1, 1, link("fjord-kraft-as")), (1, 3, link("nordnorge")), (0, 0, None), (0, 0, None), (1, 1, link("ost"))]
    got = {r.organisation_number: (r.profile_url, r.company_ids) for r in handles.collect()}
    assert got == {"1": (link("fjord-kraft-as"), ["10"]), "2": (link("nordnorge"), ["20"]), "5": (link("ost"), ["50"])}
    fuzzy = guest.discovered_handles(rows, bodies, fuzzy=True)[1].orderBy("position").collect()
    assert (fuzzy[1].suggested, fuzzy[1].candidates) == (2, 4)


def test_all_suggested_ids_are_followed(spark):
    """Not only the first two: candidates of later ids are counted, the first exact one is taken, and an alias comes behind all ids of the name."""
    link = lambda x: f"https://linkedin.com/company/{x}"
    by_id = lambda i: f"{guest.JOBS}f_C={i}&location=Norway&start=0"
    suggest = lambda name, ids: json.dumps([{"type": "COMPANY", "id": str(i), "displayName": name} for i in ids])
    companies = [(0, "1", "Fjord AS", "BERGEN", None, [], []), (1, "2", "Nord AS", "OSLO", None, ["Nordlaget"], []), (2, "3", "Vest AS", "OSLO", None, [], [])]
    captured = {guest.TYPEAHEAD + "Fjord+AS": suggest("Fjord AS", range(100, 112)), guest.TYPEAHEAD + "Nord+AS": suggest("Nord AS", (200, 201, 202)), guest.TYPEAHEAD + "Nordlaget": suggest("Nordlaget", (210,)), guest.TYPEAHEAD + "Vest+AS": suggest("Vest AS", (300, 301, 302))}
    captured |= {by_id(100 + i): card(1000000 + i, f"f{i}") for i in range(12)} | {link(f"f{i}"): page_of("Fjord AS" if i in (7, 9) else "Annet", link(f"f{i}")) for i in range(12)}
    captured |= {by_id(202): card(2000002, "n2"), by_id(210): card(2000010, "n10"), link("n2"): page_of("Nord AS", link("n2")), link("n10"): page_of("Nord AS", link("n10"))}
    captured |= {by_id(i): card(3000000 + i, "v") for i in (300, 301)} | {by_id(302): "<p>none</p>", link("v"): page_of("Annet", link("v"))}
    bodies = spark.createDataFrame(list(captured.items()), "url string, body string")
    rows = spark.createDataFrame(companies, "position int, organisation_number string, name string, municipality string, site_host string, aliases array<string>, leaders array<string>")
    told = lambda fuzzy: [(r.suggested, r.candidates, r.accepted_url) for r in guest.discovered_handles(rows, bodies, fuzzy)[1].orderBy("position").collect()]
    # The name's own address is a candidate besides those of the ids.
    assert told(False) == [(12, 13, link("f7")), (3, 2, link("n2")), (3, 2, None)]
    assert told(True) == [(12, 13, link("f7")), (4, 4, link("n2")), (3, 2, None)]
