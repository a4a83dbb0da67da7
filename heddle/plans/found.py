"""What captured pages and results say, over the driver's pages and over pages, graphs and results made of its rows; the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import graphs, urls
from heddle.operators import discovery, guest
from heddle.operators import pages as markup
from heddle.plans.base import OBSERVATIONS_SQL, observations
from heddle.registry import query
from heddle.session import table

_PLAIN = lambda x: f"trim(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\n]+', ' ', 'g'))"


@query(
    "page_parts",
    f"""with p as (select page_id, {_PLAIN("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} as title, {_PLAIN("regexp_extract(html, '<article>(.*)</article>', 1, 's')")} as main,
  {_PLAIN("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} as identity, len(regexp_extract_all(html, '<a href=')) as links from pages)
select page_id, title, length(main) as main_chars, sha256(main) as main_sha256, identity, links, 'static_complete' as state from p""",
)
def page_parts(spark, sf_dir):
    """SCA40, UDF2: the parts of every page, by one pass over its markup."""
    p = markup.with_parts(table(spark, sf_dir, "pages"))
    return p.select("page_id", "title", F.length("main_text").cast("bigint").alias("main_chars"), F.sha2("main_text", 256).alias("main_sha256"), F.col("identity_text").alias("identity"), F.size("links").cast("bigint").alias("links"), markup.extraction_state(F.col("main_text"), F.col("scripts")).alias("state"))


#: What some pages have besides: how often, and the markup, with the page's number for {k}.
_MORE = [
    (5, 0, '<a href="https://no.linkedin.com/company/f{k}/about?x=1">a</a>', "linkedin", "https://linkedin.com/company/f{k}"),
    (4, 1, "<iframe src='https://www.facebook.com/plugins/page.php?href=https%3A%2F%2Fwww.facebook.com%2Ff{k}&amp;w=1'></iframe>", "facebook", "https://facebook.com/f{k}"),
    (3, 2, '<div data-href="//instagram.com/i{k}/"></div>', "instagram", "https://instagram.com/i{k}"),
    (7, 3, '<script type="application/ld+json">{"@graph":[{"@type":"Store","sameAs":["https://x.com/x{k}","nope"]}]}</script>', "x", "https://x.com/x{k}"),
    (2, 0, '<a href="https://facebook.com/sharer/{k}">s</a><!-- <a href="https://x.com/no">c</a> -->', None, None),
    (6, 1, "<a href=https://youtube.com/@y{k}/videos>y</a>", "youtube", "https://youtube.com/@y{k}"),
]


def _more():
    k = F.col("page_id")
    filled = lambda t: F.replace(F.lit(t), F.lit("{k}"), k.cast("string"))
    return F.concat(F.col("html"), *[F.when(k % n == r, filled(t)).otherwise("") for n, r, t, *_ in _MORE])


_MORE_SQL = "list_sort(list_filter([" + ", ".join(f"case when page_id % {n} = {r} then '{platform} ' || replace('{url}', '{{k}}', cast(page_id as varchar)) end" for n, r, _, platform, url in _MORE if platform) + "], lambda x: x is not null))"


@query("page_social_links", f"select page_id, array_to_string({_MORE_SQL}, ', ') as links from pages")
def page_social_links(spark, sf_dir):
    """SCA16: profiles that pages link, embed, or name in JSON-LD."""
    p = markup.with_parts(table(spark, sf_dir, "pages").select("page_id", "url", _more().alias("html")))
    found = F.array_sort(F.array_union(markup.social_links(F.col("url"), F.col("links"), F.col("embedded")), markup.structured_links(F.col("json_ld"), graphs.nodes)))
    return p.select("page_id", F.array_join(F.transform(found, lambda x: F.concat_ws(" ", x["platform"], x["url"])), ", ").alias("links"))


_TERMS = ["about", "kontakt", "team", "news", "none"]


@query(
    "page_priority_links",
    f"""with p as (select page_id, regexp_extract(lower(url), '^([a-z]+://[^/?#]*)', 1) as origin, page_id % 5 as r, [{", ".join(f"'{t}'" for t in _TERMS)}] as t from pages),
l as (select page_id, 0 as rank, origin || '/om-oss/' || page_id as link from p where page_id % 2 = 0 union all select page_id, 2, origin || '/about/x' from p where r = 0 union all select page_id, 3, origin || '/kontakt/x' from p where r = 1
  union all select page_id, 7, origin || '/team/x' from p where r = 2 union all select page_id, 13, origin || '/news/x' from p where r = 3 union all select page_id, 5, origin || '/side' from p where page_id % 3 = 0)
select page_id, coalesce(array_to_string(list(link order by rank, link) filter (where link is not null), ' '), '') as links from p left join l using (page_id) group by 1""",
)
def page_priority_links(spark, sf_dir):
    """TOP5: links to a site's own pages about the company, quoted in any way, by path or by label."""
    k = F.col("page_id")
    term = F.get(F.array(*map(F.lit, _TERMS)), (k % 5).cast("int"))
    added = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("<a class=x href='/om-oss/"), k.cast("string"), F.lit("?a=1#b'>x</a>"))).otherwise(""), F.lit("<a href=\"/"), term, F.lit("/x\">y</a><a href='https://elsewhere.example.org/about'>about</a>"),
        F.when(k % 3 == 0, "<a href=/side>Our <b>Ledelse</b></a><a href=/side?x>News</a>").otherwise(""),
    )
    p = markup.with_parts(table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.lower("url"), "^([a-z]+://[^/?#]*)", 1).alias("url"), added.alias("html")))
    return p.select("page_id", F.array_join(markup.priority_links(F.col("url"), F.col("links")), " ").alias("links"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '')"


@query(
    "crawl_evidence",
    f"""with e as (select {_HOST} as org, page_id, url, html, page_id % 3 = 0 as home, case when page_id % 11 = 0 then 404 when page_id % 13 = 0 then 500 else 200 end as code, page_id % 17 = 0 as pdf from pages),
s as (select *, case code when 404 then 'not_found' when 500 then 'source_error' else case when pdf then 'source_error' else 'available' end end as status, case when code <> 200 then 'HTTP ' || code when pdf then 'Unsupported content type: application/pdf' end as error from e),
h as (select org, arg_max(status, page_id) as status, arg_max(url, page_id) as url, arg_max(error, page_id) as error, arg_max(html, page_id) as html from s where home group by 1),
g as (select org, count(distinct url) filter (where status = 'available') as pages, count(*) filter (where status <> 'available') as errors from s group by 1)
select g.org as organisation_number, coalesce(h.status, 'not_found') as status, h.url as source_url, case when h.org is null then 'No homepage crawl event was produced' when h.status = 'available' then 'Company-controlled claim layer; not an official registry fact' else h.error end as note,
  case when h.status = 'available' then {_PLAIN("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} end as title, case when h.status = 'available' then pages end as pages, case when h.status = 'available' then errors end as errors from g left join h using (org)""",
)
def crawl_evidence(spark, sf_dir):
    """SCA41, JN9: pages as a crawl's events, merged into one record a host."""
    k = F.col("page_id")
    fetched = table(spark, sf_dir, "pages").select(
        urls.host(F.col("url")).alias("organisation_number"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.when(k % 11 == 0, 404).when(k % 13 == 0, 500).otherwise(200).alias("status_code"),
        F.when(k % 17 == 0, "application/pdf").otherwise("text/html").alias("content_type"), F.when(k % 3 == 0, "homepage").otherwise("priority").alias("page_kind"), F.lpad(k.cast("string"), 9, "0").alias("retrieved_at"), F.col("html").alias("body"),
    )
    m = markup.merged(markup.page_events(fetched))
    return m.select("organisation_number", "status", "source_url", "note", "title", F.size("pages").cast("bigint").alias("pages"), F.size("crawl_errors").cast("bigint").alias("errors"))


@query(
    "jsonld_organisations",
    """with s as (select s_suppkey as k, s_name as n from supplier), o as (select k, 'Organization' as type, n as name, '0.0' as spot from s union all select k, 'Store', n || ' shop ' || i, '0.1.' || i from s, (select unnest(range(3)) as i) where i < k % 4
  union all select k, 'Corporation', 'parent', '1' from s where k % 2 = 0) select k as s_suppkey, cast(row_number() over (partition by k order by spot) - 1 as int) as place, type, name from o where k % 9 <> 0""",
)
def jsonld_organisations(spark, sf_dir):
    """SCA38: the organisations of graphs at any depth, as variants; of texts that are no JSON, none."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    shops = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < k % 4, F.concat(F.lit('{"@type":"Store","name":"'), n, F.lit(" shop "), i.cast("string"), F.lit('"}')))), ",")
    one = F.concat(F.lit('[{"a":{"@type":["Thing","Organization"],"name":"'), n, F.lit('"},"b":['), shops, F.lit("]}"), F.when(k % 2 == 0, ',{"@type":"Corporation","name":"parent"}').otherwise(""), F.lit(',{"@type":"Person","name":"x"}]'))
    found = graphs.nodes(F.col("t"), graphs.ORGANISATIONS, 20)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 9 == 0, "{broken").otherwise(one).alias("t"))
    each = rows.select("s_suppkey", F.posexplode(F.transform(found, lambda v: F.struct(F.get(F.filter(graphs.types(v), lambda t: t.isin(graphs.ORGANISATIONS)), F.lit(0)).alias("type"), graphs.text_at(v, "$.name").alias("name")))).alias("place", "x"))
    return each.select("s_suppkey", "place", "x.type", "x.name")


@query(
    "guest_profiles",
    """select s_suppkey, case when s_suppkey % 6 <> 0 then s_name end as name, case when s_suppkey % 6 <> 0 then 'https://linkedin.com/company/f' || s_suppkey end as page_url, s_suppkey * 37 as followers, case when s_suppkey % 6 <> 0 then s_suppkey * 3 end as visible_employees,
  case when s_suppkey % 2 = 0 then '7,' || (100 + s_suppkey) else cast(100 + s_suppkey as varchar) end as ids, case when s_suppkey % 6 <> 0 then s_suppkey % 3 else 0 end as posts, case when s_suppkey % 6 <> 0 and s_suppkey % 3 > 0 then s_suppkey + (case when s_suppkey % 3 = 2 then s_suppkey + 1 else 0 end) else 0 end as likes from supplier""",
)
def guest_profiles(spark, sf_dir):
    """DRV2, SCA43: a network's company pages made of suppliers, read back."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    post = lambda i: text('{"@type":"DiscussionForumPosting","url":"https://l.example/posts/activity-', k * 10 + i, '","author":{"url":"https://no.linkedin.com/company/', F.when(i < k % 3, text("F", k)).otherwise("other"), '"}}')
    graph = text('<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"', n, '","url":"https://linkedin.com/company/F', k, '","numberOfEmployees":{"value":', k * 3, "}},", post(F.lit(0)), ",", post(F.lit(1)), "]}</script>")
    cards = text(*[x for i in (0, 1) for x in ('<article class="main-feed-activity-card" data-activity-urn="urn:li:activity:', k * 10 + i, '"><b data-test-id="social-actions__reactions" data-num-reactions="', k + i, '"></b></article>')])
    ids = text('<a href="/jobs?facetCurrentCompany=%5B', 100 + k, F.when(k % 2 == 0, "%2C7").otherwise(""), '%5D">j</a>')
    html = text('<meta property="og:description" content="x | ', F.format_number(k * 37, 0), ' følgere">', F.when(k % 6 != 0, graph).otherwise(""), cards, ids)
    r = guest.profiles(table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("body")))
    return r.select("s_suppkey", "name", "page_url", "followers", "visible_employees", F.array_join("linkedin_organisation_ids", ",").alias("ids"), F.size("posts").cast("bigint").alias("posts"), F.aggregate("posts", F.lit(0).cast("long"), lambda t, p: t + p["likes"]).alias("likes"))


def _jobs(spark, sf_dir):
    """Handles of customers and the responses to what is asked for them: each is suggested two ids, of which the second shows its postings, unless its number divides by 5."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    name = text("Fjord", k, " AS")
    handles = c.select(k.cast("string").alias("organisation_number"), name.alias("name"), F.when(k % 7 == 0, "https://x.example/no").otherwise(text("https://no.linkedin.com/company/Fjord", k, "/about")).alias("profile_url"), F.when(k % 3 == 0, F.array(text("1", k))).alias("company_ids"))

    def cards(*ids):
        one = lambda i, who: text('<div class="base-search-card" data-entity-urn="urn:', i, '"><h4><a href="https://linkedin.com/company/', who, '?x">W</a></h4><span class="sr-only">T', i, "</span></div>")
        return F.concat(*[one(i, who) for i, who in ids])

    own, other = text("fjord", k), F.lit("other")
    job = lambda i: k * 10 + 1_000_000 + i
    q = text("fjord", k)
    answers = [
        (text(guest.TYPEAHEAD, q), text('[{"type":"COMPANY","id":"2', k, '","displayName":"FJORD', k, '"},{"type":"COMPANY","id":"3', k, '","displayName":"Fjord', k, ' Inn"}]')),
        (text(guest.JOBS, "f_C=1", k, "&location=Norway&start=0"), cards((job(9), other))),
        (text(guest.JOBS, "f_C=2", k, "&location=Norway&start=0"), F.when(k % 5 != 0, cards((job(0), own), (job(1), own), (job(9), other))).otherwise("<p>none</p>")),
        (text(guest.JOBS, "keywords=", q, "&location=Norway&start=0"), cards((job(0), own), (job(2), own), (job(8), other))),
        (text(guest.JOBS, "keywords=", q, "&location=Norway&start=10"), F.when(k % 2 == 0, cards((job(3), own))).otherwise("<p>none</p>")),
        (text(guest.JOBS, "keywords=", q, "&location=Norway&start=20"), cards((job(4), own))),
        *[(text(guest.DETAIL, job(i)), text('<a href="https://www.linkedin.com/company/', F.when((k + i) % 4 != 0, own).otherwise("other"), '/x">c</a>')) for i in range(5)],
    ]
    captured = c.select(F.explode(F.array(*[F.struct(u.alias("url"), b.alias("body")) for u, b in answers])).alias("r")).select("r.url", "r.body", F.sha2("r.body", 256).alias("content_sha256"))
    return guest.jobs(handles, captured)


_JOBS_SQL = """c as (select c_custkey as k from customer), i as (select k, unnest(range(5)) as i from c), w as (select k, i, (k + i) % 4 <> 0 as ok from i where k % 7 <> 0 and (i = 0 or i = 1 and k % 5 <> 0 or i = 2 or i > 2 and k % 2 = 0))"""


@query("guest_jobs", f"with {_JOBS_SQL} select cast(k as varchar) as organisation_number, cast(k * 10 + 1000000 + i as varchar) as job_id, 'T' || (k * 10 + 1000000 + i) || ' — W' as evidence_span, case when k % 5 <> 0 then '2' || k end as linkedin_company_id, 'https://linkedin.com/company/fjord' || k as company_url from w where ok")
def guest_jobs(spark, sf_dir):
    """DRV3: postings that their own pages confirm, each once, of ids and search pages in order."""
    return _jobs(spark, sf_dir)[0].select("organisation_number", "job_id", "evidence_span", "linkedin_company_id", "company_url")


@query(
    "guest_jobs_report",
    f"""with {_JOBS_SQL}, n as (select k, count(*) filter (where ok) as good, count(*) filter (where not ok) as bad from w group by 1)
select cast(c.k as varchar) as organisation_number, case when c.k % 7 = 0 then 'invalid LinkedIn company handle' end as error, case when c.k % 7 <> 0 and c.k % 5 <> 0 then '2' || c.k end as confirmed_id,
  case when c.k % 7 = 0 then 0 else (case when c.k % 3 = 0 then 1 else 0 end) + 1 + (case when c.k % 2 = 0 then 3 else 2 end) end as pages_read,
  case when c.k % 7 = 0 then 0 else (case when c.k % 3 = 0 then 1 else 0 end) + (case when c.k % 5 <> 0 then 3 else 0 end) + 3 + (case when c.k % 2 = 0 then 2 else 0 end) end as candidate_cards, coalesce(good, 0) as exact_jobs, coalesce(bad, 0) as detail_errors from c left join n using (k)""",
)
def guest_jobs_report(spark, sf_dir):
    """DRV3: what was read of each handle."""
    return _jobs(spark, sf_dir)[1].drop("expected_url")


@query(
    "site_discovery",
    """with c as (select c_custkey as k, lpad(cast(c_custkey as varchar), 9, '0') as org, c_custkey % 4 = 0 as has from customer),
r as (select *, k % 3 <> 2 as named from c where not has)
select org as organisation_number, 2 as candidates, case when named then 'https://fjord' || k || 'kraft.no/' end as selected_url, case when named then case when k % 5 = 0 then 1.0 else 0.75 end end as candidate_score,
  case when not named then 'abstained_before_crawl' when k % 7 = 0 then 'not_captured' when k % 11 = 0 then 'quarantined' else 'verified' end as outcome, case when named and k % 7 <> 0 then case when k % 11 = 0 then 0.1 else 0.95 end end as site_score,
  case when named and k % 7 <> 0 and k % 11 <> 0 then 'https://fjord' || k || 'kraft.no/' end as website from r""",
)
def site_discovery(spark, sf_dir):
    """DRV1: sites of customers without one, found by search and judged by their own pages."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(k.cast("string"), 9, "0").alias("organisation_number"), F.concat(F.lit("Fjord"), k.cast("string"), F.lit(" Kraft AS")).alias("name"), F.lit("BERGEN").alias("municipality"), F.when(k % 4 == 0, "own.no").alias("website"))
    home = F.concat(F.lit("https://fjord"), k.cast("string"), F.lit("kraft.no/"))
    mine, word = F.concat(home, F.lit("?a=1")), F.concat(F.lit("Fjord"), k.cast("string"), F.lit(" Kraft"))
    result = lambda rank, url, title, snippet: F.struct(F.lit(rank).alias("rank"), url.alias("url"), title.alias("title"), snippet.alias("snippet"))
    snippet = F.when(k % 5 == 0, F.concat(F.lit("Org "), "organisation_number")).otherwise("strøm")
    two = F.array(result(1, F.lit("https://www.proff.no/x"), word, F.lit("Bergen")), result(2, mine, F.when(k % 3 == 2, "Annet").otherwise(word), F.when(k % 3 == 2, "x").otherwise(snippet)))
    results = c.select("organisation_number", F.explode(two).alias("r")).select("organisation_number", "r.*")
    body = F.concat(F.lit("<title>"), F.when(k % 11 == 0, "This domain is for sale").otherwise(word), F.lit("</title><p>Vi leverer strøm</p>"))
    fetched = c.filter(k % 7 != 0).select(home.alias("requested_url"), home.alias("final_url"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit("homepage").alias("page_kind"), F.lit("t").alias("retrieved_at"), body.alias("body"), F.lit(None).cast("string").alias("organisation_number"))
    return discovery.discovered(c.drop("c_custkey"), results, fetched)[0].select("organisation_number", F.col("candidates").cast("int").alias("candidates"), "selected_url", "candidate_score", "outcome", "site_score", "website")


@query("profile_observations", f"with {OBSERVATIONS_SQL}, o as (select organisation_number, count(distinct id) as n, min(id) as first from judged where cast(id as bigint) % 3 <> 0 group by 1) select cast(c_custkey as varchar) as organisation_number, coalesce(n, 0) as n, o.first from customer left join o on o.organisation_number = cast(c_custkey as varchar)")
def profile_observations(spark, sf_dir):
    """JN8: companies with their observations, repeated ones once."""
    seen = observations(spark, sf_dir).filter(F.col("id").cast("bigint") % 3 != 0).select("organisation_number", "id", "platform")
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("organisation_number"))
    both = discovery.with_observations(profiles, seen.unionByName(seen))
    return both.select("organisation_number", F.size("external_observations").cast("bigint").alias("n"), F.get("external_observations", F.lit(0))["id"].alias("first"))


@query("seed_override", "select c_custkey, case when c_custkey % 6 = 0 then 'https://seed' || c_custkey || '.no' else lower(c_name) || '.no' end as website, case when c_custkey % 6 = 0 then 'https://proof.example.com/' || c_custkey end as proof_url from customer")
def seed_override(spark, sf_dir):
    """JN10: verified seeds put in the place of registered websites."""
    k = F.col("c_custkey")
    profiles = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_name"), F.lit(".no")).alias("website"))
    seeds = profiles.filter(k % 6 == 0).select("c_custkey", F.concat(F.lit(" https://seed"), k.cast("string"), F.lit(".no ")).alias("website"), F.concat(F.lit("https://proof.example.com/"), k.cast("string")).alias("proof_url"), F.lit("p").alias("proof"))
    return discovery.with_seeds(profiles, seeds, "c_custkey").select("c_custkey", "website", F.col("website_seed_proof.proof_url").alias("proof_url"))


@query("handle_candidates", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT') and c_custkey in (select user_id from events where event_type = 'view')")
def handle_candidates(spark, sf_dir):
    """JN13: customers without an urgent order among those that viewed."""
    handles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("platform"))
    wanted = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("c_custkey"))
    return discovery.without_handle(table(spark, sf_dir, "customer").select("c_custkey"), handles, "1-URGENT", wanted, "c_custkey")


@query("search_queries", "select c_custkey, '\"' || c_name || '\" ' || lpad(cast(c_custkey as varchar), 9, '8') || (case when c_custkey % 3 = 0 then '' else ' ' || n_name end) as query from customer join nation on n_nationkey = c_nationkey")
def search_queries(spark, sf_dir):
    """PRJ16."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    place = F.when(k % 3 != 0, F.concat(F.lit("  "), "n_name"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", discovery.search_query(F.concat(F.lit(" "), "c_name"), F.lpad(k.cast("string"), 9, "8"), place).alias("query"))


@query(
    "discovery_identity",
    """with c as (select c_custkey as k, 'fjord kraft' || c_custkey as core from customer),
f as (select k, k % 2 = 0 as same_name, k % 2 = 0 and k % 3 = 0 as full_name, k % 4 = 0 as domain, k % 5 = 0 as place, k % 7 = 0 as alias0, k % 9 = 0 as leader, k % 10 = 0 as job from c),
g as (select *, alias0 and k % 2 <> 0 as alias from f)
select k as c_custkey, full_name as full_legal_name_match, same_name as legal_name_core_match, domain as reverse_domain_match, place as location_match, alias as official_site_alias_match, cast(leader as int) as leaders,
  same_name and domain or alias and domain or full_name and place or full_name and job or alias and place and leader as exact_entity from g""",
)
def discovery_identity(spark, sf_dir):
    """SCA11: pages of a network put to companies by five pairs of facts."""
    k = F.col("c_custkey")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", t("Fjord Kraft", k, " AS").alias("name"), F.lit("BERGEN").alias("municipality"), t("f", k, ".no").alias("site_host"), F.array(t("Alias ", k)).alias("aliases"), F.array(F.lit("Ola Nordmann")).alias("leaders"),
        F.when(k % 2 == 0, F.when(k % 3 == 0, t("FJORD kraft", k, " as")).otherwise(t("Fjord Kraft", k))).when(k % 7 == 0, t("alias ", k, " AS")).otherwise("Annet").alias("found_name"), F.when(k % 4 == 0, t("http://www.f", k, ".no/om")).otherwise("https://a.no").alias("found_site"),
        F.when(k % 5 == 0, "Vei 1, Bergen").otherwise("Oslo").alias("found_place"), F.when(k % 9 == 0, "sier Ola Nordmann i dag").alias("found_text"), (k % 10 == 0).alias("by_job_link"),
    )
    return discovery.discovery_identity(rows).select("c_custkey", "full_legal_name_match", "legal_name_core_match", "reverse_domain_match", "location_match", "official_site_alias_match", F.size("matched_registered_leaders").alias("leaders"), "exact_entity")


@query("site_aliases", "select p_partkey, array_to_string(list_filter([case when p_partkey % 2 = 0 then p_brand end, case when p_partkey % 3 = 0 then p_name end], lambda x: x is not null), ';') as aliases, case when p_partkey % 5 = 0 then 'Ola;Kari' else 'Ola' end as leaders from part")
def site_aliases(spark, sf_dir):
    """SCA22: names before a bar in the titles of a site, and the leaders among roles."""
    k = F.col("p_partkey")
    titles = F.array(F.when(k % 2 == 0, F.concat("p_brand", F.lit(" | "), "p_type")).otherwise("Home"), F.lit("Own Name"), F.when(k % 3 == 0, F.concat("p_name", F.lit("  – x"))).otherwise("ab"), F.when(k % 2 == 0, F.col("p_brand")))
    role = lambda n, c: F.struct(n.alias("name"), F.lit(c).alias("role_code"))
    roles = F.array(role(F.lit("Ola"), "DAGL"), role(F.lit("Per"), "MEDL"), role(F.when(k % 5 == 0, "Kari"), "LEDE"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(discovery.site_aliases(F.lit("OWN name"), titles), ";").alias("aliases"), F.array_join(discovery.leaders(roles), ";").alias("leaders"))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("provider_results", "select s_suppkey, i as rank, 'https://r' || i || '.example.com/' || s_suppkey as url, case when i = 1 then s_name else '' end as title from supplier, (select unnest([1, 2, 4]) as i) where s_suppkey % 5 <> 0 and (i <> 4 or s_suppkey % 2 = 0)")
def provider_results(spark, sf_dir):
    """SRC14: results of a search provider, with entries that aren't any and responses that are broken."""
    k = F.col("s_suppkey")
    url = lambda i: _text(f"https://r{i}.example.com/", k)
    body = _text('{"web":{"results":[{"url":"', url(1), '","title":"', F.col("s_name"), '"},{"url":"', url(2), '"},"x",{"title":"t"', F.when(k % 2 == 0, _text(',"url":"', url(4), '"')).otherwise(""), "}]}}")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(guest.search_results(F.when(k % 5 == 0, "<html>").otherwise(body))).alias("r"))
    return rows.select("s_suppkey", "r.rank", "r.url", F.when(F.col("r.rank") == 4, "").otherwise(F.col("r.title")).alias("title"))


def _page(name, slug, site, k):
    graph = _text('<script type="application/ld+json">{"@type":"Organization","name":"', name, '","url":"https://linkedin.com/company/', slug, '","numberOfEmployees":{"value":', k, "}}</script>")
    return _text('<meta name="description" content="', k + 7, ' followers">', graph, '<div data-test-id="about-us__website"><dd><a href="r">', site, "</a></dd></div>")


def _handles(spark, sf_dir):
    """Two handles a customer, the second the same page; some pages are gone, and of these some are found under the legal name; some are others' but link back."""
    k = F.col("k")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    slug, url = _text("f", k), _text("https://www.linkedin.com/company/f", k)
    companies = c.select(k.cast("string").alias("organisation_number"), _text("Fjord ", k, " AS").alias("name"), F.when(k % 3 == 0, _text("f", k, ".no")).alias("site_host"))
    handles = c.select(F.explode(F.array(F.struct((k * 2).alias("position"), url.alias("profile_url")), F.struct((k * 2 + 1).alias("position"), _text(url, "/about").alias("profile_url")))).alias("h"), k.cast("string").alias("organisation_number")).select("h.*", "organisation_number")
    body = _page(F.when(k % 4 == 0, "Annet").otherwise(_text("FJORD ", k)), slug, F.when(k % 6 == 0, _text("http://www.f", k, ".no/x")).otherwise("a.no"), k)
    gone = k % 5 == 0
    answers = F.array(F.struct(url.alias("url"), F.when(gone, 404).otherwise(200).alias("status"), body.alias("body")), F.struct(_text(url, "/about").alias("url"), F.when(gone, 404).otherwise(200).alias("status"), body.alias("body")), F.struct(_text("https://www.linkedin.com/company/fjord-", k, "-as").alias("url"), F.when(k % 10 == 0, 200).otherwise(404).alias("status"), body.alias("body")))
    captured = c.select(F.explode(answers).alias("a")).select("a.*")
    return guest.handle_profiles(handles, companies, captured)


_HANDLES_SQL = """h as (select c_custkey as k, c_custkey * 2 + i as position, i, c_custkey % 5 <> 0 or c_custkey % 10 = 0 as there, c_custkey % 4 <> 0 or c_custkey % 6 = 0 as good from customer, (select unnest([0, 1]) as i)),
o as (select *, case when not there then 'not_captured' when not good then 'identity_not_established' when i = 1 then 'duplicate' else 'extracted' end as outcome from h)"""


@query("handle_outcomes", f"with {_HANDLES_SQL} select position, outcome, case when there then k + 7 end as followers from o")
def handle_outcomes(spark, sf_dir):
    """DRV2: what became of each handle."""
    return _handles(spark, sf_dir)[1].select("position", "outcome", "followers")


@query("handle_observations", f"with {_HANDLES_SQL} select cast(k as varchar) as organisation_number, unnest(['profile_metrics', 'workforce_snapshot']) as signal_type, 'linkedin-' || unnest(['profile', 'workforce']) || '-' || sha256(k || '|https://linkedin.com/company/f' || k || '|' || unnest(['profile', 'workforce']))[:24] as id, k as employees from o where outcome = 'extracted'")
def handle_observations(spark, sf_dir):
    return _handles(spark, sf_dir)[0].select("organisation_number", "signal_type", "id", "employees")


@query(
    "discovered_handles",
    """with c as (select c_custkey as k from customer) select k as position, case when k % 3 <> 0 then 1 else 0 end as suggested, case when k % 3 = 0 then 0 when k % 2 = 0 then 2 else 1 end as candidates,
  case when k % 3 <> 0 then case when k % 5 = 0 then 'https://linkedin.com/company/fjord-' || k || '-as' when k % 2 = 0 then 'https://linkedin.com/company/f' || k end end as accepted_url from c""",
)
def discovered_handles(spark, sf_dir):
    """DRV4: pages that the search box leads to, by the legal name or by postings."""
    k = F.col("k")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    name, slug = _text("Fjord ", k, " AS"), _text("fjord-", k, "-as")
    companies = c.select(k.alias("position"), k.cast("string").alias("organisation_number"), name.alias("name"), F.lit("BERGEN").alias("municipality"), F.when(k % 5 == 0, _text("f", k, ".no")).alias("site_host"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("leaders"))
    card = _text('<div class="base-search-card" data-entity-urn="urn:', k + 1000000, '"><h4><a href="https://linkedin.com/company/F', k, '?x">W</a></h4></div>')
    answers = [
        (_text(guest.TYPEAHEAD, "Fjord+", k, "+AS"), _text('[{"type":"COMPANY","id":"7', k, '","displayName":"', F.when(k % 3 != 0, _text("FJORD ", k, " as")).otherwise("Fjord Inn"), '"}]')), (_text(guest.JOBS, "f_C=7", k, "&location=Norway&start=0"), F.when(k % 2 == 0, card).otherwise("<p>none</p>")),
        (_text("https://linkedin.com/company/", slug), _page(_text("Fjord ", k), slug, _text("f", k, ".no"), k)), (_text("https://linkedin.com/company/f", k), _page(name, _text("f", k), "a.no", k)),
    ]
    captured = c.select(F.explode(F.array(*[F.struct(u.alias("url"), b.alias("body")) for u, b in answers])).alias("a")).select("a.*")
    return guest.discovered_handles(companies, captured)[1].select("position", "suggested", "candidates", "accepted_url")


@query(
    "display_slices",
    f"""with {OBSERVATIONS_SQL}, o as (select *, cast(id as bigint) as i from judged where exact_entity), l as (select * from o where platform = 'linkedin')
select u.organisation_number, (select max(i) from l where l.organisation_number = u.organisation_number and signal_type = 'profile_metrics') as profile, (select least(10, count(*)) from l where l.organisation_number = u.organisation_number and signal_type = 'public_post') as posts,
  (select least(10, count(*)) from l where l.organisation_number = u.organisation_number and signal_type = 'job_posting') as jobs, (select count(distinct platform || ' ' || source_url) from o where o.organisation_number = u.organisation_number and signal_type = 'profile_handle') as handles
from (select distinct organisation_number from l where signal_type in ('profile_metrics', 'public_post', 'job_posting') union select distinct organisation_number from o where signal_type = 'profile_handle' and source_url is not null) as u""",
)
def display_slices(spark, sf_dir):
    """PRJ8: the slices of observations that a company's page shows."""
    from heddle.operators import connectors

    rows = observations(spark, sf_dir).withColumns({"at": F.col("id").cast("bigint"), "evidence_span": F.col("id"), "retrieved_at": F.col("retrieved_at").cast("string")})
    shown = connectors.display_slices(rows, "at")
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("bigint").alias(x)
    return shown.select("organisation_number", F.col("profile.text").cast("bigint").alias("profile"), size("posts"), size("jobs"), size("handles"))
