"""Rules on names, sites, links, times, feeds, vacancies and registers, over texts made of the driver's rows; the SQL states each rule anew."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.functions import captures, identity, text, urls
from heddle.operators import pages as markup
from heddle.operators.envelope import ALWAYS_FORMS, THRESHOLD_FORMS, accounting_obligation
from heddle.plans.rules import _case, _pick
from heddle.plans.texts import _tok
from heddle.registry import query
from heddle.session import shared_folder, table
from heddle.sources import readers

_K = "cast(c_custkey as varchar)"
_TITLES = ["Fjord {k} AS vokser i vest - Avisen", "Nytt fra Fjord {k} AS - E24", "Store Fjord {k} AS avtaler", "Fjord {k} vokser", "Ny leder - Fjord {k} AS", "AS Fjord {k}", "FJORD {k} as", "Hos fjord {k} as - x - y", ""]


def _filled(options: list[str], key: str):
    """Each of some texts by the row's key, with the key for {k}."""
    return _pick(F.col(key), [F.replace(F.lit(o), F.lit("{k}"), F.col(key).cast("string")) for o in options])


def _filled_sql(options: list[str], key: str) -> str:
    return _case(key, ["replace('" + o.replace("'", "''") + f"', '{{k}}', cast({key} as varchar))" for o in options])


_HEAD_SQL = f"""h as (select c_custkey, regexp_extract_all(lower('Fjord ' || c_custkey || ' AS'), '[a-z0-9æøå]+') as own, regexp_extract_all(lower(regexp_replace(t, '^(.*) - .*$', '\\1')), '[a-z0-9æøå]+') as head from (select c_custkey, {_filled_sql(_TITLES, "c_custkey")} as t from customer)),
n as (select c_custkey, len(list_filter(range(1, len(head) - len(own) + 2), lambda i: head[i:i + len(own) - 1] = own and (i = 1 or head[i - 1] in ({", ".join(f"'{w}'" for w in text.HEADLINE_BEFORE)})))) > 0 as named from h)"""


@query("headline_match", f"with {_HEAD_SQL} select * from n")
def headline_match(spark, sf_dir):
    """FLT16: headlines that name a customer by its whole legal name."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Fjord "), F.col("c_custkey").cast("string"), F.lit(" AS")).alias("name"), _filled(_TITLES, "c_custkey").alias("title"))
    return rows.select("c_custkey", text.headline_match(F.col("name"), F.col("title")).alias("named"))


@query(
    "news_mentions",
    """with i as (select c_custkey as k, unnest(range(4)) as i from customer where c_custkey % 6 <> 5)
select cast(k as varchar) as organisation_number, 'https://a.example.com/' || k || '/' || i as source_url, 'Fjord ' || k || ' & Sønn ' || (case i when 0 then 'vokser' else 'selger' end) || ' - Avisen' as evidence_span, case when i = 0 then 'Avisen' else 'E' || i end as publisher,
  case when i = 0 then timestamp '2024-01-02 06:30:00' end as published_at from i where i = 0 or i = 2 and k % 2 = 0 or i = 3 and k % 3 = 0""",
)
def news_mentions(spark, sf_dir):
    """DRV6, SRC15: feeds of customers: items with and without the name, without a link, told twice, and texts that are no feed."""
    k = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("Fjord "), k, F.lit(" &amp; Sønn"))
    item = lambda title, i, source, day="": F.concat(F.lit("<item><title>"), title, F.lit(" - Avisen</title><link>"), i, F.lit(f"</link><source url='x'>{source}</source><pubDate>{day}</pubDate></item>"))
    link = lambda i: F.concat(F.lit("https://a.example.com/"), k, F.lit(f"/{i}"))
    two = F.when(F.col("c_custkey") % 2 == 0, item(F.concat(name, F.lit(" selger")), link(2), "E2")).otherwise(item(F.concat(F.lit("Store "), name, F.lit(" selger")), link(2), "E2"))
    three = F.when(F.col("c_custkey") % 3 == 0, item(F.concat(name, F.lit(" selger")), link(3), "E3")).otherwise(item(F.concat(name, F.lit(" selger")), F.lit(" "), "E3"))
    items = F.concat(item(F.concat(name, F.lit(" vokser")), link(0), "Avisen", "Tue, 02 Jan 2024 06:30:00 GMT"), item(F.concat(F.upper(F.concat(F.lit("Fjord "), k)), F.lit(" &amp; SØNN vokser")), link(1), "AVISEN"), two, three)
    feed = F.when(F.col("c_custkey") % 6 == 5, "not a feed").otherwise(F.concat(F.lit("<rss version='2.0'><channel><title>t</title>"), items, F.lit("</channel></rss>")))
    feeds = table(spark, sf_dir, "customer").select(k.alias("organisation_number"), F.concat(F.lit("Fjord "), k, F.lit(" & Sønn")).alias("name"), feed.alias("feed"), F.lit("t").alias("retrieved_at"))
    return captures.mentions(feeds).select("organisation_number", "source_url", "evidence_span", "publisher", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query("iso_times", f"select event_id, case when event_id % 6 in (0, 2, 3) then date_trunc('second', ts) when event_id % 6 = 1 then date_trunc('second', ts) - interval 90 minute end as moment from events")
def iso_times(spark, sf_dir):
    """SCA33: times with an offset, without one, with a fraction, and others."""
    e, t = F.col("event_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = _pick(e, [F.concat(t, F.lit("Z")), F.concat(t, F.lit("+01:30")), t, F.concat(t, F.lit(".000Z")), F.concat(F.lit("on "), t), F.lit("")])
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", captures.iso_time(F.col("raw")).cast("timestamp_ntz").alias("moment"))


_FORMS = ["AS", "enk", "KIRK", "BRL", "DA", None, "asa", ""]
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("accounting_obligation", f"with f as (select c_custkey, upper({_case('c_custkey', ['null' if x is None else f"'{x}'" for x in _FORMS])}) as form, case when c_custkey % 3 = 0 then 2020 + c_custkey % 5 end as year from customer) select c_custkey, case when year is not null then 'filing_observed' when form in ({_LIST(ALWAYS_FORMS)}) then 'required_by_legal_form' when form in ({_LIST(THRESHOLD_FORMS)}) then 'threshold_or_activity_dependent' else 'special_rule_or_review_required' end as classification from f")
def accounting_obligation_query(spark, sf_dir):
    """SCA27."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", _pick(k, [F.lit(x).cast("string") for x in _FORMS]).alias("form"), F.when(k % 3 == 0, 2020 + k % 5).alias("year"))
    return rows.select("c_custkey", accounting_obligation(F.col("form"), F.col("year")).alias("classification"))


_LINKS = ["https://f{k}.no/a", "ftp://f{k}.no/", "https://u:p@f{k}.no/", "https://f{k}.local/", "http://localhost:{k}/", "https://f{k}.test", "http://[::1]:{k}/", "https:///{k}", "http://{k}/", "HTTP://metadata.google.internal/{k}"]


@query(
    "public_url_reject",
    f"""with u as (select c_custkey, case when c_custkey % 4 = 3 then 'http://' || (c_custkey % 256) || '.' || (c_custkey * 7 % 256) || '.' || (c_custkey * 13 % 256) || '.9/x' else {_filled_sql(_LINKS, "c_custkey")} end as url from customer),
p as (select c_custkey, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as a from u),
h as (select *, regexp_replace(regexp_replace(a, '^[^@]*@', ''), ':[0-9]*$', '') as h from p),
q as (select *, try_cast(string_split(h, '.')[1] as int) as b1, try_cast(string_split(h, '.')[2] as int) as b2, try_cast(string_split(h, '.')[3] as int) as b3, regexp_matches(h, '^[0-9]+([.][0-9]+){{3}}$') as v4 from h)
select c_custkey, case when s not in ('http', 'https') then 'scheme' when contains(a, '@') then 'credentials' when h = '' then 'host' when h in ('localhost', 'instance-data', 'metadata.google.internal') or regexp_matches(h, '[.](local|internal|lan|corp|test|example|invalid)$') then 'private name'
  when v4 and (b1 in (0, 10, 127) or b1 = 169 and b2 = 254 or b1 = 192 and b2 = 168 or b1 = 172 and b2 between 16 and 31 or b1 = 100 and b2 between 64 and 127 or b1 = 192 and b2 = 0 and b3 in (0, 2) or b1 = 198 and b2 = 51 and b3 = 100 or b1 = 203 and b2 = 0 and b3 = 113 or b1 = 198 and b2 in (18, 19) or b1 >= 224) then 'private address'
  when regexp_matches(h, '^[0-9]+$') or starts_with(h, '[') then 'literal address' end as reason from q""",
)
def public_url_reject(spark, sf_dir):
    """FLT12: links that must not be fetched, among them addresses out of every range."""
    k = F.col("c_custkey")
    n = lambda x: (x % 256).cast("string")
    address = F.concat(F.lit("http://"), n(k), F.lit("."), n(k * 7), F.lit("."), n(k * 13), F.lit(".9/x"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 3, address).otherwise(_filled(_LINKS, "c_custkey")).alias("url"))
    return rows.select("c_custkey", urls.reject_reason(F.col("url")).alias("reason"))


_MENTIONS = ["Org {a} {b} {c} og {n}", "tel {a}{b}", "x{n}", "{n}, {n} eller NO{n}MVA", "foretak {s}", "7{b}{c}{a}", "({n})", ""]


@query(
    "org_number_extract",
    f"""with t as (select o_orderkey, cast(800000000 + o_custkey * 7919 % 200000000 as varchar) as n, cast(900000000 + o_orderkey * 104729 % 100000000 as varchar) as m, o_orderkey % {len(_MENTIONS)} as w from orders)
select o_orderkey, case w when 0 then array_to_string(list_sort(list_distinct([m, n])), ',') when 3 then n when 4 then m when 6 then n else '' end as numbers from t""",
)
def org_number_extract(spark, sf_dir):
    """SCA12: nine digits from 8 or 9 on, joined across single spaces, that stand by themselves."""
    k = F.col("o_orderkey")
    n, m = (800000000 + F.col("o_custkey") * 7919 % 200000000).cast("string"), (900000000 + k * 104729 % 100000000).cast("string")
    parts = {"{n}": n, "{a}": F.substring(m, 1, 3), "{b}": F.substring(m, 4, 3), "{c}": F.substring(m, 7, 3), "{s}": F.array_join(F.split(m, ""), " ")}
    told = F.lit(None).cast("string")
    for i, w in enumerate(_MENTIONS):
        out = F.lit(w)
        for mark, value in parts.items():
            out = F.replace(out, F.lit(mark), value)
        told = F.when(k % len(_MENTIONS) == i, out).otherwise(told)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", told.alias("t"))
    return rows.select("o_orderkey", F.array_join(identity.organisation_numbers(F.col("t")), ",").alias("numbers"))


#: Sites of customers: name, title, description, body and the titles of other pages, with {k} for the key and {n} for the number.
_SITES = [
    ("Fjord{k} Kraft AS", "This domain is for sale", "", "", ""), ("Fjord{k} Kraft AS", "Fjord{k} Kraft", "", "Org {n}", ""), ("Fjord{k} Kraft AS", "Fjord{k} Kraft", "", "Org 812345679", ""), ("Fjord{k} Kraft AS", "Fjord{k} Kraft Ltd", "", "", ""),
    ("Fjord{k} Kraft AS", "Velkommen til Fjord{k} Kraft", "", "", ""), ("Fjord{k} AS", "Fjord{k}", "", "Vi lager energi for hele landet. Vi lager energi for hele landet. Vi lager energi for hele landet. Vi lager energi.", ""), ("Fjord{k} AS", "Fjord{k}", "", "kort", ""),
    ("Fjord{k} Kraft Nord Vest AS", "Fjord{k} Kraft Nord", "", "", ""), ("Fjord{k} Kraft Nord Vest AS", "Fjord{k} Kraft", "", "", "Om Nord"), ("Fjord{k} Kraft AS", "Noe helt annet", "", "", "Fjord{k} Kraft"), ("Fjord{k} B.I.L.", "Fjord{k}", "", "{n}", ""),
    ("Fjord{k} Kraft AS", "buy this domain", "", "", "parked at x"), ("", "", "", "", ""), ("Fjord{k} Kraft Nord Vest AS", "Annet", "Nord Vest", "", "Kontakt {n}"),
]
_PART = lambda i: _filled_sql([s[i].replace("{n}", "{n}") for s in _SITES], "c_custkey")
_SITE_SQL = "s as (select c_custkey, lpad(cast(c_custkey as varchar), 9, '9') as number, " + ", ".join(f"replace({_PART(i)}, '{{n}}', lpad(cast(c_custkey as varchar), 9, '9')) as {c}" for i, c in enumerate(("name", "title", "description", "body", "pages"))) + " from customer)"
_FOLDED = lambda x: f"translate(replace(lower({x}), 'æ', 'ae'), '{text.MARKED}', '{text.PLAIN}')"
_ANY = lambda phrases, x="low": " or ".join(f"contains({x}, '{p}')" for p in phrases)


def _facts_sql(whole: str) -> str:
    return f"""{_SITE_SQL}, f as (select *, title || ' ' || description || ' ' || body as home, {whole} as whole, list_distinct({_tok("name")}) as core from s),
g as (select *, {_FOLDED("whole")} as low, len(list_intersect(core, {_tok("whole")})) as overlap, len(core) > 0 and (list_has_all({_tok("title")}, core) or list_has_all({_tok("description")}, core)) as together, contains(regexp_replace(home, '[^0-9]', '', 'g'), number) as there from f)"""


@query(
    "identity_score_v1",
    f"""with {_facts_sql("title || ' ' || description || ' ' || body || ' ' || pages")},
r as (select c_custkey, case when {_ANY(identity.PARKED)} then 0.1 when regexp_matches(name, '(^| )B[.]?I[.]?L[.]?( |$)') and not contains(low, 'bedriftsidrett') and not contains(array_to_string({_tok("whole")}, ' '), 'b i l') then 0.3 when there then 1.0 when len(core) >= 2 and together then 0.95
  when len(core) = 1 and together and length(trim(body)) >= 100 then 0.95 when overlap / len(core) >= 0.75 and overlap >= 2 then 0.85 when overlap / len(core) >= 0.5 and overlap >= 2 then 0.65 else 0.3 end as score from g)
select c_custkey, cast(score as double) as score, case when score >= 0.9 then 'exact' when score >= 0.8 then 'review' else 'related_or_uncertain' end as status from r""",
)
def identity_score_v1(spark, sf_dir):
    """SCA4: the homepage's number and headers, and the words of all pages."""
    c = F.col
    rows = _sites(spark, sf_dir)
    score = identity.site_score_v1(c("name"), c("number"), [c("title"), c("description")], c("body"), c("pages"))
    return rows.select("c_custkey", score.cast("double").alias("score"), identity.status(score).alias("status"))


@query(
    "identity_score_v2",
    f"""with {_facts_sql("title || ' ' || description || ' ' || body")},
r as (select c_custkey, case when {_ANY(identity.PARKED_ALSO)} then 0.1 when len(regexp_extract_all(regexp_replace(whole, '([0-9]) ([0-9])', '\\1\\2', 'g'), '\\b[89][0-9]{{8}}\\b')) > 0 and not there then 0.0 when there then 1.0
  when {_ANY(identity.FOREIGN_PHRASES)} or len(list_intersect(regexp_extract_all(low, '[a-z0-9]+'), [{_LIST(identity.FOREIGN)}])) > 0 then 0.3 when len(core) >= 2 and together then 0.95 when len(core) = 1 and together and length(trim(body)) >= 80 then 0.9
  when overlap / len(core) >= 0.75 and overlap >= 2 then 0.85 when len(core) > 0 and overlap / len(core) >= 0.5 then 0.6 else 0.3 end as score from g)
select c_custkey, cast(score as double) as score, case when score <= 0.1 then 'rejected' when score >= 0.9 then 'exact' when score >= 0.8 then 'review' else 'related_or_uncertain' end as status from r""",
)
def identity_score_v2(spark, sf_dir):
    """SCA5: parked sites and those with other numbers alone are rejected."""
    c = F.col
    score = identity.site_score_v2(c("name"), c("number"), [c("title"), c("description")], c("body"))
    return _sites(spark, sf_dir).select("c_custkey", score.cast("double").alias("score"), identity.status_v2(score).alias("status"))


def _sites(spark, sf_dir):
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "9")
    parts = {c: F.replace(_filled([s[i] for s in _SITES], "c_custkey"), F.lit("{n}"), number) for i, c in enumerate(("name", "title", "description", "body", "pages"))}
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), *[v.alias(c) for c, v in parts.items()])


_NAMES = ["Fjord {k} Kraft AS", "AS På Ås {k} AS", "Brødrene Ærlig & Sønn DA", "{k}", "STIFTELSEN Crème {k}", ""]
_FULL = lambda x: f"array_to_string(regexp_extract_all(lower({x}), '[a-z0-9æøå]+'), ' ')"
_TRAIL = "|".join(text.TRAILING_FORMS)


@query(
    "name_dialects",
    f"""with n as (select c_custkey, {_filled_sql(_NAMES, "c_custkey")} as n from customer) select c_custkey, {_FULL("n")} as full_name, regexp_replace({_FULL("n")}, '( ?\\b({_TRAIL}))+$', '') as company_name, array_to_string({_tok("n", [], 1)}, '-') as slug,
  array_to_string(list_filter(regexp_extract_all(lower(n), '[a-z0-9æøå]+'), lambda x: x not in ({_LIST(text.TRAILING_FORMS)})), ' ') as news_name from n""",
)
def name_dialects(spark, sf_dir):
    """SCA3, SCA24: a name in four of its normal forms."""
    n = F.col("n")
    rows = table(spark, sf_dir, "customer").select("c_custkey", _filled(_NAMES, "c_custkey").alias("n"))
    return rows.select("c_custkey", text.full_name(n).alias("full_name"), text.company_name(n).alias("company_name"), text.slug(n).alias("slug"), text.news_name(n).alias("news_name"))


@query("revenue_fallback", "select o_orderkey, case when o_orderkey % 3 = 0 then cast(o_totalprice as double) when o_orderkey % 4 = 0 then 0.0 when o_orderkey % 5 = 0 then null else o_custkey * 1.0 end as revenue, case when o_orderkey % 2 = 0 then 0 when o_orderkey % 7 = 0 then null else o_custkey end as employees from orders")
def revenue_fallback(spark, sf_dir):
    """Two ways to fall back: a revenue of 0 gives way to the nested value, an employee count of 0 stands."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, F.col("o_totalprice").cast("double")).when(k % 4 == 0, 0.0).alias("top"), F.when((k % 5 != 0) & (k % 4 != 0), c.cast("double")).alias("nested"), F.when(k % 2 == 0, 0).alias("own"), F.when(k % 7 != 0, c).alias("registry")
    )
    first = F.when(F.col("top") != 0, F.col("top")).when(F.col("nested").isNotNull(), F.col("nested")).otherwise(F.col("top"))
    return rows.select("o_orderkey", first.alias("revenue"), F.coalesce("own", "registry").cast("bigint").alias("employees"))


@query("js_shell", "select page_id, case when page_id % 3 = 0 and page_id % 2 = 0 then 'js_fallback_candidate' else 'static_complete' end as state from pages")
def js_shell(spark, sf_dir):
    """FLT20: pages of which some were replaced by shells, with one script from elsewhere or two."""
    k = F.col("page_id")
    shell = F.concat(F.lit("<html><body><div id=app>Loading</div><script src=a.js></script>"), F.when(k % 2 == 0, "<script src='b.js'></script>").otherwise("<script>var x = 'a long text that is no text of the page, however long it is, as it is a script'</script>"))
    p = markup.with_parts(table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, shell).otherwise(F.col("html")).alias("html")))
    return p.select("page_id", markup.extraction_state(F.col("main_text"), F.col("scripts")).alias("state"))


@query(
    "job_cards",
    """with c as (select s_suppkey as k, unnest(range(3)) as i from supplier), j as (select k, i, case i when 0 then 'Kokk ' || k when 1 then 'Leder' else 'Vikar ' || k end as title, case when i = 0 then 'Bergen' when i = 2 and k % 2 = 0 then 'tromsø' end as location, case when i = 0 then 'https://f.no/jobb/' || k when i = 2 then 'https://f.no/karriere/v?id=' || k end as url from c where i <> 1 or k % 3 = 0)
select k as s_suppkey, title, location, url, sha256(title || ':' || coalesce(location, 'None') || ':' || coalesce(url, 'None')) as fingerprint from j""",
)
def job_cards(spark, sf_dir):
    """SCA39: vacancies on pages of suppliers."""
    k = F.col("s_suppkey").cast("string")
    html = F.concat(
        F.lit('<ul><li class="x job-row"><h3>Kokk '), k, F.lit("</h3><p>Heltid i Bergen sentrum</p><a href='/jobb/"), k, F.lit("'>Les mer</a></li><li class=other><h3>Not a vacancy</h3></li></ul><article class='job'><h2>"),
        F.when(F.col("s_suppkey") % 3 == 0, "Leder").otherwise("x"), F.lit("</h2></article><div class='vacancy-card'><a href=\"v?id="), k, F.lit('">Vikar '), k, F.lit("</a><span>"), F.when(F.col("s_suppkey") % 2 == 0, "tromsø").otherwise("Tromsøya"), F.lit("</span></div>"),
    )
    p = markup.with_parts(table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html")), cards=captures.JOB_CARDS)
    return p.select("s_suppkey", F.explode(captures.job_cards(F.col("cards"), F.lit("https://f.no/karriere/"))).alias("j")).select("s_suppkey", "j.*")


@query("job_postings", "with s as (select s_suppkey as k, unnest(range(1, 4)) as i from supplier) select k as s_suppkey, 'Rolle ' || i as title, case when i = 1 then 'Oslo' when i = 2 then 'Hele landet' end as location, case when i = 3 then 'HR' end as department, case when k % 2 = 0 then '2024-01-0' || i end as date_posted from s where k % 5 <> 0 and i <= 1 + k % 3")
def job_postings(spark, sf_dir):
    """SCA38: vacancies in JSON-LD, at any depth."""
    k = F.col("s_suppkey")
    where = {1: '"jobLocation":{"address":{"addressLocality":"Oslo"}}', 2: '"jobLocation":"Hele landet"', 3: '"department":" HR "'}
    one = lambda i: F.when(k % 3 + 1 >= i, F.concat(F.lit('{"@type":"JobPosting","title":"Rolle ' + f'{i}",{where[i]}'), F.when(k % 2 == 0, f',"datePosted":"2024-01-0{i}"').otherwise(""), F.lit("}")))
    text_ = F.when(k % 5 == 0, '[{"@type":"JobPosting","title":" "}]').otherwise(F.concat(F.lit('{"a":[{"b":['), F.array_join(F.array(one(1), one(2), one(3)), ","), F.lit(',{"@type":"Person","title":"Nei"}]}]}')))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(captures.job_postings(text_)).alias("j"))
    return rows.select("s_suppkey", "j.title", "j.location", "j.department", "j.date_posted")


def _register(spark, sf_dir):
    """Customers as a register's files, half as delimited text and half as JSON lines, with one name of each header, blanks, a broken count and keys that are too short."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    rows = c.select(
        "c_custkey", F.when(k % 50 == 7, "12").otherwise(F.lpad(k.cast("string"), 9, "9")).alias("organisasjonsnummer"), F.col("c_name").alias("navn"), F.when(k % 3 == 0, "").when(k % 5 == 0, "mange").otherwise((k % 90).cast("string")).alias("antallAnsatte"),
        F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "false").alias("konkurs"), F.col("c_mktsegment").alias("organisasjonsform.kode"), F.when(k % 6 == 0, " f.no ").alias("hjemmeside"),
    )
    folder = f"{shared_folder(spark)}/register-{uuid.uuid4().hex}"
    rows.filter(k % 2 == 0).drop("c_custkey").coalesce(1).write.option("sep", ";").option("header", True).csv(f"{folder}/a.csv")
    english = ["organisation_number", "name", "employees", "bankrupt", "legal_form", "website"]
    rows.filter(k % 2 == 1).drop("c_custkey").toDF(*english).write.option("compression", "gzip").json(f"{folder}/b.jsonl")
    return folder


@query(
    "register_files",
    """select lpad(cast(c_custkey as varchar), 9, '9') as organisation_number, c_name as name, c_mktsegment as legal_form, case when c_custkey % 3 <> 0 and c_custkey % 5 <> 0 then cast(c_custkey % 90 as int) end as employees, case when c_custkey % 6 = 0 then 'f.no' end as website, c_custkey % 4 = 0 as bankrupt from customer where c_custkey % 50 <> 7""",
)
def register_files(spark, sf_dir):
    """SRC1, SRC2, SRC5: a register read from delimited text and from gzipped JSON lines, under the names of either."""
    folder = _register(spark, sf_dir)
    both = readers.bulk(spark, f"{folder}/a.csv").unionByName(readers.bulk(spark, f"{folder}/b.jsonl"))
    return both.select("organisation_number", "name", "legal_form", "employees", "website", "bankrupt")


@query("manifest_forms", "select form, lpad(cast(s_suppkey as varchar), 9, '0') as organisation_number, case when form in ('lines', 'array') and s_suppkey % 2 = 0 then 'held_out' end as evaluation_split from supplier, (select unnest(['text', 'lines', 'array', 'object']) as form)")
def manifest_forms(spark, sf_dir):
    """SRC3, SRC4: one manifest as keys in lines, as JSON lines, as a JSON list, and as an object with a list."""
    k = F.col("s_suppkey")
    key = F.lpad(k.cast("string"), 9, "0")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("key"))
    entry = F.when(k % 2 == 0, F.to_json(F.struct(F.col("key").alias("organisation_number"), F.lit("held_out").alias("evaluation_split")))).otherwise(F.to_json(F.struct(F.col("key").alias("organisation_number"))))
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    s.orderBy("s_suppkey").select(F.concat_ws(" ", F.substring("key", 1, 3), F.substring("key", 4, 6))).write.text(f"{folder}/m.txt")
    s.orderBy("s_suppkey").select(entry).write.text(f"{folder}/m.jsonl")
    whole = lambda one: s.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("x")))), lambda e: e["x"]), ",\n"), F.lit("]")).alias("v"))
    whole(entry).coalesce(1).write.text(f"{folder}/m.json")
    whole(F.concat(F.lit('"'), "key", F.lit('"'))).select(F.concat(F.lit('{"organisation_numbers":'), "v", F.lit("}"))).coalesce(1).write.text(f"{folder}/o.json")
    read = lambda form, name: readers.manifest(spark, f"{folder}/{name}").select(F.lit(form).alias("form"), "organisation_number", "evaluation_split")
    return read("text", "m.txt").unionByName(read("lines", "m.jsonl")).unionByName(read("array", "m.json")).unionByName(read("object", "o.json"))
