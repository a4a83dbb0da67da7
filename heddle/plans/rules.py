"""Rules on numbers, names, links, roles, workforce and budgets, over texts made of the driver's rows; the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions import identity, numbers, urls
from heddle.operators import extract
from heddle.plans.base import MONEY
from heddle.registry import query
from heddle.session import table


def _pick(n: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i, o in reversed(list(enumerate(options[:-1]))):
        out = F.when(n % len(options) == i, o).otherwise(out)
    return out


def _case(n: str, options: list[str]) -> str:
    return f"case {n} % {len(options)} " + " ".join(f"when {i} then {o}" for i, o in enumerate(options[:-1])) + f" else {options[-1]} end"


_AMOUNT = "cast(cast(o_totalprice as decimal(18,2)) as varchar)"
_COMMA = f"replace({_AMOUNT}, '.', ',')"
_RAW = _case(
    "o_orderkey",
    [_COMMA, f"'(' || {_COMMA} || ')'", f"'-' || {_AMOUNT}", f"'−' || {_COMMA}", f"{_COMMA} || '-'", "'1.2' || '34,5'", "'1,2' || '34.5'", "'1.234.567'", "'12 ' || cast(100 + o_orderkey % 800 as varchar) || ',5'", "'–'", "'abc'", "''", "cast(null as varchar)", "'0'", "'–100'", "'1.5'"],
)


@query(
    "norwegian_numbers",
    f"""with r as (select o_orderkey, trim({_RAW}) as t from orders),
b as (select *, t like '(%)' as bracket, t like '(%)' or t like '-%' or t like '−%' or t like '%-' as negative,
  replace(case when t like '(%)' then t[2:-2] when t like '-%' or t like '−%' then t[2:] when t like '%-' then t[:-2] else t end, ' ', '') as d from r),
p as (select *, case when contains(d, ',') and contains(d, '.') then (case when position(',' in reverse(d)) < position('.' in reverse(d)) then replace(replace(d, '.', ''), ',', '.') end) else replace(d, ',', '.') end as e from b)
select o_orderkey, case when t in ('', '-', '–', '—', 'N/A', 'n/a', 'null') then null else (case when negative then -1 else 1 end) * (case when regexp_matches(e, '^[0-9]+([.][0-9]*)?$') then cast(e as double) end) * 1000 end as value from p""",
)
def norwegian_numbers(spark, sf_dir):
    """SCA1: amounts in every way that accounts write them, in thousands."""
    price = F.col("o_totalprice").cast(MONEY).cast("string")
    comma, k = F.translate(price, ".", ","), F.col("o_orderkey")
    raw = _pick(
        k,
        [
            comma, F.concat(F.lit("("), comma, F.lit(")")), F.concat(F.lit("-"), price), F.concat(F.lit("−"), comma), F.concat(comma, F.lit("-")), F.lit("1.234,5"), F.lit("1,234.5"), F.lit("1.234.567"),
            F.concat(F.lit("12 "), (100 + k % 800).cast("string"), F.lit(",5")), F.lit("–"), F.lit("abc"), F.lit(""), F.lit(None).cast("string"), F.lit("0"), F.lit("–100"), F.lit("1.5"),
        ],
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", numbers.norwegian_number(F.col("raw"), 1000.0).alias("value"))


_HEADS = ["i hele tusen kroner", "Tall i MNOK", "NOK 1000 (mill. nok)", "i millioner", "kroner", "Tkr"]


@query(
    "scale_factor",
    "with r as (select o_orderkey, lower(o_orderpriority || ' ' || " + _case("o_orderkey", [f"'{h}'" for h in _HEADS]) + ") as t from orders) select o_orderkey, cast(case when regexp_matches(t, 'i hele tusen|i 1 000|i 1000|tusen nok|nok 1000|nok 1 000|tkr|t[.]kr') then 1000 when regexp_matches(t, 'i millioner|i mill|mnok|mill[.] nok') then 1000000 else 1 end as double) as scale from r",
)
def scale_factor(spark, sf_dir):
    """SCA2: the unit that a table's head names, thousands before millions."""
    head = F.concat_ws(" ", "o_orderpriority", _pick(F.col("o_orderkey"), [F.lit(h) for h in _HEADS]))
    return table(spark, sf_dir, "orders").select("o_orderkey", head.alias("head")).select("o_orderkey", numbers.scale_factor(F.col("head")).alias("scale"))


@query(
    "ocr_counts",
    "with r as (select o_orderkey, " + _case("o_orderkey", ["cast(o_custkey as varchar)", "'1.' || cast(100 + o_custkey % 900 as varchar)", "'1.' || cast(100 + o_custkey % 900 as varchar) || ',5'", "replace(cast(o_custkey as varchar), '0', 'O') || ' .'", "'12.' || cast(o_custkey % 10 as varchar)", "'999' || cast(o_custkey + 1000 as varchar)", "'x' || cast(o_custkey as varchar)"])
    + " as raw from orders), s as (select o_orderkey, regexp_replace(regexp_replace(replace(replace(raw, ' ', ''), 'O', '0'), '^[.,-]+', ''), '[.,-]+$', '') as t from r), p as (select o_orderkey, case when contains(t, ',') then replace(replace(t, '.', ''), ',', '.') when regexp_matches(t, '[.][0-9]{1,2}$') then t else replace(t, '.', '') end as e from s), v as (select o_orderkey, try_cast(e as double) as v from p) select o_orderkey, case when v between 0 and 100000 then round(v, 2) end as value from v",
)
def ocr_counts(spark, sf_dir):
    """SCA26: counts as scanned."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    some = (100 + c % 900).cast("string")
    raw = _pick(k, [c.cast("string"), F.concat(F.lit("1."), some), F.concat(F.lit("1."), some, F.lit(",5")), F.concat(F.translate(c.cast("string"), "0", "O"), F.lit(" .")), F.concat(F.lit("12."), (c % 10).cast("string")), F.concat(F.lit("999"), (c + 1000).cast("string")), F.concat(F.lit("x"), c.cast("string"))])
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", numbers.ocr_count(F.col("raw")).alias("value"))


@query("currency_marks", "with a as (select o_orderkey, o_orderkey % 7 as k, case o_orderkey % 7 when 0 then null when 1 then (o_orderkey % 900) * 1e6 + 500000 when 2 then (o_orderkey % 900) * 1e3 + 1200 when 3 then -(o_orderkey % 900) * 1e6 - 1000000 else o_orderkey % 1000 end as x from orders) select o_orderkey, case when x is null then 'N/A' when abs(x) >= 1e6 then printf('%.1fM NOK', x / 1e6) when abs(x) >= 1e3 then printf('%.1fk NOK', x / 1e3) else printf('%.0f NOK', x) end as text from a")
def currency_marks(spark, sf_dir):
    """SCA25."""
    k = F.col("o_orderkey")
    x = F.when(k % 7 == 0, None).when(k % 7 == 1, (k % 900) * 1e6 + 500000).when(k % 7 == 2, (k % 900) * 1e3 + 1200).when(k % 7 == 3, -(k % 900) * 1e6 - 1000000).otherwise((k % 1000).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", numbers.currency(F.col("x")).alias("text"))


@query("phones", "with p as (select c_custkey, regexp_replace(" + _case("c_custkey", ["'22 33 ' || lpad(cast(c_custkey as varchar), 4, '0')", "'+47 22 33 ' || lpad(cast(c_custkey as varchar), 4, '0')", "'47' || cast(c_custkey as varchar)", "''"]) + ", '[^0-9]', '', 'g') as d from customer) select c_custkey, right(case when starts_with(d, '47') and length(d) > 8 then d[3:] else d end, 8) as phone from p")
def phones(spark, sf_dir):
    """SCA19: digits without the country's prefix, the last eight."""
    k = F.col("c_custkey")
    last = F.lpad(k.cast("string"), 4, "0")
    raw = _pick(k, [F.concat(F.lit("22 33 "), last), F.concat(F.lit("+47 22 33 "), last), F.concat(F.lit("47"), k.cast("string")), F.lit("")])
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", numbers.phone(F.col("raw")).alias("phone"))


_TITLES = ["Daglig leder", "Styrets leder", "Nestleder i styret", "Styremedlem", "Varamedlem", "Innehaver", "Revisor", "Regnskapsfører", "Kokk", " ADMINISTRERENDE DIREKTØR ", "Generalsekretær", "Styreleder og daglig leder"]


@query(
    "role_titles",
    "with t as (select o_orderkey, lower(" + _case("o_orderkey", [f"'{t}'" for t in _TITLES] + ["null"]) + ") as t from orders) select o_orderkey, case when contains(t, 'daglig leder') or contains(t, 'administrerende direktør') then 'ceo' when contains(t, 'generalsekretær') then 'general_secretary' when contains(t, 'styreleder') or contains(t, 'styrets leder') then 'board_chair' when contains(t, 'nestleder') then 'board_deputy_chair' when contains(t, 'styremedlem') then 'board_member' when contains(t, 'varamedlem') then 'deputy_board_member' when contains(t, 'revisor') then 'auditor' when contains(t, 'regnskapsfører') then 'accountant' else 'other' end as code from t",
)
def role_titles(spark, sf_dir):
    """SCA20."""
    title = _pick(F.col("o_orderkey"), [F.lit(t) for t in _TITLES] + [F.lit(None).cast("string")])
    return table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title")).select("o_orderkey", extract.role_code(F.col("title")).alias("code"))


_STAFF = [
    ("Selskapet har {n} årsverk.", "0f"), ("Antall ansatte: {n}", "1e"), ("Det jobber {n} ansatte her", "2e"), ("Antall årsverk er {n}\nAntall ansatte: 7", "0f"), ("Konsernet: antall ansatte 900\nAntall ansatte: {n}", "1e"),
    ("Det er tre ansatte", "w"), ("Selskapet har ingen ansatte", "z"), ("Selskapet har ingen årsverk", "y"), ("Antall ansatte: {n}\nGjennomsnittlig antall ansatte: 77777", "c"), ("Ingen tall her", "-"), ("Group antall ansatte {n}", "-"),
]


def _staff_sql() -> str:
    value = lambda kind: {"w": "3", "z": "0", "y": "0", "c": "null", "-": "null"}.get(kind, "n")
    measure = lambda kind: {"0f": "'full_time_equivalents'", "y": "'full_time_equivalents'", "c": "null", "-": "null"}.get(kind, "'employees'")
    state = lambda kind: {"c": "'conflicting_employee_counts'", "-": "'no_employee_phrase'"}.get(kind, "'accepted'")
    pick = lambda f: _case("o_orderkey", [f(k) for _, k in _STAFF])
    return f"with r as (select o_orderkey, o_custkey % 5000 as n from orders) select o_orderkey, cast({pick(value)} as double) as value, {pick(measure)} as measure, {pick(state)} as status from r"


@query("workforce_extract", _staff_sql())
def workforce_extract(spark, sf_dir):
    """AGG22: reports made of a number and a phrase; the SQL says what each phrase means."""
    n = (F.col("o_custkey") % 5000).cast("string")
    text = _pick(F.col("o_orderkey"), [F.concat(*[x for i, part in enumerate(t.split("{n}")) for x in ([n] if i else []) + [F.lit(part)]]) for t, _ in _STAFF])
    return extract.workforce(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "t").select("o_orderkey", "value", "measure", "status")


_PATHS = ["www.linkedin.com/company/f{k}/about/?x=1", "no.linkedin.com/in/ola{k}", "x.com/Fjord{k}/status/1", "twitter.com/f{k}", "facebook.com/sharer/{k}", "m.facebook.com/f{k}/", "youtube.com/@f{k}/videos", "youtube.com/channel/{k}/x", "youtu.be/{k}", "tiktok.com/f{k}", "tiktok.com/@f{k}", "instagram.com/reel/{k}", "example.com/f{k}"]
_KEPT = ["linkedin.com/company/f{k}", None, None, "x.com/f{k}", None, "facebook.com/f{k}", "youtube.com/@f{k}", "youtube.com/channel/{k}", None, None, "tiktok.com/@f{k}", None, None]


@query(
    "social_url",
    f"""with u as (select c_custkey, 'https://' || {_case("c_custkey", ["replace('" + p + "', '{k}', cast(c_custkey as varchar))" for p in _PATHS])} as url from customer),
h as (select c_custkey, regexp_replace(regexp_extract(url, '^https://([^/]+)', 1), '^www[.]', '') as h, list_filter(string_split(regexp_extract(url, '^https://[^/]+([^?]*)', 1), '/'), lambda x: x <> '') as p from u),
d as (select *, case when regexp_matches(h, '(^|[.])linkedin[.]com$') then 'linkedin' when regexp_matches(h, '(^|[.])facebook[.]com$') then 'facebook' when regexp_matches(h, '(^|[.])instagram[.]com$') then 'instagram' when regexp_matches(h, '(^|[.])(x|twitter)[.]com$') then 'x' when regexp_matches(h, '(^|[.])(youtube[.]com|youtu[.]be)$') then 'youtube' when regexp_matches(h, '(^|[.])tiktok[.]com$') then 'tiktok' end as f, lower(p[1]) as a from h)
select c_custkey, case when f is null or len(p) = 0 or h = 'youtu.be' then null
  when f = 'facebook' and a in ('sharer', 'sharer.php', 'share.php', 'dialog', 'policy.php', 'privacy', 'events', 'groups', 'plugins', 'profile.php') then null
  when f = 'instagram' and a in ('p', 'reel', 'reels', 'stories', 'explore') then null when f = 'x' and (a in ('intent', 'share', 'home', 'search', 'i') or len(p) <> 1) then null
  when f = 'linkedin' and (a <> 'company' or len(p) < 2) then null when f = 'youtube' and a not in ('channel', 'user', 'c') and not starts_with(p[1], '@') then null when f = 'tiktok' and not starts_with(p[1], '@') then null
  else 'https://' || f || '.com/' || array_to_string(case when f = 'linkedin' or f = 'youtube' and not starts_with(p[1], '@') then p[:2] when f = 'youtube' then p[:1] else p end, '/') end as profile from d""",
)
def social_url(spark, sf_dir):
    """SCA15: which links stand for a profile, in the form of its platform."""
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://"), _pick(k, [F.replace(F.lit(p), F.lit("{k}"), k.cast("string")) for p in _PATHS]))
    return table(spark, sf_dir, "customer").select("c_custkey", url.alias("url")).select("c_custkey", urls.social_profile(F.col("url"))["url"].alias("profile"))


_HANDLES = ["fjord kraft {k}", "fjordkraft", "kraft-nord", "{k}", "FJORD-{k}"]


@query(
    "social_identity",
    f"""with r as (select c_custkey, {_case("c_custkey % 4", ["['fjord']", "['fjord', 'kraft']", "['fjord', 'kraft', 'nord', 'vest']", "cast([] as varchar[])"])} as own,
  regexp_replace(lower({_case("c_custkey", ["replace('" + h + "', '{k}', cast(c_custkey as varchar))" for h in _HANDLES])}), '[^a-z0-9]', '', 'g') as flat from customer),
h as (select *, len(list_filter(own, lambda t: contains(flat, t))) as hits from r)
select c_custkey, cast(case when len(own) > 0 and contains(flat, array_to_string(own, '')) then 0.98 when len(own) = 1 and hits = 1 then 0.95 when hits >= 2 and hits / len(own) >= 0.75 then 0.9 else 0.3 end as double) as score from h where length(cast(c_custkey as varchar)) > 1
union all select c_custkey, cast(case when c_custkey % 4 = 0 and c_custkey % 5 in (0, 1, 4) or c_custkey % 4 = 1 and c_custkey % 5 in (0, 1) then 0.98 else 0.3 end as double) from customer where length(cast(c_custkey as varchar)) = 1""",
)
def social_identity(spark, sf_dir):
    """SCA6: whether a handle holds a company's name. Single characters of a handle don't count as words."""
    k = F.col("c_custkey")
    name = _pick(k % 4, [F.lit("Fjord AS"), F.lit("Fjord Kraft AS"), F.lit("Fjord Kraft Nord Vest"), F.lit("AS")])
    handle = _pick(k, [F.replace(F.lit(h), F.lit("{k}"), k.cast("string")) for h in _HANDLES])
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), handle.alias("handle"))
    return rows.select("c_custkey", identity.handle_score(F.col("name"), F.col("handle")).cast("double").alias("score"))


@query(
    "candidate_choice",
    """with p as (select c_custkey as k, 'fjord' || cast(c_custkey as varchar) as w, lpad(cast(c_custkey as varchar), 9, '9') as org from customer),
r as (select k, w, org, i, case i when 0 then w || 'kraft.no' when 1 then 'proff.no' when 2 then 'avis.no' else 'www2.' || w || '-kraft.no' end as h,
  case i when 0 then (case when k % 2 = 0 then 'Hjem' else w || ' Kraft' end) when 1 then w || ' Kraft ' || org when 2 then w || ' Kraft' else 'Kraft' end as title, case i when 0 then (case when k % 3 = 0 then 'Org ' || org || ' i Bergen' else 'om oss' end) else 'Bergen' end as snippet from p, (select unnest([0, 1, 2, 3]) as i)),
f as (select *, h = 'proff.no' as blocked, contains(regexp_replace(title || ' ' || snippet, '[^0-9]', '', 'g'), org) as num, contains(title, w) and contains(title, 'Kraft') as in_title,
  contains(regexp_replace(h, '[^a-z0-9]', '', 'g'), w || 'kraft') as in_host, contains(h, '-kraft') as host_words, contains(title, 'Kraft') as said, contains(snippet, 'Bergen') as at_place from r),
s as (select *, case when blocked then 0 else least(1.0, (case when num then 0.75 else 0 end) + (case when in_title then 0.45 when said and host_words then 0.25 else 0 end) + (case when in_host then 0.3 else 0 end) + (case when at_place then 0.1 else 0 end)) end as score from f),
b as (select k, h, score, row_number() over (partition by k order by score desc, i, h) as n from s where score >= 0.75 and in_host and (num or in_title) and not blocked)
select p.k as profile, b.h as host, cast(round(b.score, 6) as double) as score from p left join b on b.k = p.k and b.n = 1""",
)
def candidate_choice(spark, sf_dir):
    """TOP2: a company's best search result among those fit to be fetched; ties go to the better rank, then by host."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile"), F.concat(F.lit("fjord"), F.col("c_custkey").cast("string")).alias("w"), F.lpad(F.col("c_custkey").cast("string"), 9, "9").alias("org"))
    k, w, org, i = F.col("profile"), F.col("w"), F.col("org"), F.col("i")
    r = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    host = F.when(i == 0, F.concat(w, F.lit("kraft.no"))).when(i == 1, "proff.no").when(i == 2, "avis.no").otherwise(F.concat(F.lit("www2."), w, F.lit("-kraft.no")))
    title = F.when(i == 0, F.when(k % 2 == 0, "Hjem").otherwise(F.concat(w, F.lit(" Kraft")))).when(i == 1, F.concat(w, F.lit(" Kraft "), org)).when(i == 2, F.concat(w, F.lit(" Kraft"))).otherwise("Kraft")
    snippet = F.when(i == 0, F.when(k % 3 == 0, F.concat(F.lit("Org "), org, F.lit(" i Bergen"))).otherwise("om oss")).otherwise("Bergen")
    results = r.withColumns({"host": host, "title": title, "snippet": snippet, "name": F.concat(w, F.lit(" Kraft AS"))})
    found = results.withColumn("c", identity.candidate(F.col("name"), F.col("org"), F.lit("BERGEN"), F.col("title"), F.col("snippet"), F.col("host"))).filter("c.publishable")
    best = found.groupBy("profile").agg(F.min_by(F.struct("host", "c.score"), F.struct(-F.col("c.score"), "i", "host")).alias("b"))
    return c.select("profile").join(best, "profile", "left").select("profile", "b.host", F.col("b.score").cast("double").alias("score"))


@query(
    "task_plan",
    """with p as (select lpad(cast(c_custkey as varchar), 9, '0') as org, case when c_custkey % 50 = 0 then '' else c_name end as name, n_name as place, c_custkey as k from customer join nation on n_nationkey = c_nationkey),
t as (select p.*, u.connector, u.purpose, cast(null as varchar) as url from p, (values ('google_places_api', 'resolve_places_and_public_rating'), ('licensed_news_search', 'discover_independent_mentions'), ('jobs_provider', 'discover_active_jobs')) u(connector, purpose) where name <> ''
  union all select p.*, 'linkedin_connector', 'refresh_verified_profile_metrics', 'https://linkedin.com/company/c' || cast(k as varchar) from p where k % 3 = 0 and name <> ''
  union all select p.*, 'permitted_search_api', 'discover_social_handles', null from p where k % 3 <> 0 and name <> '')
select org as organisation_number, connector, purpose, substr(sha256('{"candidate_url":' || coalesce('"' || url || '"', 'null') || ',"company_name":"' || name || '","connector":"' || connector || '","municipality":"' || place || '","organisation_number":"' || org || '","purpose":"' || purpose || '"}'), 1, 24) as task_id from t""",
)
def task_plan(spark, sf_dir):
    """PRJ15: the tasks of every company, with ids that tell the same task again; a third of them has a profile's link."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    link = F.struct(F.lit("linkedin").alias("platform"), F.concat(F.lit("https://linkedin.com/company/c"), k.cast("string")).alias("url"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.lpad(k.cast("string"), 9, "0").alias("org"), F.when(k % 50 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("n_name").alias("place"),
        F.when(k % 3 == 0, F.array(link)).otherwise(F.array().cast("array<struct<platform:string,url:string>>")).alias("links"),
    )
    return extract.tasks(rows, "org", "name", "place", "links").select("organisation_number", "connector", "purpose", "task_id")


@query(
    "priority_links",
    """with a as (select page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as origin, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>')) as m from (select page_id, url, replace(replace(replace(html, 'href="/the"', 'href="/about?x=1"'), '>de<', '>Kontakt<'), 'href="/la"', 'href="http://other.example/team"') as html from pages)),
h as (select page_id, url, origin, regexp_extract(m, 'href="([^"]*)"', 1) as href, regexp_extract(m, '>([^<]*)<', 1) as label from a),
f as (select *, case when contains(href, '://') then href when starts_with(href, '/') then origin || href end as full_url from h),
p as (select *, regexp_extract(full_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from f where lower(regexp_extract(full_url, '^([A-Za-z]+://[^/?#]*)', 1)) = lower(origin)),
r as (select page_id, url, origin || (case when path = '' then '/' else path end) as link, list_position(list_transform(['om-oss', 'om_oss', 'about', 'kontakt', 'contact', 'ledelse', 'management', 'team', 'people', 'locations', 'lokasjoner', 'avdelinger', 'butikker', 'news', 'press', 'aktuelt', 'nyheter'], lambda t: contains(lower(path || ' ' || label), t)), true) - 1 as rank from p),
b as (select page_id, link, min(rank) as rank from r where rank >= 0 and rtrim(link, '/') <> rtrim(url, '/') group by 1, 2)
select page_id, link, rank from (select *, row_number() over (partition by page_id order by rank, link) as place from b) where place <= 4""",
)
def priority_links(spark, sf_dir):
    """TOP5, over the pages with some of their links named as sites of companies name them."""
    html = F.replace(F.replace(F.replace(F.col("html"), F.lit('href="/the"'), F.lit('href="/about?x=1"')), F.lit(">de<"), F.lit(">Kontakt<")), F.lit('href="/la"'), F.lit('href="http://other.example/team"'))
    pages = table(spark, sf_dir, "pages").withColumn("html", html)
    return extract.priority_links(pages, "page_id", "url", "html").select("page_id", "link", "rank")


@query(
    "identity_gate",
    "with l as (select c_custkey, c_custkey % 5 <> 0 as exact, unnest(['https://linkedin.com/company/fjordkraft' || cast(c_custkey as varchar), 'https://x.com/annet' || cast(c_custkey as varchar)]) as url from customer) select c_custkey, count(*) filter (where exact and contains(url, 'fjordkraft')) as published, count(*) filter (where not (exact and contains(url, 'fjordkraft'))) as quarantined from l group by 1",
)
def identity_gate(spark, sf_dir):
    """SCA7: links are held back unless the site is exactly the company's and they hold its name."""
    k = F.col("c_custkey")
    link = lambda p, u: F.struct(F.lit(p).alias("platform"), F.concat(F.lit(u), k.cast("string")).alias("url"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array(link("linkedin", "https://linkedin.com/company/fjordkraft"), link("x", "https://x.com/annet")).alias("links"))
    n = F.size(identity.quarantined(F.col("links"), F.lit("Fjord Kraft AS"), k % 5 != 0)).cast("bigint")
    return c.select("c_custkey", n.alias("published"), (F.size("links") - n).alias("quarantined"))
