"""Registered domains of hosts, and map listings of customers, over hosts and listings made of the driver's rows; the SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import domains, urls
from heddle.functions.text import MAP_LEGAL_WORDS
from heddle.operators import maps
from heddle.registry import query
from heddle.session import dealt, table

_RULES_SQL = "rules as (select * from (values " + ", ".join("(" + (f"'{r[2:]}', 'wildcard'" if r.startswith("*.") else f"'{r[1:]}', 'exception'" if r.startswith("!") else f"'{r}', 'plain'") + ")" for r in domains.RULES) + ") t(base, kind))"
_ENDS = ["", ".co.uk", ".x.ck", ".www.ck", ".nore.kommune.no", ".city.kawasaki.jp", ".b.kawasaki.jp", ".github.io", ".unknown", ".", ".CO.NO"]


@query(
    "registered_domains",
    f"""with {_RULES_SQL}, h as (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') || [{", ".join(f"'{e}'" for e in _ENDS)}][cast(page_id % {len(_ENDS)} as int) + 1] as host from pages),
l as (select page_id, host, string_split(regexp_replace(lower(host), '[.]$', ''), '.') as labels from h),
p as (select page_id, unnest(range(1, len(labels) + 1)) as n, labels from l),
m as (select page_id, any_value(len(labels)) as size, max(case when kind = 'exception' then n - 1 end) as ex, max(case when kind = 'plain' then n when kind = 'wildcard' and n < len(labels) then n + 1 end) as best
  from p left join rules on base = array_to_string(labels[len(labels) - n + 1:], '.') group by 1),
c as (select l.*, coalesce(ex, best, 1) as n from l join m using (page_id))
select page_id, host, array_to_string(labels[len(labels) - n + 1:], '.') as public_suffix, case when n < len(labels) then array_to_string(labels[len(labels) - n:], '.') end as registered_domain from c""",
)
def registered_domains(spark, sf_dir):
    """SCA17: the registered domain of every page's host, some of them put below other suffixes."""
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % len(_ENDS)).cast("int"))
    hosts = table(spark, sf_dir, "pages").select("page_id", F.concat(urls.host(F.col("url")), end).alias("host"))
    return domains.with_domain(hosts, "host", domains.rules(spark))


#: Five listings a customer: what is changed in the name, the street, the telephone and the site of each.
_FORMS = ["{name}", "{name} AS", "Nabo {k}", "{half}", "{name}"]


def _profiles(spark, sf_dir):
    k = F.col("c_custkey")
    c, n = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        "c_custkey", k.cast("string").alias("organisation_number"), F.concat(F.when(k % 10 == 0, "Holding").otherwise(F.concat(F.lit("Fjord Kraft"), k.cast("string"))), F.lit(" AS")).alias("name"),
        F.concat(F.lit("Vei "), k.cast("string")).alias("street"), F.lpad((k % 9000).cast("string"), 4, "0").alias("postcode"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("city"),
        F.when(k % 3 != 0, F.concat(F.lit("+47 22"), F.lpad((k % 999999).cast("string"), 6, "0"))).alias("phone"), F.when(k % 4 == 0, F.concat(F.lit("https://www.f"), k.cast("string"), F.lit(".no/om"))).alias("site"),
    )


def _listings(spark, sf_dir):
    k, i = F.col("c_custkey"), F.col("i")
    bare = F.regexp_replace("name", " AS$", "")
    title = F.when(i == 1, F.col("name")).when(i == 2, F.concat(F.lit("Nabo "), k.cast("string"))).when(i == 3, "Fjord Butikk").otherwise(bare)
    rows = _profiles(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    far = (k + i) % 5 == 0
    return rows.select(
        "organisation_number", i.alias("position"), F.when(i != 4, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("place_id"), F.concat(F.lit("d"), i.cast("string")).alias("data_id"),
        F.concat(F.lit("https://maps.example.com/"), i.cast("string")).alias("link"), title.alias("title"),
        F.when(far, "Langt borte 1, 9999 Annet").when((k + i) % 5 == 1, F.concat(F.lit("Kaia 7, "), F.col("postcode"), F.lit(" "), F.col("city"))).otherwise(F.concat("street", F.lit(", "), "postcode", F.lit(" "), "city")).alias("address"),
        F.when((k + i) % 2 == 0, F.substring("phone", 4, 20)).alias("phone"), F.when((k + i) % 4 == 0, F.concat(F.lit("butikk.f"), k.cast("string"), F.lit(".no"))).alias("web_site"),
        F.when((k + i) % 3 != 0, ((k * 7 + i) % 400).cast("int")).alias("review_count"), F.when((k + i) % 6 != 0, ((k + i) % 9 / 2 + 1)).cast("double").alias("review_rating"),
    )


_STOP = ", ".join(f"'{w}'" for w in MAP_LEGAL_WORDS)
_WORDS = lambda x: f"regexp_extract_all(translate(replace(lower(coalesce({x}, '')), 'æ', 'ae'), 'øå', 'oa'), '[a-z0-9]+')"
_NAMED = lambda x: f"list_filter({_WORDS(x)}, lambda t: t not in ({_STOP}) and (length(t) >= 3 or regexp_matches(t, '[0-9]')))"
_TEL = lambda x: f"right(regexp_replace(regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g'), '^47([0-9]{{7,}})$', '\\1'), 8)"
_MAPS_SQL = f"""p as (select c_custkey as k, cast(c_custkey as varchar) as org, (case when c_custkey % 10 = 0 then 'Holding' else 'Fjord Kraft' || c_custkey end) || ' AS' as name, 'Vei ' || c_custkey as street, lpad(cast(c_custkey % 9000 as varchar), 4, '0') as postcode, replace(n_name, '_', ' ') as city,
  case when c_custkey % 3 <> 0 then '+47 22' || lpad(cast(c_custkey % 999999 as varchar), 6, '0') end as tel, case when c_custkey % 4 = 0 then 'f' || c_custkey || '.no' end as site from customer join nation on n_nationkey = c_nationkey),
x as (select p.*, i, case when i <> 4 then 'p' || cast(i % 3 as varchar) else 'https://maps.example.com/4' end as identity0, case when i <> 4 then 'p' || cast(i % 3 as varchar) else 'd4' end as identity, case i when 1 then name when 2 then 'Nabo ' || k when 3 then 'Fjord Butikk' else regexp_replace(name, ' AS$', '') end as title,
  case (k + i) % 5 when 0 then 'Langt borte 1, 9999 Annet' when 1 then 'Kaia 7, ' || postcode || ' ' || city else street || ', ' || postcode || ' ' || city end as address, case when (k + i) % 2 = 0 then substr(tel, 4) end as phone, case when (k + i) % 4 = 0 then 'butikk.f' || k || '.no' end as web_site,
  case when (k + i) % 3 <> 0 then (k * 7 + i) % 400 end as reviews from p cross join (select unnest(range(5)) as i)),
u as (select *, min(i) over (partition by org, identity) as position, i = max(i) over (partition by org, identity) as is_last from x),
f as (select *, list_distinct({_NAMED("name")}) as own, list_distinct({_NAMED("title")}) as said, {_WORDS("address")} as aw, {_WORDS("street")} as sw, {_WORDS("city")} as cw, {_TEL("tel")} as t1, {_TEL("phone")} as t2 from u where is_last),
g as (select *, case when list_has_all(said, own) then 1.0 else len(list_intersect(own, said)) / len(own) end as name_score, list_has_all(aw, sw) and list_contains(aw, postcode) as address_match,
  list_contains(aw, postcode) and list_has_all(aw, cw) as postcode_city_match, length(t1) >= 5 and t1 = t2 as phone_match, site is not null and web_site is not null and (web_site = site or ends_with(web_site, '.' || site)) as website_match, len(own) = 1 and own[1] = 'holding' as weak from f),
a as (select *, cast(address_match or postcode_city_match as int) + cast(phone_match as int) + cast(website_match as int) as strong from g),
s as (select org as organisation_number, cast(position as int) as position, 'd' || i as data_id, round_even(name_score, 4) as name_score, address_match, postcode_city_match, phone_match, website_match,
  round_even(name_score * 4 + 3 * cast(address_match as int) + 2 * cast(phone_match as int) + 3 * cast(website_match as int) + 2 * cast(postcode_city_match as int) + least(1.0, log10(greatest(1, coalesce(reviews, 0))) / 5), 4) as score,
  (name_score >= 0.99 and strong >= 1 or name_score >= 0.66 and strong >= 2 or website_match and name_score = 1) and not (weak and not (address_match or phone_match or website_match)) as accepted from a)"""


def _assessed(spark, sf_dir):
    return maps.assessed(_profiles(spark, sf_dir), maps.latest(_listings(spark, sf_dir)))


@query("map_assessments", f"with {_MAPS_SQL} select * from s")
def map_assessments(spark, sf_dir):
    """SCA9, SRC22: what agrees between companies and the latest of their listings."""
    return _assessed(spark, sf_dir).select("organisation_number", "position", "data_id", "name_score", *maps.CHANNELS, "score", "accepted")


@query(
    "maps_choice_ambiguous",
    f"""with {_MAPS_SQL}, t as (select organisation_number, count(*) as candidates, max(score) filter (where accepted) as top from s group by 1),
b as (select t.organisation_number, any_value(candidates) as candidates, count(s.score) as n, min(s.data_id) as first from t left join s on s.organisation_number = t.organisation_number and s.accepted and s.score = t.top group by 1)
select organisation_number, case n when 0 then 'no_exact_match' when 1 then 'exact_match' else 'ambiguous_exact_match' end as status, candidates, case when n = 1 then first end as data_id from b""",
)
def maps_choice_ambiguous(spark, sf_dir):
    """TOP3: the best accepted listing, and none if two are best."""
    return maps.chosen(_assessed(spark, sf_dir)).select("organisation_number", "status", F.col("candidates").cast("bigint").alias("candidates"), F.col("listing.data_id").alias("data_id"))


@query(
    "map_observations",
    f"""with {_MAPS_SQL}, t as (select organisation_number, max(score) as top from s where accepted group by 1), b as (select t.organisation_number, any_value(s.data_id) as data_id from t join s on s.organisation_number = t.organisation_number and s.accepted and s.score = t.top group by 1 having count(*) = 1),
c as (select org, case when i <> 4 then 'p' || (i % 3) end as place, web_site, reviews, case when (k + i) % 6 <> 0 then (k + i) % 9 / 2 + 1 end as rating from a join b on b.organisation_number = a.org and b.data_id = 'd' || a.i),
e as (select org, 'place_summary' as signal_type from c union all select org, 'company_profile' from c where web_site is not null union all select org, unnest(['review_summary', 'profile_metrics', 'buzz_metrics']) from c where reviews > 0 and rating between 0.5 and 5)
select signal_type, count(*) as n, count(distinct org) as companies from e group by 1""",
)
def map_observations(spark, sf_dir):
    """What the chosen listings give, by signal."""
    found = maps.observations(maps.chosen(_assessed(spark, sf_dir)), "2024-01-01T00:00:00Z")
    return found.groupBy("signal_type").agg(F.count("*").alias("n"), F.countDistinct("organisation_number").alias("companies"))
