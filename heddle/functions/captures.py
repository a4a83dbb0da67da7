"""Parsers of captured feeds and pages: news items, job cards, channels, listings (SRC15, SRC20, SCA9, SCA33, SCA39, SCA44)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import urls
from heddle.functions.text import headline_match



ITEM = "array<struct<title:string,link:string,source:struct<_VALUE:string,_url:string>,pubDate:string>>"
FEED = f"channel struct<item:{ITEM}>, item {ITEM}"


def news_items(feed: Column) -> Column:
    """SRC15: a feed's items in order, as structs of title, link, publisher and publication time; none for text that isn't a feed."""
    read = F.from_xml(feed, FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    items = F.coalesce(read["channel"]["item"], read["item"], F.array().cast(ITEM))
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.transform(items, lambda x: F.struct(some(x["title"]).alias("title"), some(x["link"]).alias("link"), some(x["source"]["_VALUE"]).alias("publisher"), mail_time(x["pubDate"]).alias("published_at")))


def mentions(feeds: DataFrame, most: int = 10) -> DataFrame:
    """DRV6, SRC15: of each company's captured feed (``organisation_number, name, feed, retrieved_at``) the items whose headline has exactly its name, each headline of
    a publisher once, the first ``most``, as observations."""
    from pyspark.sql import Window

    c = F.col
    rows = feeds.select("organisation_number", "name", "retrieved_at", F.sha2(F.coalesce("feed", F.lit("")), 256).alias("_feed"), F.posexplode(news_items(c("feed"))).alias("at", "i"))
    named = rows.filter(c("i.link").isNotNull() & headline_match(c("name"), c("i.title"))).withColumn("_publisher", F.coalesce("i.publisher", F.lit("")))
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy("organisation_number", F.lower("i.title"), F.lower("_publisher")).orderBy("at"))).filter("_n = 1")
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy("organisation_number").orderBy("at"))).filter(c("_n") <= most)
    fixed = {"platform": "news", "signal_type": "public_mention", "acquisition_mode": "rights_review_experiment", "rights_status": "review_required", "source_class": "public_news", "strategy": "independent_news_discovery"}
    key = F.concat_ws("|", "organisation_number", "i.title", "_publisher")
    return first.select(
        F.concat(F.lit("google-news-title-"), F.substring(F.sha2(key, 256), 1, 24)).alias("id"), "organisation_number", c("i.link").alias("source_url"), "retrieved_at", "i.published_at", F.sha2(F.concat("_feed", "i.title", "_publisher"), 256).alias("content_sha256"),
        c("i.title").alias("evidence_span"), c("_publisher").alias("publisher"), F.lit(True).alias("exact_entity"), *[F.lit(v).alias(k) for k, v in fixed.items()],
    )


def mail_time(text: Column) -> Column:
    """SCA33: a time as in mail heads, in UTC; null for others."""
    bare = F.regexp_extract(text, r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    return F.try_to_timestamp(F.nullif(bare, F.lit("")), F.lit("d MMM yyyy HH:mm:ss"))


def iso_time(text: Column) -> Column:
    """SCA33: an ISO time; without an offset it is UTC; null for others."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text))


#: What job cards look like on a page of vacancies, and places that they name (fixed values).
JOB_CARDS = "li*job,div*job-item,div*career-card,div*vacancy,article*job,tr*job"
PLACES = ["Oslo", "Bergen", "Trondheim", "Stavanger", "Tromsø", "Kristiansand", "Drammen", "Sandnes"]


def job_cards(cards: Column, base: Column, most: int = 30) -> Column:
    """SCA39: the vacancies that a page's cards tell (see :func:`heddle.operators.pages.with_parts`), of the first ``most`` cards: title of 4 to 100 characters, place, address, and a
    fingerprint of these."""

    def job(card: Column) -> Column:
        head = F.get(F.filter(card, lambda e: e["tag"].isin("h2", "h3", "h4", "a", "strong")), F.lit(0))["text"]
        link = F.get(F.filter(card, lambda e: (e["tag"] == "a") & e["attributes"]["href"].isNotNull()), F.lit(0))["attributes"]["href"]
        place = F.nullif(F.regexp_extract(F.get(card, F.lit(0))["text"], rf"(?iu)\b({'|'.join(PLACES)})\b", 1), F.lit(""))
        return F.struct(head.alias("title"), place.alias("location"), urls.joined(base, link).alias("url"))

    good = F.filter(F.transform(F.slice(cards, 1, most), job), lambda j: F.length(j["title"]).between(4, 100))
    text = lambda x: F.coalesce(x, F.lit("None"))
    return F.transform(good, lambda j: F.struct(j["title"].alias("title"), j["location"].alias("location"), j["url"].alias("url"), F.sha2(F.concat_ws(":", j["title"], text(j["location"]), text(j["url"])), 256).alias("fingerprint")))


def job_postings(json_ld: Column) -> Column:
    """The vacancies that a JSON-LD text tells, at any depth: those with a title, with place, department, kind, address and days, null where blank."""
    from heddle.functions import graphs

    some = lambda v, path: F.nullif(F.trim(graphs.text_at(v, path)), F.lit(""))
    posting = lambda v: F.array_contains(graphs.types(v), "JobPosting") & some(v, "$.title").isNotNull()
    place = lambda v: F.coalesce(some(v, "$.jobLocation.address.addressLocality"), F.when(F.try_variant_get(v, "$.jobLocation", "map<string,variant>").isNull(), some(v, "$.jobLocation")))
    named = {"department": "$.department", "employment_type": "$.employmentType", "url": "$.url", "date_posted": "$.datePosted", "valid_through": "$.validThrough"}
    one = lambda v: F.struct(some(v, "$.title").alias("title"), place(v).alias("location"), *[some(v, p).alias(n) for n, p in named.items()], F.lit("active").alias("status"))
    return F.transform(F.filter(graphs.nodes(json_ld), posting), one)


def channels(videos: DataFrame, key: str, channel: str, views: str) -> DataFrame:
    """SRC20, AGG23: a company's channels with their number of videos and mean views, the largest first by number and name."""
    from pyspark.sql import Window

    g = videos.groupBy(key, channel).agg(F.count("*").alias("n"), F.bround(F.avg(views), 3).alias("mean_views"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), channel)))


def not_finite(rows: DataFrame) -> Column:
    """SCA42: the names of a row's columns that hold NaN or an infinity, in order."""
    bad = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(c)) for c, kind in rows.dtypes if kind in ("double", "float")]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
