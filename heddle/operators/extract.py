"""PRJ6, PRJ7, PRJ15, SCA20, SCA21, SCA29, AGG22: roles, addresses, reviews, workforce, tasks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.numbers import ocr_count

#: Parts of role titles and what they are, the first that fits counts (fixed values).
ROLES = {
    "daglig leder": "ceo", "administrerende direktør": "ceo", "generalsekretær": "general_secretary", "styreleder": "board_chair", "styrets leder": "board_chair",
    "nestleder": "board_deputy_chair", "styremedlem": "board_member", "varamedlem": "deputy_board_member", "revisor": "auditor", "regnskapsfører": "accountant",
}


def role_code(title: Column) -> Column:
    low, out = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit("other")
    for part, code in reversed(ROLES.items()):
        out = F.when(F.contains(low, F.lit(part)), code).otherwise(out)
    return out


def address(street: Column, postcode: Column, city: Column) -> Column:
    """Street, then postcode and city, without what is missing."""
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    place = F.concat_ws(" ", some(postcode), some(city))
    return F.concat_ws(", ", some(street), F.when(place != "", place))


def review_label(rating: Column) -> Column:
    return F.when(rating <= 2, "negative").when(rating >= 4, "positive").when(rating.isNotNull(), "neutral")


#: Words of reports on their people: years of work, people, what people are, the year of the report, and numbers in words (fixed values).
YEARS = ["aarsverk", "arsverk", "årsverk"]
PEOPLE = ["ansatte"]
EMPLOYED = ["sysselsatt", "syssetsatt"]
BOOK_YEAR, BOOK_YEARS = ["regnskapsaret"], ["regnskapsaret", "rekneskapsaret"]
HOLDERS = ["selskapet", "stiftelsen", "legatet", "sameiet", "det"]
WORD_COUNTS = {"ingen": 0, "en": 1, "ett": 1, "to": 2, "tre": 3, "fire": 4, "fem": 5}
#: Lines with these are about groups of companies (fixed values).
GROUPS = ["konsern", "group"]

#: Parts of a phrase that aren't words: a count in digits (recognition may give the letter O for zero), one in words, a year.
COUNT, COUNT_IN_WORDS, YEAR = "count", "count in words", "year"


@dataclass(frozen=True)
class Maybe:
    """Parts that a phrase may have."""

    parts: tuple


@dataclass(frozen=True)
class Phrase:
    """A way in which reports tell a count: phrases of a lower rank count before others. ``zero`` phrases say that there is none."""

    rank: int
    measure: str
    parts: tuple
    zero: bool = False


IS = Maybe((["er", ":", "="],))
PHRASES = [
    Phrase(0, "full_time_equivalents", (["antall", "tal på", "tal pa"], YEARS, ["i"], BOOK_YEARS, IS, COUNT)),
    Phrase(0, "full_time_equivalents", (["antall"], YEARS, Maybe((EMPLOYED, ["i"], BOOK_YEAR)), IS, COUNT)),
    Phrase(0, "full_time_equivalents", (["selskapet"], ["har"], Maybe((Maybe((["i", "1"], YEAR)), ["sysselsatt"])), COUNT, YEARS)),
    Phrase(0, "full_time_equivalents", (HOLDERS, ["har ingen"], YEARS), zero=True),
    Phrase(0, "employees", (HOLDERS, ["har ingen", "har ikke hatt", "har ikke hatt noen", "hadde ingen", "ikke har"], PEOPLE), zero=True),
    Phrase(1, "employees", (["gjennomsnittlig", "gjennomsnittlige"], ["antall"], PEOPLE, Maybe((["i"], BOOK_YEAR)), IS, COUNT)),
    Phrase(1, "employees", (["antall"], PEOPLE, IS, COUNT)),
    Phrase(2, "employees", (COUNT, ["ansatte", "heltidsansatte"])),
    Phrase(2, "employees", (["det er", "selskapet har"], COUNT_IN_WORDS, PEOPLE)),
]


def phrase_pattern(phrase: Phrase) -> str:
    """A pattern for a phrase with its count as the only group, in small and capital letters alike but for the O that stands for zero."""
    slots = {COUNT: r"(?-i:(?<![\p{L}\p{N}_])[0-9O][0-9O .,-]{0,8})", COUNT_IN_WORDS: "|".join(WORD_COUNTS), YEAR: "[0-9]{4}"}

    def one(part) -> str:
        if part in (COUNT, COUNT_IN_WORDS):
            return f"({slots[part]})"
        if part == YEAR:
            return slots[YEAR]
        return "(?:" + "|".join(r"\s+".join(map(re.escape, w.split())) for w in part) + ")"

    def joined(parts: tuple) -> str:
        """Parts with space before each but the first. A sign or a count may follow without space what may be missing before it."""
        out = ""
        for at, part in enumerate(parts):
            loose = at and parts[at - 1] is IS
            if part is IS:
                out += rf"\s*{one(part.parts[0])}?\s*"
            elif isinstance(part, Maybe):
                out += rf"(?:\s+{joined(part.parts)})?" if at else rf"(?:{joined(part.parts)}\s+)?"
            else:
                opened = not at or loose or isinstance(parts[at - 1], Maybe) and at == 1
                out += ("" if opened else r"\s+") + one(part)
        return out

    first, last = (r"\b" if isinstance(phrase.parts[0], list) and (phrase.zero or COUNT_IN_WORDS in phrase.parts) else ""), (r"\b" if isinstance(phrase.parts[-1], list) and phrase.parts[-1] is not YEARS or phrase.zero else "")
    return f"(?iu){first}{joined(phrase.parts)}{last}"


def workforce(rows: DataFrame, text: str) -> DataFrame:
    """AGG22: adds ``value``, ``measure`` and ``status``. Lines on groups of companies don't count. The best rank with a count decides; two
    different counts of it are a conflict; of one count full-time equivalents name the measure."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\t\\r ]+", " "), "\n"), lambda x: ~x.rlike(f"(?i){'|'.join(GROUPS)}"))
    own = F.array_join(lines, "\n")
    spoken = F.create_map(*[F.lit(x) for w, n in WORD_COUNTS.items() for x in (w, float(n))])
    none = F.array().cast("array<double>")

    def counts(p: Phrase) -> Column:
        if p.zero:
            return F.when(F.col("_own").rlike(phrase_pattern(p)), F.array(F.lit(0.0))).otherwise(none)
        read = (lambda x: spoken[F.lower(x)]) if COUNT_IN_WORDS in p.parts else ocr_count
        return F.filter(F.transform(F.regexp_extract_all("_own", F.lit(phrase_pattern(p)), F.lit(1)), read), lambda v: v.isNotNull())

    of = lambda rank, measure: F.array_distinct(F.concat(none, *[counts(p) for p in PHRASES if (p.rank, p.measure) == (rank, measure)]))
    ranks = sorted({p.rank for p in PHRASES})
    rows = rows.withColumn("_own", own).withColumn("_by_rank", F.array(*[F.struct(of(r, "full_time_equivalents").alias("years"), of(r, "employees").alias("people")) for r in ranks]))
    some = F.filter("_by_rank", lambda x: F.size(x["years"]) + F.size(x["people"]) > 0)
    rows = rows.withColumn("_best", F.get(some, F.lit(0))).withColumn("_values", F.coalesce(F.array_union("_best.years", "_best.people"), none))
    one = F.size("_values") == 1
    return rows.withColumns(
        {
            "value": F.when(one, F.get("_values", F.lit(0))),
            "measure": F.when(one, F.when(F.size("_best.years") > 0, "full_time_equivalents").otherwise("employees")),
            "status": F.when(F.size("_values") == 0, "no_employee_phrase").when(one, "accepted").otherwise("conflicting_employee_counts"),
        }
    ).drop("_own", "_by_rank", "_best", "_values")


#: Tasks that every company has, as connector and purpose; those of links, and the one without any (fixed values).
TASKS = [("google_places_api", "resolve_places_and_public_rating"), ("licensed_news_search", "discover_independent_mentions"), ("jobs_provider", "discover_active_jobs")]
LINK_PURPOSE, NO_LINKS = "refresh_verified_profile_metrics", ("permitted_search_api", "discover_social_handles")


def tasks(rows: DataFrame, number: str, name: str, municipality: str, links: str) -> DataFrame:
    """PRJ15: three fixed tasks, one a link (``platform, url``), or one to find links; none without number or name. An id is made of the task's
    fields as JSON in the order of their names, so the same task has the same id again."""
    one = lambda connector, purpose, url: F.struct(connector.alias("connector"), purpose.alias("purpose"), url.cast("string").alias("url"))
    fixed = F.array(*[one(F.lit(c), F.lit(p), F.lit(None)) for c, p in TASKS])
    some = F.filter(F.coalesce(F.col(links), F.array().cast("array<struct<platform:string,url:string>>")), lambda x: (x["platform"] != "") & (x["url"] != ""))
    each = F.transform(some, lambda x: one(F.concat(x["platform"], F.lit("_connector")), F.lit(LINK_PURPOSE), x["url"]))
    none = F.array(one(F.lit(NO_LINKS[0]), F.lit(NO_LINKS[1]), F.lit(None)))
    asked = rows.filter((F.coalesce(F.col(number), F.lit("")) != "") & (F.coalesce(F.col(name), F.lit("")) != ""))
    out = asked.select(F.col(number).alias("organisation_number"), F.col(name).alias("company_name"), F.coalesce(F.col(municipality), F.lit("")).alias("municipality"), F.explode(F.concat(fixed, F.when(F.size(F.col(links)) > 0, each).otherwise(none))).alias("t"))
    out = out.select("organisation_number", "company_name", "municipality", "t.connector", "t.purpose", F.col("t.url").alias("candidate_url"))
    fields = F.to_json(F.struct(*sorted(out.columns)), {"ignoreNullFields": "false"})
    return out.select(F.substring(F.sha2(fields, 256), 1, 24).alias("task_id"), *out.columns, F.lit("pending").alias("state"))


#: What a site's pages on the company are called, the best first (fixed values).
PRIORITY_TERMS = [
    "om-oss", "om_oss", "about", "kontakt", "contact", "ledelse", "management", "team", "people", "locations", "lokasjoner", "avdelinger", "butikker",
    "news", "press", "aktuelt", "nyheter",
]


def priority_links(pages: DataFrame, key: str, url: str, html: str, limit: int = 4) -> DataFrame:
    """TOP5: of each page the links to its own host whose path or text has a term, without query, by the best term and then by
    address, up to ``limit``. Links are absolute, or begin with a slash, or stand for a name beside the page's."""
    origin = F.regexp_extract(F.col(url), "^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.concat(origin, F.regexp_replace(F.regexp_extract(F.col(url), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "[^/]*$", ""))
    pair = lambda m: F.struct(F.regexp_extract(m, "href=\"([^\"]*)\"", 1).alias("href"), F.trim(F.regexp_replace(F.regexp_replace(m, "<[^>]*>", " "), r"\s+", " ")).alias("label"))
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("(?is)<a\\b[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0)), pair)
    one = pages.select(F.col(key), F.col(url).alias("_url"), origin.alias("_origin"), folder.alias("_folder"), F.explode(found).alias("a"))
    href = F.trim("a.href")
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.rlike("^//"), F.concat(F.regexp_extract("_origin", "^([^:]+:)", 1), href)).when(href.rlike("^/"), F.concat("_origin", href)).when(href.rlike("^[?#]"), F.col("_url")).otherwise(
        F.concat(F.when(F.col("_folder") == F.col("_origin"), F.concat("_origin", F.lit("/"))).otherwise(F.col("_folder")), href)
    )
    path = F.regexp_extract("_full", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    one = one.withColumn("_full", full).filter(F.lower(F.regexp_extract("_full", "^([A-Za-z]+://[^/?#]*)", 1)) == F.lower("_origin"))
    one = one.select(key, "_url", F.concat("_origin", F.when(path == "", "/").otherwise(path)).alias("link"), F.lower(F.concat(path, F.lit(" "), F.col("a.label"))).alias("_said"))
    rank = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(PRIORITY_TERMS))):
        rank = F.when(F.contains("_said", F.lit(t)), i).otherwise(rank)
    best = one.withColumn("rank", rank).filter(F.col("rank").isNotNull() & (F.rtrim(F.col("link"), F.lit("/")) != F.rtrim(F.col("_url"), F.lit("/")))).groupBy(key, "link").agg(F.min("rank").alias("rank"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("rank", "link"))).filter(F.col("place") <= limit)
