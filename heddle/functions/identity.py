"""SCA4-SCA9: ordered decision lists on whether a captured page or listing belongs to the exact company."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import folded, tokens

#: Texts of parked pages and words of foreign legal forms (fixed values).
PARKED = [
    "domain is for sale", "domain for sale", "hugedomains", "parked at", "miss hosting", "her flytter snart en ny gjest",
    "has been informing visitors", "find the best information and most relevant links on all topics related to",
]
PARKED_ALSO = [*PARKED, "buy this domain"]
FOREIGN = "ltd limited gmbh llc inc corp corporation sarl bv oy plc pty".split()
#: Hosts that are never a company's own, and words of names that tell no company (fixed values).
NO_COMPANY_HOSTS = [
    "proff.no", "purehelp.no", "1881.no", "gulesider.no", "firmalisten.no", "companywall.no", "firmadatabasen.no", "sokfirma.no", "yra.no",
    "northdata.com", "nor47business.com", "linkedin.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com", "tiktok.com",
]
GENERIC_WORDS = "as asa ans da enk sa nuf company norge norway gruppen group".split()
FOREIGN_PHRASES = ["registered in england", "companies house", "registered in delaware", "handelsregister", "chambre de commerce", "uk based"]


def _any(text: Column, phrases: list[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(p)).cast("int") for p in phrases]) == 1


def organisation_numbers(text: Column) -> Column:
    """SCA12: the different nine-digit numbers that begin with 8 or 9, digits joined across single spaces."""
    joined = text
    for _ in range(2):
        joined = F.regexp_replace(joined, r"([0-9])\s([0-9])", "$1$2")
    bounded = F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(joined, r"[^0-9A-Za-z_]", "  "), F.lit(" ")), F.lit("[^0-9A-Za-z_]([89][0-9]{8})[^0-9A-Za-z_]"), F.lit(1))
    return F.array_sort(F.array_distinct(bounded))


def _facts(name: Column, number: Column, headers: list[Column], body: Column):
    parts = [F.coalesce(h, F.lit("")) for h in headers]
    whole = F.concat_ws(" ", *parts, F.coalesce(body, F.lit("")))
    core = F.array_distinct(tokens(name))
    overlap = F.size(F.array_intersect(core, tokens(whole)))
    ratio = F.when(F.size(core) > 0, overlap / F.size(core)).otherwise(0.0)
    together = F.lit(False)
    for p in parts:
        together = together | ((F.size(core) > 0) & (F.size(F.array_except(core, tokens(p))) == 0))
    digits = F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", "")
    there = (digits != "") & F.contains(F.regexp_replace(whole, r"\D", ""), digits)
    return whole, core, overlap, ratio, together, digits, there


def site_score_v1(name: Column, number: Column, headers: list[Column], body: Column, pages: Column | None = None) -> Column:
    """SCA4, first match: parked .1; sports club without a mention .3; number 1; name in a header .95 (a single word only with
    100 characters of text); three quarters of its words .85; half .65; else .3. At least two words for the last two.

    ``pages`` is the text of other pages of the site: it counts for all but the number and the headers, which have to be the homepage's."""
    whole, core, overlap, ratio, together, _, there = _facts(name, number, headers, body)
    if pages is not None:
        whole = F.concat_ws(" ", whole, F.coalesce(pages, F.lit("")))
        overlap = F.size(F.array_intersect(core, tokens(whole)))
        ratio = F.when(F.size(core) > 0, overlap / F.size(core)).otherwise(0.0)
    low, n = folded(whole), F.size(core)
    club = F.coalesce(name, F.lit("")).rlike(r"(?i)(^|\s)B\.?\s*I\.?\s*L\.?(\s|$)") & ~F.contains(low, F.lit("bedriftsidrett")) & ~F.contains(F.array_join(tokens(whole), " "), F.lit("b i l"))
    enough = F.length(F.trim(F.coalesce(body, F.lit("")))) >= 100
    return (
        F.when(_any(low, PARKED), 0.1).when(club, 0.3).when(there, 1.0).when((n >= 2) & together, 0.95).when((n == 1) & together & enough, 0.95)
        .when((ratio >= 0.75) & (overlap >= 2), 0.85).when((ratio >= 0.5) & (overlap >= 2), 0.65).otherwise(0.3)
    )


def site_score_v2(name: Column, number: Column, headers: list[Column], body: Column) -> Column:
    """SCA5, first match: parked .1; only other numbers 0; number 1; foreign form .3; name in a header .95 (a single word only
    with 80 characters of text: .9); three quarters of its words, two at least .85; half .6; else .3."""
    whole, core, overlap, ratio, together, digits, there = _facts(name, number, headers, body)
    low, n, numbers = folded(whole), F.size(core), organisation_numbers(whole)
    conflict = (digits != "") & (F.size(numbers) > 0) & ~F.array_contains(numbers, digits)
    foreign = _any(low, FOREIGN_PHRASES) | F.arrays_overlap(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, FOREIGN)))
    enough = F.length(F.trim(F.coalesce(body, F.lit("")))) >= 80
    return (
        F.when(_any(low, PARKED_ALSO), 0.1).when(conflict, 0.0).when(there, 1.0).when(foreign, 0.3).when((n >= 2) & together, 0.95).when((n == 1) & together & enough, 0.9)
        .when((ratio >= 0.75) & (overlap >= 2), 0.85).when(ratio >= 0.5, 0.6).otherwise(0.3)
    )


def status(score: Column) -> Column:
    return F.when(score >= 0.9, "exact").when(score >= 0.8, "review").otherwise("related_or_uncertain")


def status_v2(score: Column) -> Column:
    """As :func:`status`; parked pages and those with other numbers alone are rejected."""
    return F.when(score <= 0.1, "rejected").otherwise(status(score))


def handle_score(name: Column, handle: Column) -> Column:
    """SCA6: a profile's handle that holds the compact name .98, a single word .95, three quarters of two or more .9, else .3."""
    core, flat = tokens(name), F.array_join(tokens(handle), "")
    own = F.array_distinct(core)
    hits, n = F.size(F.filter(own, lambda t: F.contains(flat, t))), F.size(own)
    compact = F.array_join(core, "")
    return F.when((compact != "") & F.contains(flat, compact), 0.98).when((F.size(core) == 1) & (hits == 1), 0.95).when((hits >= 2) & (hits / n >= 0.75), 0.9).otherwise(0.3)


def quarantined(links: Column, name: Column, site_exact: Column) -> Column:
    """SCA7: of a site's social links (``platform, url``) those that may be published: all others are held back. None are
    published unless the site itself is exactly the company's and the link's path holds its name."""
    return F.filter(links, lambda x: site_exact & (handle_score(name, F.regexp_extract(x["url"], r"^[a-z]+://[^/?#]*([^?#]*)", 1)) >= 0.9))


def candidate(name: Column, number: Column, place: Column, title: Column, snippet: Column, host: Column) -> Column:
    """SCA8: a search result as a struct of ``score``, ``publishable`` and ``status``. Its number .75, all its words in the title .45 or anywhere
    .25, its compact name in the host .3, the place in the snippet .1; at most 1. To be fetched it needs .75, the name in the host, and the number
    or the title; directories and platforms are rejected."""
    words = lambda x: tokens(x, [], 2)
    own = tokens(name, GENERIC_WORDS, 2)
    inside = lambda x: (F.size(own) > 0) & (F.size(F.array_except(own, x)) == 0)
    digits = F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", "")
    by_number = (digits != "") & F.contains(F.regexp_replace(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))), r"\D", ""), digits)
    in_title = inside(words(title))
    in_host = (F.size(own) > 0) & F.contains(F.array_join(words(host), ""), F.array_join(own, ""))
    at_place = (F.size(words(place)) > 0) & (F.size(F.array_except(words(place), words(snippet))) == 0)
    points = (
        F.when(by_number, 0.75).otherwise(0.0) + F.when(in_title, 0.45).when(inside(F.concat(words(title), words(snippet), words(host))), 0.25).otherwise(0.0)
        + F.when(in_host, 0.3).otherwise(0.0) + F.when(at_place, 0.1).otherwise(0.0)
    )
    blocked = F.coalesce(host, F.lit("")) == ""
    for h in NO_COMPANY_HOSTS:
        blocked = blocked | (host == h) | F.endswith(host, F.lit("." + h))
    score = F.when(blocked, 0.0).otherwise(F.bround(F.least(F.lit(1.0), points), 6))
    good = ~blocked & (score >= 0.75) & in_host & (by_number | in_title)
    return F.struct(score.alias("score"), good.alias("publishable"), F.when(good, "accepted_for_crawl").when(score >= 0.6, "review").otherwise("rejected").alias("status"))
