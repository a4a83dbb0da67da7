"""SCA9, TOP3, SRC22: listings of a map against companies: channels of agreement, acceptance, and a choice that abstains.

Profiles have ``organisation_number, name, street, postcode, city, phone, site`` (the verified address of the company's website, or null); candidates
``organisation_number, position, place_id, data_id, link, title, address, phone, web_site, review_count, review_rating``, where ``position`` is the order in
which a company's results came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.numbers import phone
from heddle.functions.text import map_tokens, meaningful_name_tokens
from heddle.functions.udfs import sequence_ratio
from heddle.functions.urls import host
from heddle.operators.extract import review_label

#: Words of names that say little on a map (fixed values).
GENERIC = ["holding", "eiendom", "invest", "bolig", "service", "drift", "gruppen", "group"]
#: Trading names that were verified for a company, by its number and the name's words, with the proof (fixed values).
TRADE_NAMES = {
    ("932083108", "privatmegleren premium"): "https://www.proff.no/selskap/privatmegleren-premium/oslo/eiendomsmegling/IFEXRXG00B1",
    ("963430663", "mobit kanalveien"): "https://www.mobit.no/forhandlere/bergen/kanalveien",
    ("967292907", "lunsj service og orebekk fisk vilt"): "https://www.starina.no/",
}
#: Weights of what agrees (fixed values): a name's share, street, phone, site, postcode and city; reviews add at most 1.
WEIGHTS = {"name_score": 4, "address_match": 3, "phone_match": 2, "website_match": 3, "postcode_city_match": 2}
CHANNELS = ("address_match", "postcode_city_match", "phone_match", "website_match")


def latest(candidates: DataFrame) -> DataFrame:
    """SRC22: of a company's candidates with one identity (place, data or link, else all that is told of it) the last, at the place of the first."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    told = [c for c in candidates.columns if c not in ("position",)]
    identity = F.coalesce(some("place_id"), some("data_id"), some("link"), F.sha2(F.to_json(F.struct(*sorted(told)), {"ignoreNullFields": "false"}), 256))
    rows = candidates.withColumn("_identity", identity)
    g = rows.groupBy("organisation_number", "_identity").agg(F.max_by(F.struct(*candidates.columns), "position").alias("_last"), F.min("position").alias("_first"))
    return g.select(*[F.col("_first").alias(c) if c == "position" else F.col(f"_last.{c}").alias(c) for c in candidates.columns])


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def assessed(profiles: DataFrame, candidates: DataFrame, trade_names: dict = TRADE_NAMES) -> DataFrame:
    """SCA9: candidates of known companies with ``name_score``, the channels that agree, ``fuzzy_name_score``, ``score`` and ``accepted``.

    A name that is all there needs one channel, two thirds of it two; a verified trading name needs street and phone; a site
    that agrees needs a name alike by 0.85. That likeness is worked out only for candidates whose site agrees, as it counts for no others.
    """
    c = F.col
    p = profiles.select("organisation_number", *[c(x).alias(f"_{x}") for x in ("name", "street", "postcode", "city", "phone", "site")])
    rows = candidates.join(p, "organisation_number")
    words = lambda x: F.array_distinct(meaningful_name_tokens(x))
    rows = rows.withColumns(
        {
            "_own": words(c("_name")), "_title": words(c("title")), "_at": F.array_distinct(map_tokens(c("address"))), "_street_words": F.array_distinct(map_tokens(c("_street"))),
            "_city_words": F.array_distinct(map_tokens(c("_city"))), "_code": F.coalesce("_postcode", F.lit("")), "_tel": F.coalesce(phone(c("_phone")), F.lit("")),
            "_from": host(F.when(c("web_site").contains("://"), c("web_site")).otherwise(F.concat(F.lit("https://"), c("web_site")))), "_want": host(F.when(c("_site").contains("://"), c("_site")).otherwise(F.concat(F.lit("https://"), c("_site")))),
        }
    )
    n = F.size("_own")
    share = F.when(n == 0, 0.0).when(_subset(c("_own"), c("_title")), 1.0).otherwise(F.size(F.array_intersect("_own", "_title")) / n)
    coded = F.array_contains("_at", c("_code"))
    site = (F.coalesce("_want", F.lit("")) != "") & (F.coalesce("_from", F.lit("")) != "") & ((c("_from") == c("_want")) | F.endswith("_from", F.concat(F.lit("."), c("_want"))))
    rows = rows.withColumns(
        {
            "name_score": share,
            "address_match": (F.size("_street_words") > 0) & _subset(c("_street_words"), c("_at")) & ((c("_code") == "") | coded),
            "postcode_city_match": (c("_code") != "") & coded & _subset(c("_city_words"), c("_at")),
            "phone_match": (F.length("_tel") >= 5) & (c("_tel") == F.coalesce(phone(c("phone")), F.lit(""))),
            "website_match": site,
            "weak_generic_name": (n == 1) & F.get("_own", F.lit(0)).isin(GENERIC),
            "_key": F.array_join(map_tokens(c("title")), " "),
        }
    )
    joined = lambda x: F.array_join(meaningful_name_tokens(c(x)), " ")
    rows = rows.withColumns({"_name_text": joined("_name"), "_title_text": joined("title")})
    alike = rows.filter("website_match").withColumn("fuzzy_name_score", F.when((c("_name_text") != "") & (c("_title_text") != ""), sequence_ratio(c("_name_text"), c("_title_text"))).otherwise(0.0))
    rows = alike.unionByName(rows.filter("not website_match").withColumn("fuzzy_name_score", F.lit(None).cast("double")))
    source = F.lit(None).cast("string")
    for (org, name), proof in trade_names.items():
        source = F.when((c("organisation_number") == org) & (c("_key") == name), proof).otherwise(source)
    strong = (c("address_match") | c("postcode_city_match")).cast("int") + c("phone_match").cast("int") + c("website_match").cast("int")
    rows = rows.withColumns({"trade_name_match": (c("name_score") == 0) & c("address_match") & c("phone_match") & source.isNotNull(), "trade_name_source": source, "verified_domain_fuzzy_name_match": c("website_match") & (F.coalesce("fuzzy_name_score", F.lit(0.0)) >= 0.85)})
    by_name = (c("name_score") >= 0.99) & (strong >= 1) | (c("name_score") >= 0.66) & (strong >= 2)
    none = ~(c("address_match") | c("phone_match") | c("website_match"))
    accepted = (by_name | c("trade_name_match") | c("verified_domain_fuzzy_name_match")) & ~(c("weak_generic_name") & none)
    points = sum((c(k).cast("double") * w for k, w in WEIGHTS.items()), F.lit(0.0)) + F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1), F.coalesce("review_count", F.lit(0)))) / 5)
    rows = rows.withColumns({"score": F.bround(points, 4), "accepted": accepted})
    return rows.withColumns({x: F.bround(x, 4) for x in ("name_score", "fuzzy_name_score")}).select(*candidates.columns, "name_score", *CHANNELS, "weak_generic_name", "fuzzy_name_score", "trade_name_match", "trade_name_source", "verified_domain_fuzzy_name_match", "score", "accepted")


def chosen(rows: DataFrame) -> DataFrame:
    """TOP3: a row for each company that has candidates: ``status``, how many there are, and the accepted one of the highest score; two that share it
    are ambiguous, and none is chosen."""
    told = F.struct(F.coalesce(F.col("data_id").cast("string"), F.lit("")).alias("data_id"), "position", F.struct(*[c for c in rows.columns if c != "organisation_number"]).alias("row"))
    # By score first, so that a company's highest is one row with the number of those that share it.
    by_score = rows.groupBy("organisation_number", F.when(F.col("accepted"), F.col("score")).alias("_score")).agg(F.count("*").alias("_n"), F.min(told).alias("_first"))
    best = by_score.groupBy("organisation_number").agg(F.sum("_n").alias("candidates"), F.max("_score").alias("_top"), F.max_by(F.struct("_n", "_first"), F.struct(F.col("_score").isNotNull(), "_score")).alias("_b"))
    status = F.when(F.col("_top").isNull(), "no_exact_match").when(F.col("_b._n") > 1, "ambiguous_exact_match").otherwise("exact_match")
    return best.select("organisation_number", status.alias("status"), "candidates", F.when(status == "exact_match", F.col("_b._first.row")).alias("listing"))


#: What a chosen listing gives: its signal, the prefix of its id, the class of its source, the strategy that it belongs to, and when it is there (fixed values).
SIGNALS = [
    ("place_summary", "gmaps-place-", "public_business_listing", "places_identity_resolution", "always"),
    ("company_profile", "gmaps-company-profile-", "public_business_listing", "company_site_identity", "site"),
    ("review_summary", "gmaps-review-summary-", "customer_review_summary", "places_rating_reviews", "rated"),
    ("profile_metrics", "gmaps-profile-metrics-", "public_business_listing", "social_profile_metrics", "rated"),
    ("buzz_metrics", "gmaps-buzz-", "customer_review_summary", "buzz_peer_normalization", "rated"),
]


def observations(choices: DataFrame, retrieved_at: str) -> DataFrame:
    """The observations of chosen listings, for publication rules to judge: an experiment until its rights are reviewed."""
    x = F.col("listing")
    text = lambda c: F.coalesce(x[c].cast("string"), F.lit("None"))
    digest = F.sha2(F.to_json(x, {"ignoreNullFields": "false"}), 256)
    name = F.coalesce(F.nullif(x["place_id"], F.lit("")), F.substring(digest, 1, 16))
    rated = (F.coalesce(x["review_count"], F.lit(0)) > 0) & (x["review_rating"] > 0) & (x["review_rating"] <= 5)
    there = {"always": F.lit(True), "site": F.coalesce(x["web_site"], F.lit("")) != "", "rated": F.coalesce(rated, F.lit(False))}
    one = lambda s: F.when(there[s[4]], F.struct(F.concat(F.lit(s[1]), F.col("organisation_number"), F.lit("-"), name).alias("id"), F.lit(s[0]).alias("signal_type"), F.lit(s[2]).alias("source_class"), F.lit(s[3]).alias("strategy")))
    span = F.concat(text("title"), F.lit("; "), text("address"), F.lit("; "), text("phone"), F.lit("; rating="), text("review_rating"), F.lit("; reviews="), text("review_count"))
    out = choices.filter("status = 'exact_match'").select("organisation_number", x["link"].alias("source_url"), digest.alias("content_sha256"), span.alias("evidence_span"), x["review_rating"].alias("rating"), x["review_count"].alias("review_count"), F.explode(F.array_compact(F.array(*map(one, SIGNALS)))).alias("s"))
    fixed = {"platform": "google_places", "retrieved_at": retrieved_at, "acquisition_mode": "unofficial_api_experiment", "rights_status": "review_required"}
    return out.select("s.id", "organisation_number", "s.signal_type", "s.source_class", "s.strategy", "source_url", "content_sha256", "evidence_span", "rating", "review_count", F.lit(True).alias("exact_entity"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def reviews(choices: DataFrame, retrieved_at: str, most_characters: int = 1200) -> DataFrame:
    """The reviews of chosen listings that have ``user_reviews`` (``review_id, rating, text, published_at, author``), labelled by their stars; one without a
    rating from above 0 to 5 is left out, and one without an id has a hash of itself."""
    rows = choices.filter("status = 'exact_match'").select("organisation_number", F.col("listing.link").alias("source_url"), F.posexplode("listing.user_reviews").alias("at", "r"))
    r = F.col("r")
    rows = rows.filter((r["rating"] > 0) & (r["rating"] <= 5))
    some = lambda x: F.nullif(F.trim(x.cast("string")), F.lit(""))
    name = F.coalesce(some(r["review_id"]), F.substring(F.sha2(F.to_json(r), 256), 1, 20))
    told = F.coalesce(F.substring(some(r["text"]), 1, most_characters), F.concat(F.lit("Explicit customer rating: "), r["rating"].cast("string"), F.lit("/5")))
    fixed = {"platform": "google_places", "signal_type": "review", "source_class": "customer_review", "retrieved_at": retrieved_at, "acquisition_mode": "unofficial_api_experiment", "rights_status": "review_required", "sentiment_model_version": "explicit_star_rating_v1", "strategy": "independent_sentiment"}
    return rows.select(
        F.concat(F.lit("gmaps-review-"), "organisation_number", F.lit("-"), name).alias("id"), "organisation_number", "source_url", told.alias("evidence_span"), r["published_at"].alias("published_at"),
        F.coalesce(some(r["author"]), F.concat(F.lit("anonymous-"), F.col("at").cast("string"))).alias("reviewer_id"), r["rating"].alias("rating"), review_label(r["rating"]).alias("sentiment_label"), F.lit(True).alias("exact_entity"),
        *[F.lit(v).alias(k) for k, v in fixed.items()],
    )
