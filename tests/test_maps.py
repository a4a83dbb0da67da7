"""Registered domains and map listings, on the cases that decide each rule."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest

from heddle.functions import domains
from heddle.operators import maps


def test_registered_domains(spark):
    cases = {
        "www.fjord.no": ("no", "fjord.no"), "a.b.fjord.co.uk": ("co.uk", "fjord.co.uk"), "co.uk": ("co.uk", None), "X.Y.CK.": ("y.ck", "x.y.ck"), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "ck": ("ck", None), "y.ck": ("y.ck", None),
        "city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"), "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp"), "nore.kommune.no": ("kommune.no", "nore.kommune.no"), "me.github.io": ("github.io", "me.github.io"), "host.unknown": ("unknown", "host.unknown"),
        "localhost": ("localhost", None), "10.0.0.1": (None, None), "": (None, None), "a..b": (None, None), None: (None, None), "ås.no": ("no", "ås.no"),
    }
    rows = spark.createDataFrame([(h, i) for i, h in enumerate([*cases, "www.fjord.no"])], "h string, i int")
    got = domains.with_domain(rows, "h", domains.rules(spark))
    assert got.columns == ["h", "i", "public_suffix", "registered_domain"] and got.count() == len(cases) + 1
    assert {r.h: (r.public_suffix, r.registered_domain) for r in got.collect()} == cases


PROFILE = "organisation_number string, name string, street string, postcode string, city string, phone string, site string"
CANDIDATE = "organisation_number string, position int, place_id string, data_id string, link string, title string, address string, phone string, web_site string, review_count int, review_rating double"


def assess(spark, profile, *candidates):
    p = spark.createDataFrame([profile], PROFILE)
    rows = [(profile[0], i, f"p{i}", f"d{i}", f"l{i}", *c) for i, c in enumerate(candidates)]
    return maps.assessed(p, spark.createDataFrame(rows, CANDIDATE))


def test_neighbours_are_not_the_company(spark):
    got = assess(
        spark, ("938702675", "AF GRUPPEN ASA", "Standardveien 1", "0581", None, "22 89 11 00", "https://afgruppen.no/"),
        ("AF Gruppen", "Standardveien 1, 0581 Oslo, Norge", "+47 22 89 11 00", "https://afgruppen.no/", 21, 2.5), ("AF Eiendom", "Standardveien 1, 0581 Oslo, Norge", "+47 22 89 11 00", "https://afgruppen.no/eiendom/", 0, None),
    )
    rows = {r.title: r for r in got.collect()}
    assert rows["AF Gruppen"].accepted and not rows["AF Eiendom"].accepted
    assert rows["AF Gruppen"].fuzzy_name_score == 1.0 and rows["AF Eiendom"].fuzzy_name_score == round(SequenceMatcher(None, "gruppen", "eiendom").ratio(), 4)


def test_postcode_and_city_serve_as_an_address(spark):
    r = assess(spark, ("999999999", "EXAMPLE INDUSTRI AS", "c/o Accountant Other Street 1", "4021", "STAVANGER", None, None), ("Example Industri AS", "Factory Road 7, 4021 Stavanger, Norway", "", "", 4, None)).head()
    assert r.accepted and r.postcode_city_match and not r.address_match and r.fuzzy_name_score is None


@pytest.mark.parametrize(("org", "phone", "accepted"), [(None, "+47 22 62 00 00", False), ("932083108", "+47 22 62 00 00", True), ("932083108", "+47 99 99 99 99", False)])
def test_trading_names_need_street_and_phone(spark, org, phone, accepted):
    r = assess(spark, (org or "1", "OSLOFJORDEN EIENDOMSMEGLING AS", "Stranden 81", "0250", "Oslo", "22620000", None), ("PrivatMegleren Premium", "Stranden 81, 0250 Oslo", phone, None, None, None)).head()
    assert r.accepted == r.trade_name_match == accepted


def test_the_site_decides_for_names_that_are_nearly_alike(spark):
    got = assess(spark, ("1", "Nordhavn Marine AS", None, None, None, None, "https://www.nordhavn.no/om"), ("Nordhavn Marin", "x", None, "http://butikk.nordhavn.no", 10, None), ("Nordhavn Marin", "x", None, "http://nordhavn.com", 10, None), ("Sørhavn", "x", None, "nordhavn.no", 10, None)).collect()
    assert [r.accepted for r in sorted(got, key=lambda r: r.position)] == [True, False, False]


def test_equal_best_candidates_are_ambiguous(spark):
    profile = ("1", "Fjord Kraft AS", "Vei 1", None, None, "22334455", None)
    same = ("Fjord Kraft", "Vei 1", "22334455", "", 0, None)
    better = ("Fjord Kraft", "Vei 1", "22334455", "", 900, 4.5)
    choice = lambda *c: maps.chosen(assess(spark, profile, *c)).head()
    assert choice(same, same).status == "ambiguous_exact_match"
    r = choice(same, better, same)
    assert (r.status, r.candidates, r.listing.position) == ("exact_match", 3, 1)
    assert choice(("Annet", "x", "", "", 0, None)).status == "no_exact_match"


def test_repeated_results_count_once(spark):
    rows = [("1", 0, "a", None, "l", "old", "x", "", "", 1, None), ("1", 1, "b", None, "l", "other", "x", "", "", 1, None), ("1", 2, "a", None, "l", "new", "x", "", "", 2, None), ("1", 3, "", "", "", "t", "x", "", "", 0, None), ("1", 4, "", "", "", "t", "x", "", "", 0, None), ("2", 5, "a", None, "l", "old", "x", "", "", 1, None)]
    got = sorted((r.organisation_number, r.position, r.title) for r in maps.latest(spark.createDataFrame(rows, CANDIDATE)).collect())
    assert got == [("1", 0, "new"), ("1", 1, "other"), ("1", 3, "t"), ("2", 5, "old")]


def test_a_chosen_listing_gives_its_signals(spark):
    choices = maps.chosen(assess(spark, ("1", "Fjord Kraft AS", "Vei 1", None, None, "22334455", None), ("Fjord Kraft", "Vei 1", "22334455", "https://f.no", 9, 4.5)))
    got = {r.signal_type: r for r in maps.observations(choices, "2024-01-01T00:00:00Z").collect()}
    assert set(got) == {s[0] for s in maps.SIGNALS} and got["buzz_metrics"].strategy == "buzz_peer_normalization"
    assert got["place_summary"].evidence_span == "Fjord Kraft; Vei 1; 22334455; rating=4.5; reviews=9" and got["place_summary"].id == "gmaps-place-1-p0"


def test_reviews_are_labelled_by_their_stars(spark):
    schema = "organisation_number string, status string, listing struct<link:string,user_reviews:array<struct<review_id:string,rating:double,text:string,published_at:string,author:string>>>"
    said = [("a", 5.0, " Bra ", "t", "u1"), ("b", 3.0, "", None, None), (None, 1.0, "x" * 2000, None, ""), ("d", 0.0, "y", None, "u2"), ("e", 5.5, "y", None, "u2"), ("f", None, "y", None, "u2")]
    rows = spark.createDataFrame([("1", "exact_match", ("l", said)), ("2", "ambiguous_exact_match", None), ("3", "exact_match", ("l", None))], schema)
    got = maps.reviews(rows, "t").orderBy("reviewer_id").collect()
    assert [(r.reviewer_id, r.sentiment_label, r.evidence_span[:30], len(r.evidence_span)) for r in got] == [("anonymous-1", "neutral", "Explicit customer rating: 3.0/", 31), ("anonymous-2", "negative", "x" * 30, 1200), ("u1", "positive", "Bra", 3)]
    assert got[2].id == "gmaps-review-1-a" and len(got[1].id) == len("gmaps-review-1-") + 20
