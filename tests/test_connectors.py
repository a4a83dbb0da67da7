"""Sites, directories, reviewed sources, samples, models, accounts, places and envelopes, on the rows that decide each rule."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from heddle.operators import connectors, envelope, profile

SHA = "a" * 64
SITE = "organisation_number string, status string, identity_score double, source_url string, retrieved_at string, content_sha256 string, extraction_state string, pages array<struct<url:string,title:string,content_sha256:string>>, social_links array<struct<platform:string,url:string>>"


def test_exact_sites_give_activity_and_news(spark):
    pages = [("https://f.no/", "Hjem", SHA), ("https://f.no/nyheter", "Nyheter", SHA), ("https://f.no/Nyheter/2024/a", " Ny fabrikk ", SHA), ("https://f.no/aktuelt/2024/b", "B", SHA), ("https://f.no/newsroom", "x", SHA)]
    rows = [("1", "available", 0.95, "https://f.no/", "t", SHA, "static_complete", pages, [("x", "u")]), ("2", "available", 0.85, "https://g.no/", "t", SHA, "s", pages, []), ("3", "source_error", 1.0, "u", "t", SHA, "s", pages, []), ("4", "available", 1.0, "https://h.no/", "t", "short", "s", [("h.no/news", "n", SHA)], []), ("5", "available", 1.0, "https://i.no/", "t", SHA, "s", [("https://i.no/news/", "", SHA)], [])]
    sites = spark.createDataFrame(rows, SITE)
    activity = {r.organisation_number: r for r in connectors.site_activity(sites).collect()}
    assert set(activity) == {"1", "5"} and activity["1"].evidence_span == "Exact company site snapshot with 5 bounded pages and 1 verified social links." and activity["1"].id == "company-site-activity-1-" + "a" * 16
    news = {r.organisation_number: (r.source_url, r.evidence_span, r.captured_news_pages) for r in connectors.site_news(sites).collect()}
    assert news == {"1": ("https://f.no/Nyheter/2024/a", "Ny fabrikk", 3), "5": ("https://i.no/news/", "Company news/activity page", 1)}


def test_directory_pages_give_ratings_of_exactly_the_company(spark):
    page = lambda name, org, data: f"<html><script type='application/ld+json'>{json.dumps(data)}</script><h1>{name}</h1><p>Org. nr {org}</p><a href='https://search.google.com/local/reviews?x'>r</a></html>"
    rate = lambda v, **n: {"@type": "LocalBusiness", "aggregateRating": {"ratingValue": v} | n}
    profiles = spark.createDataFrame([(f"{k}", f"Fjord {chr(k - 910000001 + 65)} AS", k) for k in range(910000001, 910000008)], "organisation_number string, name string, position long")
    bodies = {
        910000001: page("FJORD A as", "910 000 001", [rate("4.5", ratingCount="12")]), 910000002: page("Fjord B AS", "910000001", rate(4, reviewCount=3)), 910000003: page("Annet", "910000003", rate(4, reviewCount=3)),
        910000004: page("Fjord D AS", "910000004", {"@type": "x"}), 910000005: page("Fjord E AS", "910000005", rate(7, reviewCount=3)), 910000006: page("Fjord F AS", "910000006", rate(3, reviewCount=0)),
    }
    captured = spark.createDataFrame([(str(k), f"https://d.no/{k}", b) for k, b in bodies.items()], "organisation_number string, url string, body string")
    found, told = connectors.directory_ratings(profiles, captured, "t")
    assert [r.status for r in told.orderBy("position").collect()] == ["rated", "identity_mismatch", "identity_mismatch", "not_rated", "invalid_rating", "invalid_rating", "not_captured"]
    rows = found.orderBy("signal_type").collect()
    assert [r.signal_type for r in rows] == ["buzz_metrics", "profile_metrics", "review_summary"] and rows[0].google_review_url.endswith("reviews?x")
    assert rows[0].evidence_span == "Google aggregate rating 4.5/5 based on 12 reviews, embedded on exact Fagfolkguiden company page."


def test_reviewed_sources_need_known_companies_and_hashes(spark):
    profiles = spark.createDataFrame([("1", "A AS")], "organisation_number string, name string")
    seeds = lambda *rows: spark.createDataFrame(rows, "organisation_number string, source_url string, signal_type string, content_sha256 string, proof string, strategy string")
    r = connectors.reviewed_observations(profiles, seeds(("1", "u", "public_mention", SHA, "seen", "")), "t").head()
    assert (r.identity_proof[0].legal_name, r.identity_proof[0].basis, r.strategy, r.rights_status) == ("A AS", "seen", "independent_news_discovery", "review_required")
    for row, fault in ((("2", "u", "s", SHA, "p", ""), "unknown organisation number: 2"), (("1", "u", "s", "ABC", "p", ""), "invalid content hash for 1"), (("1", "u", "s", None, "p", ""), "invalid content hash")):
        with pytest.raises(Exception, match=fault):
            connectors.reviewed_observations(profiles, seeds(row), "t").collect()


def test_one_company_a_host_is_sampled(spark):
    rows = [(f"{k}", ["", None, f"h{k % 7}.no", f"https://www.h{k % 5}.no/x", " "][k % 5]) for k in range(100)]
    register = spark.createDataFrame(rows, "organisation_number string, website string")
    out = spark.createDataFrame([("2",)], "organisation_number string")
    hosts = spark.createDataFrame([("h3.no",)], "host string")
    chosen, told = connectors.website_sample(register, 4, out, hosts)
    got = chosen.collect()
    assert len({r.host for r in got}) == len(got) == 4 and "h3.no" not in {r.host for r in got} and "2" not in {r.organisation_number for r in got}
    again = connectors.website_sample(register.repartition(7), 4, out, hosts)[0].collect()
    assert sorted(got) == sorted(again)
    t = told.head()
    assert (t.registry_rows, t.rows_with_website, t.rows_without_host) == (100, 39, 0) and t.skipped_rows == t.rows_with_website - 4


def test_notes_and_reports_wanted(spark):
    profiles = spark.createDataFrame([("1", None, "12", ["p"]), ("2", "old", None, ["p"]), ("3", "old", "mange", []), ("4", None, "", ["p"])], "organisation_number string, sample_slice string, registered_employees string, pdfs array<string>")
    manifest = spark.createDataFrame([("1", "dev", "new"), ("2", "val", None)], "organisation_number string, evaluation_split string, sample_slice string")
    got = {r.organisation_number: (r.evaluation_split, r.sample_slice) for r in connectors.annotated(profiles, manifest).collect()}
    assert got == {"1": ("dev", "new"), "2": ("val", "old"), "3": (None, "old"), "4": (None, None)}
    wanted = spark.createDataFrame([("4", 0), ("3", 1), ("2", 2), ("1", 3)], "organisation_number string, position int")
    assert [r.organisation_number for r in connectors.reports_wanted(profiles, wanted).orderBy("position").collect()] == ["4", "2"]
    assert [r.organisation_number for r in connectors.reports_wanted(profiles, wanted, 1).collect()] == ["4"]
    with pytest.raises(Exception, match="unknown organisation number: 9"):
        connectors.reports_wanted(profiles, spark.createDataFrame([("9", 0)], "organisation_number string, position int")).collect()


def test_models_see_only_what_is_eligible(spark):
    def load():
        return lambda texts: [(" Positive!" if "bra" in t else "maybe" if "?" in t else "negative", {"positive": 0.5}, len(t)) for t in texts]

    schema = "id string, organisation_number string, text string, exact_entity boolean, source_class string, source_url string, retrieved_at string, evidence_span string, content_sha256 string"
    rows = [("a", "1", "bra", True, "public_news", "u", "t", "s", "h"), ("b", "1", "hva?", True, "public_news", "u", "t", "s", "h"), ("c", "1", "bra", False, "public_news", "u", "t", "s", "h"), ("d", "1", "", True, "blog", "u", "t", "s", "h"), ("e", "1", "dårlig nytt", True, "licensed_news", "u", "t", "s", "h")]
    out, rejected = connectors.inferred(spark.createDataFrame(rows, schema), load, "stub")
    assert {r.id: r.label for r in out.collect()} == {"a": "positive", "b": None, "e": "negative"}
    assert {r.id: r.reasons for r in rejected.collect()} == {"c": ["exact company identity is not verified"], "d": ["source is not an allowed independent class", "missing text"]}
    t = connectors.latencies(out).head()
    assert (t.p50, t.p95, t.n, t.top) == (4.0, 4.0, 3, 11.0)
    assert connectors.inferred(spark.createDataFrame(rows, schema), load, "stub", limit=1)[0].count() == 1


def test_accounts_are_put_in_whole_currency(spark):
    nested = {"resultatregnskapResultat": {"driftsresultat": {"driftsinntekter": {"sumDriftsinntekter": 5.5}, "driftsresultat": -2}, "aarsresultat": "(1 250,5)"}, "egenkapitalGjeld": {"egenkapital": {"sumEgenkapital": "–"}}}
    rows = [({"id": 7, "scale": "i hele tusen", **nested},), ({"record_id": "x", "revenue": 0, **nested},), ({"revenue": "3 000", "operating_result": 0, "currency": "EUR", "period": "2023"},), ({},)]
    got = [r.a for r in spark.createDataFrame([(json.dumps(x),) for (x,) in rows], "j string").select(profile.normalized_account(F.col("j")).alias("a")).collect()]
    assert [(a.record_id, a.revenue, a.operating_result, a.annual_result, a.equity, a.currency) for a in got] == [("7", 5500.0, -2000.0, -1250500.0, None, "NOK"), ("x", 5.5, -2.0, -1250.5, None, "NOK"), (None, 3000.0, None, None, None, "EUR"), (None, None, None, None, None, "NOK")]


def test_places_have_types(spark):
    home = {"adresse": ["Vei 1", "2. etg"], "postnummer": "5004", "poststed": "BERGEN", "kommune": "BERGEN", "kommunenummer": "4601", "land": "Norge"}
    entity = {"forretningsadresse": home, "postadresse": {"adresse": ["Postboks 1"], "poststed": "OSLO", "land": "Sverige"}}
    units = {"_embedded": {"underenheter": [{"organisasjonsnummer": "8", "navn": "Avd", "postadresse": home, "antallAnsatte": 3, "naeringskode1": {"kode": "35.1"}}, {"organisasjonsnummer": "9"}]}}
    rows = [(json.dumps(entity), json.dumps(units)), (json.dumps({"forretningsadresse": home, "postadresse": home}), None), ("{}", "[]")]
    got = [[tuple(x)[:6] + tuple(x)[8:] for x in r.a] for r in spark.createDataFrame(rows, "e string, s string").select(profile.typed_locations(F.col("e"), F.col("s")).alias("a")).collect()]
    line = "Vei 1, 2. etg, 5004 BERGEN"
    assert got[0][0][:4] == ("registered_office", None, None, line) and got[0][1][0] == "postal_address" and got[0][1][3] == "Postboks 1, OSLO, Sverige"
    assert got[0][2][:4] == ("subunit", "8", "Avd", line) and got[0][2][-2:] == (3, "35.1") and got[0][3][:4] == ("subunit", "9", None, None)
    assert [x[0] for x in got[1]] == ["registered_office"] and got[2] == []


def test_envelopes_of_the_contract(spark):
    source = "struct<status:string,source_url:string,source_class:string,retrieved_at:string,content_sha256:string"
    schema = f"organisation_number string, name string, legal_form string, employees int, municipality string, website string, registry {source}>, financials {source},has_records:boolean,revenue:double,operating_result:double,reporting_period:string>, site {source},title:string>"
    reg, fin = ("available", "r", "official", "t1", SHA), ("available", None, None, "t2", SHA, True, 0.0, None, "2023")
    rows = [("912345678", "F AS", "AS", 0, "OSLO", "https://f.no", reg, fin, ("available", "https://f.no/", None, None, None, "F")), ("812345678", "G", "ENK", None, None, "g.no", None, None, ("source_error", None, None, None, None, None)), ("12", None, "AS", 3, "X", None, reg, None, None)]
    out = spark.createDataFrame(rows, schema).select("organisation_number", *[v.alias(k) for k, v in envelope.output_envelope("r1", "t0", "t9").items()])
    got = {r.organisation_number: r for r in out.collect()}
    one = {x.field: x for x in got["912345678"].claims}
    assert list(one) == ["legal_name", "legal_form", "employees", "municipality", "annual_revenue", "operating_result", "official_website"]
    assert (one["employees"].value, one["annual_revenue"].value, one["operating_result"].availability, one["operating_result"].evidence_ids) == ("0", "0.0", "not_available", [])
    assert one["official_website"].evidence_ids == ["ev-912345678-2"] and [e.id for e in got["912345678"].evidence] == [f"ev-912345678-{i}" for i in range(3)] and got["912345678"].evidence[2].retrieved_at == "t9"
    two = {x.field: x for x in got["812345678"].claims}
    assert (two["annual_revenue"].availability, two["official_website"].availability, two["official_website"].confidence) == ("not_applicable", "failed", 0.5) and len(got["812345678"].evidence) == 1
    errors = lambda df: {r.organisation_number: r.e for r in df.select("organisation_number", envelope.envelope_errors().alias("e")).collect()}
    assert errors(out) == {"912345678": [], "812345678": [], "12": ["Invalid organisation_number: '12'"]}
    bad = out.filter("organisation_number = '912345678'").withColumns({"claims": F.transform("claims", lambda x, i: F.when(i == 1, x.withField("availability", F.lit("maybe")).withField("field", F.lit(None).cast("string"))).otherwise(x)), "evidence": F.transform("evidence", lambda x: x.withField("source_url", F.lit(""))), "run": F.lit(None).cast("struct<run_id:string,started_at:string,completed_at:string>"), "operations": F.lit(None).cast("struct<requests:int,runtime_ms:int>")})
    assert errors(bad)["912345678"] == ["Envelope missing valid 'run' section", "Claim #1 missing 'field'", "Claim #1 has invalid availability: 'maybe'", *[f"Evidence #{i} missing required fields (id, source_url, retrieved_at)" for i in range(3)], "Envelope missing valid 'operations' section"]
    assert errors(out.limit(1).withColumns({"claims": F.lit(None).cast(out.schema["claims"].dataType), "evidence": F.lit(None).cast(out.schema["evidence"].dataType)}))["912345678"] == ["Envelope 'claims' must be a list", "Envelope 'evidence' must be a list"]
