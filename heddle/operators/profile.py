"""PRJ2-PRJ7, QRY4: captured register responses as profile columns, and cited answers from them.

Responses are JSON strings. What a response lacks is null, never zero; a response that isn't of the expected shape
(null, text, an object for a list) has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.numbers import norwegian_number, scale_factor
from heddle.functions.urls import bound

#: The register's field of each profile field (fixed values).
ENTITY = {
    "organisation_number": ("$.organisasjonsnummer", "string"), "name": ("$.navn", "string"), "legal_form": ("$.organisasjonsform.kode", "string"),
    "employees": ("$.antallAnsatte", "bigint"), "bankrupt": ("$.konkurs", "boolean"), "liquidating": ("$.underAvvikling", "boolean"),
    "website": ("$.hjemmeside", "string"), "industry": ("$.naeringskode1", "string"), "business_address": ("$.forretningsadresse", "string"),
    "postal_address": ("$.postadresse", "string"), "latest_submitted_accounts": ("$.sisteInnsendteAarsregnskap", "string"),
}
ACCOUNT = {
    "record_id": "id", "account_type": "regnskapstype", "period": "regnskapsperiode", "currency": "valuta",
    "revenue": "resultatregnskapResultat.driftsresultat.driftsinntekter.sumDriftsinntekter", "operating_result": "resultatregnskapResultat.driftsresultat.driftsresultat",
    "profit_before_tax": "resultatregnskapResultat.ordinaertResultatFoerSkattekostnad", "annual_result": "resultatregnskapResultat.aarsresultat",
    "assets": "eiendeler.sumEiendeler", "equity": "egenkapitalGjeld.egenkapital.sumEgenkapital", "debt": "egenkapitalGjeld.gjeldOversikt.sumGjeld",
}
_ACCOUNTS = """array<struct<id: string, regnskapstype: string, regnskapsperiode: struct<fraDato: string, tilDato: string>, valuta: string,
  resultatregnskapResultat: struct<driftsresultat: struct<driftsinntekter: struct<sumDriftsinntekter: double>, driftsresultat: double>, ordinaertResultatFoerSkattekostnad: double, aarsresultat: double>,
  eiendeler: struct<sumEiendeler: double>, egenkapitalGjeld: struct<egenkapital: struct<sumEgenkapital: double>, gjeldOversikt: struct<sumGjeld: double>>>>"""
#: Birth dates are no part of the schema, so they are never read.
_ROLES = """struct<rollegrupper: array<struct<sistEndret: string, type: struct<kode: string, beskrivelse: string>, roller: array<struct<
  type: struct<kode: string, beskrivelse: string>, person: struct<navn: struct<fornavn: string, mellomnavn: string, etternavn: string>>,
  enhet: struct<organisasjonsnummer: string, navn: string>, avregistrert: boolean>>>>>"""
_SUBUNITS = """struct<_embedded: struct<underenheter: array<struct<organisasjonsnummer: string, navn: string, beliggenhetsadresse: string, postadresse: string,
  naeringskode1: string, antallAnsatte: bigint>>>>"""
MOST_RECORDS, MOST_CITED = 3, 12


def entity(body: Column) -> dict[str, Column]:
    """PRJ2: the profile's own columns; objects (addresses, industry) as JSON."""
    return {name: F.get_json_object(body, path).try_cast(kind) for name, (path, kind) in ENTITY.items()}


def _listed(body: Column) -> Column:
    return F.when(F.ltrim(body).startswith("["), body)


def accounts(body: Column) -> Column:
    """PRJ3: the first three records of the response, which lists the latest first, with eleven fields each."""

    def at(record: Column, path: str) -> Column:
        for key in path.split("."):
            record = record[key]
        return record

    records = F.slice(F.coalesce(F.from_json(_listed(body), _ACCOUNTS), F.array()), 1, MOST_RECORDS)
    return F.transform(records, lambda r: F.struct(*[at(r, path).alias(name) for name, path in ACCOUNT.items()]))


def history(body: Column, organisation_number: Column, url: str) -> Column:
    """PRJ5: the different years among the entries of a list, ascending, and their documents, latest first. ``url`` holds {org} and {year}."""
    years = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.from_json(_listed(body), "array<string>"), F.array()), lambda y: y.rlike("^[0-9]+$"))))
    pdf = lambda y: F.replace(F.replace(F.lit(url), F.lit("{org}"), organisation_number), F.lit("{year}"), y)
    return F.struct(years.alias("years"), F.transform(F.reverse(years), lambda y: F.struct(y.alias("year"), pdf(y).alias("url"))).alias("pdfs"))


def roles(body: Column) -> Column:
    """PRJ6: one element for each role of each group, held by a person or another entity."""

    def one(group: Column, role: Column) -> Column:
        parts = F.filter(F.array(*[role["person"]["navn"][p] for p in ("fornavn", "mellomnavn", "etternavn")]), lambda x: F.coalesce(x, F.lit("")) != "")
        shown = lambda x: F.when(x != "", x)
        return F.struct(
            F.coalesce(shown(F.array_join(parts, " ")), shown(role["enhet"]["navn"])).alias("name"), role["enhet"]["organisasjonsnummer"].alias("organisation_number"),
            role["type"]["kode"].alias("role_code"), role["type"]["beskrivelse"].alias("role"), group["type"]["kode"].alias("group_code"), group["type"]["beskrivelse"].alias("group"),
            group["sistEndret"].alias("last_changed"), F.coalesce(role["avregistrert"], F.lit(False)).alias("inactive"),
        )

    groups = F.coalesce(F.from_json(body, _ROLES)["rollegrupper"], F.array())
    return F.flatten(F.transform(groups, lambda g: F.transform(F.coalesce(g["roller"], F.array()), lambda r: one(g, r))))


def locations(body: Column) -> Column:
    """PRJ7: the subunits, at their place or else their postal address."""
    units = F.coalesce(F.from_json(body, _SUBUNITS)["_embedded"]["underenheter"], F.array())
    address = lambda u: F.coalesce(F.when(u["beliggenhetsadresse"] != "", u["beliggenhetsadresse"]), u["postadresse"])
    return F.transform(units, lambda u: F.struct(u["organisasjonsnummer"].alias("organisation_number"), u["navn"].alias("name"), address(u).alias("address"), u["naeringskode1"].alias("industry"), u["antallAnsatte"].alias("employees")))


#: Amounts of an account record: the name that it may have itself, which counts first, and its path in the register's response (fixed values).
AMOUNTS = {name: path for name, path in ACCOUNT.items() if name not in ("record_id", "account_type", "period", "currency")}


def normalized_account(record: Column, default_scale: float = 1.0) -> Column:
    """PRJ4: an account record, as JSON, in whole currency: names, period and currency, and each amount from its own name or else its nested path, as a number
    or as a Norwegian text, times the unit that ``scale`` tells. What is missing is null; a number 0 of its own gives way to the nested one."""
    def read(v: Column) -> Column:
        at = lambda path: F.nullif(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))
        scale = bound(at("scale"), lambda told: F.when(told.isNotNull(), scale_factor(told)).otherwise(F.lit(default_scale)))

        def amount(name: str, path: str, scale: Column) -> Column:
            # Only a number may be zero and give way; a text that says zero is what was told.
            told = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING"
            zero = lambda x: (x.try_cast("double") == 0) & ~F.coalesce(told, F.lit(False))
            raw = F.coalesce(bound(at(name), lambda x: F.when(~F.coalesce(zero(x), F.lit(False)), x)), at(path))
            return bound(raw, lambda x: F.coalesce(x.try_cast("double") * scale, norwegian_number(x, scale, bound)))

        named = [F.coalesce(at("id"), at("record_id")).alias("record_id"), F.coalesce(at("regnskapstype"), at("account_type")).alias("account_type"), F.coalesce(at("regnskapsperiode"), at("period")).alias("reporting_period"), F.coalesce(at("valuta"), at("currency"), F.lit("NOK")).alias("currency")]
        return bound(scale, lambda s: F.struct(*named, *[amount(n, p, s).alias(n) for n, p in AMOUNTS.items()]))

    return bound(F.try_parse_json(record), read)


_ADDRESS = "struct<adresse: array<string>, postnummer: string, poststed: string, kommune: string, kommunenummer: string, land: string>"
_UNITS = f"struct<_embedded: struct<underenheter: array<struct<organisasjonsnummer: string, navn: string, beliggenhetsadresse: {_ADDRESS}, postadresse: {_ADDRESS}, antallAnsatte: bigint, naeringskode1: struct<kode: string>>>>>"


def formatted_address(a: Column) -> Column:
    """SCA21: an address of the register as one line: its lines, postcode and city (or municipality), and its country if that isn't Norge; null without any."""
    some = lambda x: F.nullif(x, F.lit(""))
    city = F.coalesce(some(a["poststed"]), some(a["kommune"]))
    lines = F.when(F.size(F.coalesce(a["adresse"], F.array())) > 0, F.array_join(a["adresse"], ", "))
    place = F.when(some(a["postnummer"]).isNotNull() & city.isNotNull(), F.concat_ws(" ", a["postnummer"], city)).otherwise(city)
    return F.nullif(F.concat_ws(", ", lines, place, F.when(some(a["land"]) != "Norge", a["land"])), F.lit(""))


def typed_locations(entity_body: Column, subunits_body: Column) -> Column:
    """PRJ7: a company's places in order, each with its type: the registered office, the postal address if it is another, and the subunits."""
    body = F.from_json(entity_body, f"struct<forretningsadresse: {_ADDRESS}, postadresse: {_ADDRESS}>")
    business, postal = body["forretningsadresse"], body["postadresse"]
    none = F.lit(None).cast("string")

    def own(kind: str, a: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), none.alias("organisation_number"), none.alias("name"), formatted_address(a).alias("address"), a["kommune"].alias("municipality"), a["kommunenummer"].alias("municipality_number"), a["postnummer"].alias("postal_code"), a["poststed"].alias("city"), F.lit(None).cast("bigint").alias("employees"), none.alias("industry"))

    def unit(u: Column) -> Column:
        a = F.coalesce(u["beliggenhetsadresse"], u["postadresse"])
        return F.struct(F.lit("subunit").alias("type"), u["organisasjonsnummer"].alias("organisation_number"), u["navn"].alias("name"), formatted_address(a).alias("address"), none.alias("municipality"), none.alias("municipality_number"), none.alias("postal_code"), none.alias("city"), u["antallAnsatte"].alias("employees"), u["naeringskode1"]["kode"].alias("industry"))

    here, there = formatted_address(business), formatted_address(postal)
    first = F.array_compact(F.array(F.when(here.isNotNull(), own("registered_office", business)), F.when(there.isNotNull() & ~there.eqNullSafe(here), own("postal_address", postal))))
    units = F.coalesce(F.from_json(subunits_body, _UNITS)["_embedded"]["underenheter"], F.array())
    return F.concat(first, F.transform(units, unit))


#: Words that lead to a topic (fixed values).
FINANCIAL = ["financial", "finance", "account", "revenue", "income", "profit", "result", "debt", "asset", "regnskap"]
ROUTES = {"registry": ["employee"], "financials": FINANCIAL, "roles": ["lead", "role"], "locations": ["location", "where"], "website": ["social"], "sentiment": ["sentiment"]}
#: What an answer says of a topic without data (fixed values).
ABSENT = {
    "financials": "No normalized annual-account record was returned; missing values are not interpreted as zero.",
    "roles": "No active public role holder was returned.",
    "locations": "No registered subunit was returned; this does not prove the company has no physical presence.",
    "quarantined": "A registry-linked website was fetched, but exact legal-entity identity was not established; its claims and social links are quarantined.",
    "website": "The registry-linked company website was not available to this run.",
    "sentiment": "Sentiment is not scored: no labelled Norwegian news/social evaluation corpus has been run, and company-owned pages are structurally promotional.",
}
REGISTERED = {"Registered name": "name", "Organisation number": "organisation_number", "Legal form": "legal_form", "Municipality": "municipality", "Registry employee count": "employees"}
REPORTED = {"Revenue": "revenue", "Operating result": "operating_result", "Annual result": "annual_result", "Assets": "assets", "Debt": "debt"}


def _fact(claim: Column, value: Column, module: str, kind: str) -> Column:
    return F.struct(claim.alias("claim"), value.cast("string").alias("value"), F.lit(module).alias("module"), F.lit(kind).alias("classification"))


def answer(question: Column) -> dict[str, Column]:
    """QRY4: ``facts`` and ``unsupported`` for a question, from the columns of a profile.

    Needs name, organisation_number, legal_form, municipality, employees, ``accounts``, ``roles`` and ``locations`` as made above, and ``website``
    (struct of status, publishable, description, social_links). A question that names no topic asks for all but sentiment.
    """
    c = F.col
    q = F.lower(F.coalesce(question, F.lit("")))
    named = {t: F.greatest(*[F.contains(q, F.lit(w)) for w in words], F.lit(False)) for t, words in ROUTES.items()}
    everything = ~F.greatest(*named.values())
    on = lambda t: everything | named[t]
    none = F.array().cast("array<struct<claim: string, value: string, module: string, classification: string>>")
    given = lambda facts: F.filter(facts, lambda f: F.coalesce(f["value"], F.lit("")) != "")
    some = lambda cond, facts: F.when(cond, given(facts)).otherwise(none)
    latest = F.get("accounts", F.lit(0))
    active = F.filter("roles", lambda r: ~r["inactive"])
    site, may = c("website"), F.coalesce(c("website.publishable"), F.lit(True))
    facts = F.concat(
        some(on("registry"), F.array(*[_fact(F.lit(k), c(v), "registry", "official_registry_fact") for k, v in REGISTERED.items()])),
        some(on("financials"), F.array(_fact(F.lit("Reporting period"), F.to_json(latest["period"]), "financials", "official_annual_account"), *[_fact(F.lit(k), latest[v], "financials", "official_annual_account") for k, v in REPORTED.items()])),
        F.when(on("roles"), F.transform(F.slice(active, 1, MOST_CITED), lambda r: _fact(F.coalesce(r["role"], r["group"], F.lit("Registered role")), F.coalesce(r["name"], r["organisation_number"]), "roles", "official_role_record"))).otherwise(none),
        F.when(on("locations"), F.transform(F.slice("locations", 1, MOST_CITED), lambda u: _fact(F.lit("Registered subunit"), F.to_json(F.struct(u["name"].alias("name"), u["address"].alias("address"))), "locations", "official_subunit_record"))).otherwise(none),
        some(on("website") & may, F.array(_fact(F.lit("Website description"), site["description"], "website", "company_reported_claim"))),
        F.when(on("website") & may, F.transform(F.coalesce(site["social_links"], F.array()), lambda s: _fact(F.concat(F.lit("Declared "), s["platform"], F.lit(" profile")), s["url"], "website", "company_linked_social_profile"))).otherwise(none),
    )
    fetched = F.coalesce(site["status"] == "available", F.lit(False))
    lacking = {
        "financials": on("financials") & (F.size("accounts") == 0), "roles": on("roles") & (F.size(active) == 0), "locations": on("locations") & (F.size("locations") == 0),
        "quarantined": on("website") & fetched & ~may, "website": on("website") & ~fetched, "sentiment": named["sentiment"],
    }
    return {"facts": facts, "unsupported": F.array_compact(F.array(*[F.when(cond, F.lit(ABSENT[t])) for t, cond in lacking.items()]))}
