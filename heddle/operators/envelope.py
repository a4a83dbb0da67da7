"""PRJ9-PRJ12, FLT13, SCA27, SCA28: claims with evidence, their validation, terminal states, briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.numbers import currency
from heddle.operators.footprint import reasons

AVAILABILITIES = ["available", "not_available", "not_applicable", "failed", "blocked", "conflicting"]
#: Legal forms by what the rule on annual accounts says (fixed values).
ALWAYS_FORMS = ["AS", "ASA", "BRL", "BBL", "STI", "SF", "VPFO"]
THRESHOLD_FORMS = ["ENK", "ANS", "DA", "SA", "FLI", "ESEK", "NUF", "UTLA", "ORGL", "SAM", "SPA", "KS", "BO"]
NO_ACCOUNTS_FORMS = ["ENK", "FLI"]


def availability(known: Column) -> Column:
    return F.when(known, "available").otherwise("not_available")


def _claim(field: str, value: Column, state: Column, evidence: Column, confidence: Column | float = 1.0) -> Column:
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), state.alias("availability"), confidence.cast("double").alias("confidence"), evidence.alias("evidence_id"))


def claims() -> Column:
    """PRJ9: a company's claims in order, each with the id of what proves it. A missing number is never zero; names of evidence
    count on in the order in which sources are used."""
    c = F.col
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    ev = lambda n: F.concat(F.lit("ev-"), c("organisation_number"), F.lit("-"), F.lit(n) if isinstance(n, str) else n)
    money, web = c("revenue").isNotNull(), c("website").isNotNull() & (c("website") != "")
    own, broken = web & (c("web_status") == "available"), web & (c("web_status") == "source_error")
    revenue_state = F.when(money, "available").when(c("legal_form").isin(NO_ACCOUNTS_FORMS), "not_applicable").otherwise("not_available")
    return F.array(
        _claim("legal_name", c("name"), availability(some(c("name"))), ev("1")),
        _claim("legal_form", c("legal_form"), availability(some(c("legal_form"))), ev("1")),
        _claim("employees", c("employees"), availability(c("employees").isNotNull()), F.when(c("employees").isNotNull(), ev("1"))),
        _claim("municipality", c("municipality"), availability(some(c("municipality"))), F.when(some(c("municipality")), ev("1"))),
        _claim("annual_revenue", c("revenue"), revenue_state, F.when(money, ev("2"))),
        _claim(
            "official_website", F.when(web, c("website")), F.when(~web, "not_available").when(broken, "failed").otherwise("available"),
            F.when(own, ev(F.when(money, "3").otherwise("2"))).when(web & ~broken, ev("1")), F.when(own, 0.95).when(broken, 0.5).otherwise(1.0),
        ),
    )


#: Availabilities that a claim may have by the contract (fixed values).
CONTRACT_AVAILABILITIES = ["available", "not_available", "blocked", "not_applicable", "ambiguous", "failed"]
NO_HASH = "0" * 64


def output_envelope(run_id: str, started_at: str, completed_at: str) -> dict[str, Column]:
    """PRJ9, PRJ11: the columns of a company's envelope by the contract: run, claims, evidence, changes, errors and operations.

    Needs ``organisation_number, name, legal_form, employees, municipality, website`` and the structs ``registry``, ``financials`` and ``site`` of ``status, source_url, source_class,
    retrieved_at, content_sha256`` (null: not fetched); ``financials`` also has ``has_records, revenue, operating_result, reporting_period`` of the latest record, ``site`` also ``title``.
    Evidence is numbered from 0 in the order in which sources are used, and each claim cites the evidence that it is taken from.
    """
    c = F.col
    org, some = c("organisation_number"), lambda x: F.coalesce(x, F.lit("")) != ""
    money = F.coalesce(c("financials.has_records"), F.lit(False))
    url = F.coalesce(F.nullif(c("website"), F.lit("")), c("site.source_url"))
    own, broken = some(url) & F.coalesce(c("site.status") == "available", F.lit(False)), some(url) & F.coalesce(c("site.status") == "source_error", F.lit(False))
    ev = lambda n: F.concat(F.lit("ev-"), org, F.lit("-"), n.cast("string") if isinstance(n, Column) else F.lit(str(n)))
    site_ev = ev(F.when(money, 2).otherwise(1))
    none = F.array().cast("array<string>")

    def claim(field: str, value: Column, availability: Column, cites: Column, confidence: Column | float = 1.0) -> Column:
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), availability.alias("availability"), confidence.alias("confidence"), cites.alias("evidence_ids"))

    known = lambda x: F.when(x, "available").otherwise("not_available")
    cited = lambda x, e: F.when(x, F.array(e)).otherwise(none)
    amount = lambda f: claim(f"annual_{f}" if f == "revenue" else f, c(f"financials.{f}"), known(c(f"financials.{f}").isNotNull()), cited(c(f"financials.{f}").isNotNull(), ev(1)))
    no_accounts = claim("annual_revenue", F.lit(None), F.when(c("legal_form").isin(NO_ACCOUNTS_FORMS), "not_applicable").otherwise("not_available"), none)
    claims = F.concat(
        F.array(
            claim("legal_name", c("name"), known(some(c("name"))), F.array(ev(0))), claim("legal_form", c("legal_form"), known(some(c("legal_form"))), F.array(ev(0))), claim("employees", c("employees"), known(c("employees").isNotNull()), cited(c("employees").isNotNull(), ev(0))),
            claim("municipality", c("municipality"), known(some(c("municipality"))), cited(some(c("municipality")), ev(0))),
        ),
        F.when(money, F.array(amount("revenue"), amount("operating_result"))).otherwise(F.array(no_accounts)),
        F.array(claim("official_website", F.when(some(url), url), F.when(~some(url), "not_available").when(broken, "failed").otherwise("available"), F.when(own, F.array(site_ev)).when(some(url) & ~broken, F.array(ev(0))).otherwise(none), F.when(own, 0.95).when(broken, 0.5).otherwise(1.0))),
    )

    def proof(name: str, number: Column, source: Column, kind: Column, span: Column) -> Column:
        return F.struct(number.alias("id"), source.alias("source_url"), kind.alias("source_class"), F.coalesce(f"{name}.retrieved_at", F.lit(completed_at)).alias("retrieved_at"), F.coalesce(f"{name}.content_sha256", F.lit(NO_HASH)).alias("content_sha256"), span.alias("claim_span"))

    register = proof("registry", ev(0), F.coalesce("registry.source_url", F.concat(F.lit("https://data.brreg.no/enhetsregisteret/api/enheter/"), org)), F.coalesce("registry.source_class", F.lit("official_registry")), F.concat(F.coalesce("name", F.lit("")), F.lit(", "), org))
    accounts = proof("financials", ev(1), F.coalesce("financials.source_url", F.concat(F.lit("https://data.brreg.no/regnskapsregisteret/regnskap/"), org)), F.lit("official_annual_accounts"), F.concat(F.lit("Annual accounts filed for "), F.coalesce("financials.reporting_period", F.lit("2025"))))
    page = proof("site", site_ev, url, F.lit("company_owned"), F.coalesce("site.title", F.concat(F.lit("Official site for "), F.coalesce("name", F.lit("None")))))
    return {
        "run": F.struct(F.lit(run_id).alias("run_id"), F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), F.lit("completed").alias("terminal_status")), "claims": claims,
        "evidence": F.array_compact(F.array(register, F.when(money, accounts), F.when(own, page))), "changes": none, "errors": none, "operations": F.struct(F.lit(0).alias("requests"), F.lit(0).alias("runtime_ms"), F.lit(0.0).alias("third_party_cost_usd")),
    }


def envelope_errors() -> Column:
    """FLT13: what is wrong with an envelope of the contract's columns, in order; claims and evidence are told by their number."""
    c = F.col
    odd = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
    numbered = lambda column, rule: F.array_compact(F.flatten(F.transform(column, rule)))
    said = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    at = lambda i: i.cast("string")
    quoted = lambda x: F.coalesce(F.concat(F.lit("'"), x, F.lit("'")), F.lit("None"))
    head = F.array_compact(
        F.array(
            said(~F.coalesce(c("organisation_number").rlike("^[0-9]{9}$"), F.lit(False)), "Invalid organisation_number: ", quoted(c("organisation_number"))), said(odd(c("run.run_id")) | odd(c("run.started_at")) | odd(c("run.completed_at")), "Envelope missing valid 'run' section"),
            said(c("claims").isNull(), "Envelope 'claims' must be a list"),
        )
    )
    claims = numbered("claims", lambda x, i: F.array(said(odd(x["field"]), "Claim #", at(i), " missing 'field'"), said(~F.coalesce(x["availability"].isin(CONTRACT_AVAILABILITIES), F.lit(False)), "Claim #", at(i), " has invalid availability: ", quoted(x["availability"]))))
    proofs = numbered("evidence", lambda x, i: F.array(said(odd(x["id"]) | odd(x["source_url"]) | odd(x["retrieved_at"]), "Evidence #", at(i), " missing required fields (id, source_url, retrieved_at)")))
    none = F.array().cast("array<string>")
    rest = F.array_compact(F.array(said(c("operations").isNull() | c("operations.requests").isNull() | c("operations.runtime_ms").isNull(), "Envelope missing valid 'operations' section")))
    return F.concat(head, F.coalesce(claims, none), F.when(c("evidence").isNull(), F.array(F.lit("Envelope 'evidence' must be a list"))).otherwise(proofs), rest)


def contract_errors() -> Column:
    """FLT13, JN14: what is wrong with an envelope of ``org, run, claims, evidence_ids``."""
    c = F.col
    cited = F.filter(F.transform("claims", lambda x: x["evidence_id"]), lambda x: x.isNotNull())
    return reasons(
        [
            ("Invalid organisation_number", ~c("org").rlike("^[0-9]{9}$")),
            ("Envelope missing valid run section", c("run.run_id").isNull() | c("run.started_at").isNull() | c("run.completed_at").isNull()),
            ("Claim has invalid availability", F.exists("claims", lambda x: ~F.coalesce(x["availability"].isin(AVAILABILITIES), F.lit(False)))),
            ("Claim cites unknown evidence", F.size(F.array_except(cited, c("evidence_ids"))) > 0),
        ]
    )


def terminal_state(status: Column, note: Column) -> Column:
    """SCA28."""
    robots = F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit("robot"))
    return (
        F.when(status == "available", "complete").when(status.isin("not_applicable", "not_found", "source_error"), status)
        .when(status == "blocked", F.when(robots, "blocked_robots").otherwise("blocked_policy")).otherwise("submission_error")
    )


def accounting_obligation(form: Column, latest: Column) -> Column:
    """SCA27: a filing that was seen, a form that always must, one that must above thresholds, or none of these."""
    form = F.upper(F.coalesce(form, F.lit("")))
    return F.when(latest.isNotNull(), "filing_observed").when(form.isin(ALWAYS_FORMS), "required_by_legal_form").when(form.isin(THRESHOLD_FORMS), "threshold_or_activity_dependent").otherwise("special_rule_or_review_required")


def brief(rows: DataFrame) -> Column:
    """PRJ12: what is known of a company in five sentences, and what isn't. Needs ``name`` and ``organisation_number``; read if there are
    such columns: ``legal_form``, ``municipality``, ``employees``, ``industry_label``, ``leaders`` (an array of ``name, role``), ``roles_status``,
    ``period``, ``revenue``, ``operating_result``, ``assets`` of the latest accounts (``period`` tells that there are any), ``latest_submitted_accounts``,
    ``website`` and ``website_status``."""
    col = lambda name, kind="string": F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    given = lambda name: F.coalesce(col(name).cast("string"), F.lit("")) != ""
    told = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    staff = col("employees", "bigint")
    where = F.when(given("municipality"), told(" based in ", col("municipality"))).otherwise("")
    people = F.when(staff.isNotNull(), told(" with ", staff.cast("string"), " registered employee", F.when(staff != 1, "s").otherwise(""))).otherwise("")
    label = lambda name, other: F.when(given(name), col(name)).otherwise(F.lit(other))
    leaders = F.slice(F.coalesce(col("leaders", "array<struct<name:string,role:string>>"), F.array().cast("array<struct<name:string,role:string>>")), 1, 2)
    lead = F.array_join(F.transform(leaders, lambda x: told(x["name"], " (", F.coalesce(x["role"], F.lit("Executive")), ")")), ", ")
    money = lambda name: currency(col(name).cast("double"))
    accounts = (
        F.when(given("period"), told("Financials (", col("period").cast("string"), "): Operating revenue of ", money("revenue"), ", operating result of ", money("operating_result"), ", total assets of ", money("assets"), "."))
        .when(given("latest_submitted_accounts"), told("Financials: Latest submitted annual accounts on record for year ", col("latest_submitted_accounts").cast("string"), "."))
        .otherwise("Financials: No filed annual accounts observed in official register.")
    )
    site = (
        F.when(~given("website"), "Web Presence: No official website URL registered.")
        .when(col("website_status") == "available", told("Verified official web domain: ", col("website"), "."))
        .when(col("website_status").isin("not_found", "source_error"), told("Registered website URL (", col("website"), ") was uncontactable or failed to respond."))
    )
    unknown = F.array_compact(F.array(F.when(staff.isNull(), "registered employee headcount"), F.when(~given("period"), "detailed financial accounting breakdown"), F.when(~given("website"), "verified official web domain")))
    return F.concat_ws(
        " ",
        told(label("name", "The company"), " (", F.col("organisation_number"), ") is a Norwegian ", label("legal_form", "entity"), where, people, ", active in ", label("industry_label", "commercial operations"), "."),
        F.when(F.size(leaders) > 0, told("Leadership: ", lead, ".")).when(col("roles_status") == "not_found", "Leadership: No official roles registered in the company register."),
        accounts,
        site,
        F.when(F.size(unknown) > 0, told("Unobserved information: ", F.array_join(unknown, ", "), ".")),
    )
