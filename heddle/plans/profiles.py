"""Profiles and answers from captured register responses; each order stands for a company with its responses as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import profile
from heddle.registry import query
from heddle.session import table

_ASKED = ["", "Who leads it?", "What are its accounts?", "Where is it?", "Which social profiles?", "Sentiment, and employees?", "Everything about it"]
_PDF = "https://register.example.com/{org}/{year}"

_ENTITY = """to_json(named_struct('organisasjonsnummer', lpad(string(k), 9, '0'), 'navn', concat('Firma ', k), 'organisasjonsform', named_struct('kode', if(k % 2 = 0, 'AS', 'ENK')),
  'antallAnsatte', if(k % 5 = 0, null, k % 200), 'konkurs', k % 11 = 0, 'hjemmeside', if(k % 3 = 0, concat('f', k, '.example.com'), null), 'forretningsadresse', named_struct('kommune', concat('K', k % 30))))"""
_ACCOUNTS = """if(k % 17 = 0, null, if(k % 13 = 0, '{"id": "r0"}', to_json(transform(slice(array(0, 1, 2, 3), 1, int(k % 5)), i -> named_struct('id', concat('r', i), 'valuta', 'NOK',
  'regnskapsperiode', named_struct('fraDato', concat(2023 - i, '-01-01'), 'tilDato', concat(2023 - i, '-12-31')),
  'resultatregnskapResultat', named_struct('driftsresultat', named_struct('driftsinntekter', named_struct('sumDriftsinntekter', double(k % 1000 + i)), 'driftsresultat', if(i = 1, null, double(k % 700 - 300))), 'aarsresultat', double(k % 90 - i)),
  'eiendeler', named_struct('sumEiendeler', double(k % 800)), 'egenkapitalGjeld', named_struct('gjeldOversikt', named_struct('sumGjeld', double(k % 600))))))))"""
_HISTORY = "if(k % 7 = 0, '{}', to_json(array(string(2015 + k % 9), '2020', 'x', string(2015 + k % 9))))"
_ROLES = """if(k % 19 = 0, null, to_json(named_struct('rollegrupper', array(
  named_struct('sistEndret', '2024-01-01', 'type', named_struct('kode', 'DAGL', 'beskrivelse', 'Daglig leder'), 'roller', array(named_struct('type', named_struct('kode', 'DAGL', 'beskrivelse', 'Daglig leder'),
    'person', named_struct('fodselsdato', '1970-01-01', 'navn', named_struct('fornavn', 'Ola', 'mellomnavn', if(k % 2 = 0, 'M', null), 'etternavn', concat('N', k))), 'enhet', null, 'avregistrert', k % 4 = 0))),
  named_struct('sistEndret', '2023-01-01', 'type', named_struct('kode', 'REVI', 'beskrivelse', 'Revisor'), 'roller', if(k % 3 = 0, array(), array(named_struct('type', named_struct('kode', 'REVI', 'beskrivelse', null),
    'person', null, 'enhet', named_struct('organisasjonsnummer', concat('9', k), 'navn', concat('Revisor ', k)), 'avregistrert', null))))))))"""
_SUBUNITS = """if(k % 4 = 0, '{}', to_json(named_struct('_embedded', named_struct('underenheter', transform(sequence(1, int(k % 4)), i -> named_struct('organisasjonsnummer', concat('8', k, i), 'navn', concat('Avd ', i),
  'beliggenhetsadresse', if(i = 2, null, named_struct('kommune', concat('K', i))), 'postadresse', named_struct('kommune', concat('P', i)), 'antallAnsatte', k % 20))))))"""


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))


@query("entity_normalise", """select k, lpad(cast(k as varchar), 9, '0') as organisation_number, 'Firma ' || k as name, case when k % 2 = 0 then 'AS' else 'ENK' end as legal_form, case when k % 5 <> 0 then k % 200 end as employees,
  k % 11 = 0 as bankrupt, cast(null as boolean) as liquidating, case when k % 3 = 0 then 'f' || k || '.example.com' end as website, cast(null as varchar) as industry, '{"kommune":"K' || (k % 30) || '"}' as business_address,
  cast(null as varchar) as postal_address, cast(null as varchar) as latest_submitted_accounts from (select o_orderkey as k from orders)""")
def entity_normalise(spark, sf_dir):
    """PRJ2."""
    body = _keys(spark, sf_dir).select("k", F.expr(_ENTITY).alias("body"))
    return body.select("k", *[c.alias(n) for n, c in profile.entity(F.col("body")).items()])


_RECORDS_SQL = "r as (select k, i from (select o_orderkey as k from orders), range(4) t(i) where i < k % 5 and i < 3 and k % 17 <> 0 and k % 13 <> 0)"


@query("accounts_latest3", f"""with {_RECORDS_SQL} select k, i as place, 'r' || i as record_id, cast(null as varchar) as account_type, (2023 - i) || '-12-31' as until, 'NOK' as currency, cast(k % 1000 + i as double) as revenue, case when i <> 1 then cast(k % 700 - 300 as double) end as operating_result,
  cast(null as double) as profit_before_tax, cast(k % 90 - i as double) as annual_result, cast(k % 800 as double) as assets, cast(null as double) as equity, cast(k % 600 as double) as debt from r""")
def accounts_latest3(spark, sf_dir):
    """PRJ3: the first three records with their eleven fields; a response that is no list has none."""
    rows = _keys(spark, sf_dir).select("k", F.posexplode(profile.accounts(F.expr(_ACCOUNTS))).alias("place", "a"))
    return rows.select("k", F.col("place").cast("bigint").alias("place"), *[F.col(f"a.{n}.tilDato").alias("until") if n == "period" else F.col(f"a.{n}") for n in profile.ACCOUNT])


@query("account_history", """select k, case when k % 7 = 0 then '' else array_to_string(list_sort(list_distinct([cast(2015 + k % 9 as varchar), '2020'])), ',') end as years,
  case when k % 7 <> 0 then 'https://register.example.com/' || lpad(cast(k as varchar), 9, '0') || '/' || greatest(2015 + k % 9, 2020) end as latest from (select o_orderkey as k from orders)""")
def account_history(spark, sf_dir):
    """PRJ5."""
    rows = _keys(spark, sf_dir).select("k", profile.history(F.expr(_HISTORY), F.lpad(F.col("k").cast("string"), 9, "0"), _PDF).alias("h"))
    return rows.select("k", F.array_join("h.years", ",").alias("years"), F.get("h.pdfs", F.lit(0))["url"].alias("latest"))


_PEOPLE_SQL = """p as (select k, 'Ola ' || (case when k % 2 = 0 then 'M ' else '' end) || 'N' || k as name, cast(null as varchar) as organisation_number, 'DAGL' as role_code, 'Daglig leder' as role, 'Daglig leder' as "group", '2024-01-01' as last_changed, k % 4 = 0 as inactive
    from (select o_orderkey as k from orders) where k % 19 <> 0
  union all select k, 'Revisor ' || k, '9' || k, 'REVI', null, 'Revisor', '2023-01-01', false from (select o_orderkey as k from orders) where k % 19 <> 0 and k % 3 <> 0)"""


@query("roles_people", f'with {_PEOPLE_SQL} select k, name, organisation_number, role_code, role, "group", last_changed, inactive from p')
def roles_people(spark, sf_dir):
    """PRJ6: roles of persons and entities, without birth dates."""
    rows = _keys(spark, sf_dir).select("k", F.explode(profile.roles(F.expr(_ROLES))).alias("r"))
    return rows.select("k", *[f"r.{n}" for n in ("name", "organisation_number", "role_code", "role", "group", "last_changed", "inactive")])


_UNITS_SQL = """u as (select k, '8' || k || i as organisation_number, 'Avd ' || i as name, '{"kommune":"' || (case when i = 2 then 'P' else 'K' end) || i || '"}' as address, k % 20 as employees from (select o_orderkey as k from orders), range(1, 4) t(i) where i <= k % 4)"""


@query("locations_subunits", f"with {_UNITS_SQL} select * from u")
def locations_subunits(spark, sf_dir):
    """PRJ7: subunits, at their place or else their postal address."""
    rows = _keys(spark, sf_dir).select("k", F.explode(profile.locations(F.expr(_SUBUNITS))).alias("u"))
    return rows.select("k", *[f"u.{n}" for n in ("organisation_number", "name", "address", "employees")])


_Q_SQL = "q as (select *, " + ", ".join(f"({' or '.join(f'''contains(asked, '{w}')''' for w in ws)}) as n_{t}" for t, ws in profile.ROUTES.items()) + f" from (select o_orderkey as k, lower([{', '.join(repr(a) for a in _ASKED)}][o_orderkey % {len(_ASKED)} + 1]) as asked from orders)), t as (select *, not ({' or '.join('n_' + t for t in profile.ROUTES)}) as whole, k % 3 = 0 as fetched, k % 2 = 0 as may from q)"


def _answered(spark, sf_dir):
    k = F.col("k")
    site = F.struct(
        F.when(k % 3 == 0, "available").otherwise("not_available").alias("status"), (k % 2 == 0).alias("publishable"), F.concat(F.lit("Om Firma "), k.cast("string")).alias("description"),
        F.array(F.struct(F.lit("linkedin").alias("platform"), F.concat(F.lit("https://linkedin.com/company/f"), k.cast("string")).alias("url"))).alias("social_links"),
    )
    e = profile.entity(F.expr(_ENTITY))
    rows = _keys(spark, sf_dir).select(
        "k", *[e[n].alias(n) for n in ("name", "organisation_number", "legal_form", "employees")], F.concat(F.lit("K"), (k % 30).cast("string")).alias("municipality"),
        profile.accounts(F.expr(_ACCOUNTS)).alias("accounts"), profile.roles(F.expr(_ROLES)).alias("roles"), profile.locations(F.expr(_SUBUNITS)).alias("locations"), site.alias("website"),
        F.get(F.array(*map(F.lit, _ASKED)), (k % len(_ASKED)).cast("int")).alias("question"),
    )
    return rows.select("k", *[c.alias(n) for n, c in profile.answer(F.col("question")).items()])


_CLAIMS = [("Registered name", "'Firma ' || k"), ("Organisation number", "lpad(cast(k as varchar), 9, '0')"), ("Legal form", "case when k % 2 = 0 then 'AS' else 'ENK' end"), ("Municipality", "'K' || (k % 30)"), ("Registry employee count", "case when k % 5 <> 0 then cast(k % 200 as varchar) end")]
_AMOUNTS = [("Revenue", "k % 1000"), ("Operating result", "k % 700 - 300"), ("Annual result", "k % 90"), ("Assets", "k % 800"), ("Debt", "k % 600")]
_FACTS_SQL = " union all ".join(
    [f"select k, '{c}' as claim, {v} as value, 'official_registry_fact' as classification from t where (whole or n_registry) and {v} is not null" for c, v in _CLAIMS]
    + [f"select k, '{c}', cast(cast({v} as double) as varchar), 'official_annual_account' from t join r using (k) where i = 0 and (whole or n_financials)" for c, v in _AMOUNTS]
    + ["""select k, 'Reporting period', '{"fraDato":"2023-01-01","tilDato":"2023-12-31"}', 'official_annual_account' from t join r using (k) where i = 0 and (whole or n_financials)"""]
    + ["""select k, coalesce(role, "group"), name, 'official_role_record' from t join p using (k) where not inactive and (whole or n_roles)"""]
    + ["""select k, 'Registered subunit', '{"name":"' || name || '","address":"' || replace(address, '"', '\\"') || '"}', 'official_subunit_record' from t join u using (k) where whole or n_locations"""]
    + ["select k, 'Website description', 'Om Firma ' || k, 'company_reported_claim' from t where may and (whole or n_website)", "select k, 'Declared linkedin profile', 'https://linkedin.com/company/f' || k, 'company_linked_social_profile' from t where may and (whole or n_website)"]
)


@query("qa_answers", f"with {_RECORDS_SQL}, {_PEOPLE_SQL}, {_UNITS_SQL}, {_Q_SQL} {_FACTS_SQL}")
def qa_answers(spark, sf_dir):
    """QRY4: the cited facts that each question is answered with, by topic."""
    return _answered(spark, sf_dir).select("k", F.explode("facts").alias("f")).select("k", "f.claim", "f.value", "f.classification")


_LACKS = {
    "financials": "(whole or n_financials) and k not in (select k from r)", "roles": "(whole or n_roles) and k not in (select k from p where not inactive)", "locations": "(whole or n_locations) and k % 4 = 0",
    "quarantined": "(whole or n_website) and fetched and not may", "website": "(whole or n_website) and not fetched", "sentiment": "n_sentiment",
}


@query("qa_unsupported", f"with {_RECORDS_SQL}, {_PEOPLE_SQL}, {_Q_SQL} " + " union all ".join(f"select k, '{profile.ABSENT[t]}' as unsupported from t where {cond}" for t, cond in _LACKS.items()))
def qa_unsupported(spark, sf_dir):
    """QRY4: what the answers say is missing."""
    return _answered(spark, sf_dir).select("k", F.explode("unsupported").alias("unsupported"))
