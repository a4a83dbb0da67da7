"""FLT2, FLT4, AGG4, SNK6, PRJ20: who of a register counts as a filer, its strata, the fields that screens read, saved workspaces, and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legal forms that are strata of their own (fixed values).
OWN_STRATA = ["AS", "ASA", "ENK"]
SCHEMA_VERSION, MOST_HISTORY = 1, 100


def employee_band(n: Column) -> Column:
    """SCA30."""
    return F.when(n.isNull(), "missing").when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 100, "20-99").otherwise("100+")


def _adverse() -> Column:
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    return yes("bankrupt") | yes("liquidating")


def _web() -> Column:
    return F.when(F.coalesce("website", F.lit("")) != "", "web").otherwise("no-web")


def eligible_filer(latest_year: str, active_only: bool = True) -> Column:
    """FLT4: whether a row of the register filed for the year and, if asked, is neither bankrupt nor being liquidated."""
    filed = F.coalesce(F.col("latest_submitted_accounts").cast("string"), F.lit("")) == str(latest_year)
    return filed & ~_adverse() if active_only else filed


def stratum() -> Column:
    """AGG4: form, headcount, state and website of a register's row."""
    form = F.when(F.col("legal_form").isin(OWN_STRATA), F.col("legal_form")).otherwise("OTHER")
    return F.concat_ws("|", form, employee_band(F.col("employees")), F.when(_adverse(), "adverse").otherwise("active"), _web())


def filer_stratum() -> Column:
    """AGG4: form, headcount, division of industry, region and website of a filer."""
    some = lambda x: F.coalesce(F.nullif(F.col(x).cast("string"), F.lit("")), F.lit("missing"))
    return F.concat_ws("|", some("legal_form"), employee_band(F.col("employees")), F.split_part(some("industry_code"), F.lit("."), F.lit(1)), F.substring(some("municipality_number"), 1, 2), _web())


def screen_fields() -> dict[str, Column]:
    """FLT2: the fields that a screen may name, of a profile with ``financials`` (``status``, ``records``) and ``site`` (``status``, ``publishable``): amounts of the latest record, a website that is available and
    not known to be another's, accounts that are available, and code and label of the industry."""
    c = F.col
    latest = F.get("financials.records", F.lit(0))
    site = (c("site.status") == "available") & F.coalesce("site.publishable", F.lit(True))
    return {
        "municipality": c("municipality"), "legal_form": c("legal_form"), "employees": c("employees"), "revenue": latest["revenue"], "annual_result": latest["annual_result"],
        "website": F.when(F.coalesce(site, F.lit(False)), "yes"), "financials": F.coalesce(c("financials.status") == "available", F.lit(False)), "industry": F.concat_ws(" ", "industry_code", "industry_label"),
    }


def workspace(body: Column) -> Column:
    """SNK6: a saved workspace, as JSON, as a struct of ``pins``, ``history`` (its last hundred entries) and ``warning``; what is missing, broken or of another version is an
    empty one, the last two with a warning."""
    v = F.try_parse_json(body)
    pins, history = F.try_variant_get(v, "$.pins", "array<string>"), F.try_variant_get(v, "$.history", "array<variant>")
    good = (F.try_variant_get(v, "$.schema_version", "int") == SCHEMA_VERSION) & pins.isNotNull() & history.isNotNull()
    kept = lambda x, other: F.when(F.coalesce(good, F.lit(False)), x).otherwise(other)
    texts = F.transform(history, lambda h: F.to_json(h))
    none = F.array().cast("array<string>")
    last = F.slice(texts, F.greatest(F.size(texts) - (MOST_HISTORY - 1), F.lit(1)), MOST_HISTORY)
    why = F.when(v.isNull(), "JSONDecodeError").otherwise("ValueError")
    warning = F.when(body.isNotNull() & ~F.coalesce(good, F.lit(False)), F.concat(F.lit("Workspace recovery reset invalid state: "), why))
    return F.struct(kept(pins, none).alias("pins"), kept(last, none).alias("history"), warning.alias("warning"))


def recorded(saved: Column, entry: Column, pins: Column) -> Column:
    """SNK6, WIN9: a workspace (see :func:`workspace`) with one entry more in its history, of which the last hundred stay, and more pins, each once and in order."""
    longer = F.concat(saved["history"], F.array(entry))
    return F.struct(F.array_sort(F.array_union(saved["pins"], pins)).alias("pins"), F.slice(longer, F.greatest(F.size(longer) - (MOST_HISTORY - 1), F.lit(1)), MOST_HISTORY).alias("history"), saved["warning"].alias("warning"))


def audit_rows(profiles: DataFrame, key: str = "organisation_number") -> DataFrame:
    """PRJ20: a row for each module of each profile's ``evidence`` (a map of records): its status, source, time and hash."""
    each = profiles.select(key, F.explode("evidence").alias("module", "r"))
    return each.select(key, "module", "r.status", "r.source_type", "r.source_url", "r.retrieved_at", "r.content_sha256")
