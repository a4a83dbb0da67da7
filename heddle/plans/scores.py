"""Reports on observations, predictions and screens: completeness, transfer, evaluation, competition."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import footprint as fp
from heddle.operators import scores
from heddle.plans.base import OBSERVATIONS_SQL, observations
from heddle.plans.observations import components_sql
from heddle.registry import query
from heddle.session import table

BASE = 5


def _scored(spark, sf_dir):
    exp = F.col("acquisition_mode").isin(fp.EXPERIMENTAL_MODES) & F.col("exact_entity") & (F.col("identity_proof") != "")
    states = fp.score_states(observations(spark, sf_dir).withColumn("experimental", exp))
    k = F.col("k")
    status = lambda x: F.struct(x.alias("status"))
    records = F.map_filter(
        F.create_map(
            F.lit("financials"), F.when(k % 4 != 1, status(F.when(k % 2 == 0, "available").otherwise("not_found"))), F.lit("financial"), status(F.lit("available")),
            F.lit("roles"), F.when(k % 3 != 0, status(F.lit("available"))), F.lit("locations"), status(F.when(k % 5 == 0, "error").otherwise("not_found")), F.lit("website"), status(F.when(k % 6 == 0, "not_run")),
        ), lambda m, v: v.isNotNull(),
    )
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(k.cast("string").alias("organisation_number"), F.when(k % 7 != 0, k.cast("string")).alias("registry_number"), records.alias("evidence"))
    return scores.completeness(profiles, states)


def _rich(prefix: str, wide: bool) -> str:
    return ", ".join(f"round_even({scores.ENRICHMENT[n]} * least(1.0, ({x}) / {fp.COMPONENTS[n]}), 3) as {prefix}_{n}" for n, x in components_sql(wide).items())


_SCORED_SQL = f"""{OBSERVATIONS_SQL}, o as (select *, len(reasons) = 0 as ok, acquisition_mode = 'jobspy_experiment' and exact_entity and identity_proof <> '' as experimental from judged),
e as (select organisation_number, cast(organisation_number as bigint) as k, {_rich("strict", False)}, {_rich("experimental", True)} from o group by 1),
f as (select *, case when k % 7 <> 0 then 5.0 else 0 end as foundation_official_identity, case when k % 4 = 1 or k % 2 = 0 then 10.0 else 0 end as foundation_annual_accounts, case when k % 3 <> 0 then 5.0 else 0 end as foundation_roles,
  case when k % 5 <> 0 then 5.0 else 0 end as foundation_locations, case when k % 6 <> 0 then 5.0 else 5.0 * 0 end as foundation_website_terminal_state from e),
g as (select *, round_even({" + ".join(f"foundation_{n}" for n in scores.FOUNDATION)}, 3) as foundation_score from f),
scored as (select *, round_even(foundation_score + {" + ".join(f"strict_{n}" for n in scores.ENRICHMENT)}, 3) as strict_score, round_even(foundation_score + {" + ".join(f"experimental_{n}" for n in scores.ENRICHMENT)}, 3) as experimental_score from g)"""


@query("completeness_scores", f"with {_SCORED_SQL} select organisation_number, cast(foundation_score as double) as foundation_score, cast(strict_score as double) as strict_score, cast(experimental_score as double) as experimental_score, cast(strict_verified_handles as double) as strict_verified_handles, cast(experimental_independent_sentiment as double) as experimental_sentiment from scored")
def completeness_scores(spark, sf_dir):
    """AGG9: what official records and external evidence make complete of each company."""
    c = F.col
    return _scored(spark, sf_dir).select("organisation_number", "foundation_score", "strict_score", "experimental_score", c("strict.verified_handles").alias("strict_verified_handles"), c("experimental.independent_sentiment").alias("experimental_sentiment"))


_SHARES = [f"foundation_{n}" for n in scores.FOUNDATION] + [f"strict_{n}" for n in scores.ENRICHMENT]


@query("completeness_summary", f"with {_SCORED_SQL} select count(*) as companies, round_even(avg(foundation_score), 3) as foundation_mean, round_even(avg(strict_score), 3) as strict_mean, round_even(avg(experimental_score), 3) as experimental_mean, count(*) filter (where strict_score >= 50) as strict_at_50, count(*) filter (where experimental_score >= 65) as experimental_at_65, {', '.join(f'round_even(avg(case when {n} > 0 then 1.0 else 0 end), 4) as {n}' for n in _SHARES)} from scored")
def completeness_summary(spark, sf_dir):
    return scores.completeness_summary(_scored(spark, sf_dir))


@query("completeness_distribution", f"with {_SCORED_SQL} select cast(strict_score as double) as strict_score, count(*) as companies from scored group by 1")
def completeness_distribution(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("strict_score").agg(F.count("*").alias("companies"))


@query(
    "transfer_report",
    f"""with {_SCORED_SQL}, p as (select *, case when k < {BASE} then 'base' else 'extension' end as part from scored),
m as (select {", ".join(f"round_even(avg({s}_score) filter (where part = '{q}'), 3) as {q}_{s}_mean" for q in ("base", "extension") for s in ("foundation", "strict", "experimental"))}, count(*) filter (where part = 'base') as base_companies, count(*) filter (where part = 'extension') as extension_companies from p)
select *, {", ".join(f"round_even(extension_{s}_mean - base_{s}_mean, 3) as {s}_mean_delta, round_even(extension_{s}_mean / nullif(base_{s}_mean, 0), 4) as {s}_retention" for s in ("strict", "experimental"))} from m""",
)
def transfer_report(spark, sf_dir):
    """AGG10: what the companies behind the first keep of their scores."""
    rows = _scored(spark, sf_dir).withColumn("position", F.col("organisation_number").cast("bigint"))
    return scores.transfer(rows, "position", BASE)


_KINDS = {"workforce_jobs": "'job_posting', 'workforce_snapshot'", "ratings_reviews": "'review', 'review_summary', 'place_summary'", "buzz_engagement": "'public_post', 'public_mention', 'profile_metrics'"}
_EVALUATION_SQL = f"""{OBSERVATIONS_SQL}, o as (select *, len(reasons) = 0 as ok, cast(id as bigint) as i from judged), a as (select * from o where i % 3 = 0),
t as (select count(*) as audited_observations, count(*) filter (where ok) as published_audited, count(*) filter (where ok and i % 1000 = 3) as wrong_entity_publications, count(*) filter (where ok and i % 150 = 3) as wrong_metric,
  count(*) filter (where ok and sentiment_label is not null) as sentiment_audited, count(*) filter (where ok and sentiment_label is not null and i % 2 = 0) as felt_right from a),
s as (select organisation_number, count(distinct platform) >= 2 as two_platforms, {", ".join(f"max(case when signal_type in ({v}) then 1 else 0 end) = 1 as {n}" for n, v in _KINDS.items())}, max(case when sentiment_label is not null then 1 else 0 end) = 1 as sentiment from o where ok group by 1),
c as (select count(*) as profiles, {", ".join(f"round_even(avg(case when {n} then 1.0 else 0.0 end), 6) as {n}" for n in ("two_platforms", *_KINDS, "sentiment"))}, round_even(avg(case when s.organisation_number is not null then 1.0 else 0.0 end), 6) as any_external from customer left join s on s.organisation_number = cast(c_custkey as varchar)),
evaluated as (select audited_observations, published_audited, wrong_entity_publications, 0 as unsupported_publications, sentiment_audited, profiles, any_external, two_platforms, workforce_jobs, ratings_reviews, buzz_engagement, sentiment, round_even((published_audited - wrong_entity_publications) / published_audited, 6) as entity_precision,
  round_even((published_audited - wrong_metric) / published_audited, 6) as metric_precision, round_even(felt_right / nullif(sentiment_audited, 0), 6) as sentiment_accuracy, audited_observations >= 100 as audit_size_gate,
  audited_observations >= 100 and wrong_entity_publications = 0 and (published_audited - wrong_metric) / published_audited >= 0.98 as qualification_passed from t, c)"""


def _evaluation(spark, sf_dir):
    i = F.col("event_id")
    labels = table(spark, sf_dir, "events").filter(i % 3 == 0).select(i.cast("string").alias("id"), (i % 1000 != 3).alias("exact_entity"), (i % 150 != 3).alias("metric_correct"), (i % 2 == 0).alias("sentiment_correct"))
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("organisation_number"))
    return scores.external_evaluation(profiles, observations(spark, sf_dir), labels)


@query("external_evaluation", f"with {_EVALUATION_SQL} select * from evaluated")
def external_evaluation(spark, sf_dir):
    """AGG11: how right audited observations are, and the shares of companies that have what."""
    return _evaluation(spark, sf_dir)


_POINTS_SQL = "case when qualification_passed then round_even(10 * two_platforms, 3) + round_even(7 * workforce_jobs, 3) + round_even(8 * ratings_reviews, 3) + round_even(7 * buzz_engagement, 3) + 2.7 + (case when zero then 10 else 0 end) else 0 end + round_even(10 * sentiment, 3)"


@query(
    "competition_score",
    f"""with {_EVALUATION_SQL}, z as (select *, wrong_entity_publications = 0 and published_audited > 0 as zero from evaluated), p as (select *, round_even({_POINTS_SQL}, 3) as points from z)
select cast(points as double) as external_footprint_intelligence, 12.2 as official_company_foundation, 7.5 as research_agent, 9.0 as daily_extensibility_refresh, 4.0 as product_ux_design, round_even(points + 32.7, 3) as raw_score, round_even(points + 32.7, 3) >= 80 as target_met,
  audit_size_gate and zero as qualification_passed, array_to_string(list_filter([case when not audit_size_gate then 'external_audit_at_least_100' end, case when not zero then 'zero_wrong_company_external_publications' end, case when published_audited = 0 then 'external_claims_supported' end], lambda x: x is not null), ', ') as unproven from p""",
)
def competition_score(spark, sf_dir):
    """AGG12: the points of a run's reports by category, and its gates."""
    given = {
        "external_qualified": F.col("qualification_passed"), "fresh_coverage": F.lit(0.9), "connector_policy_passed": F.lit(True), "exact_registry": F.lit(1.0), "financial": F.lit(0.8), "roles_locations": F.lit(0.5), "website_terminal": F.lit(1.0), "research_score": F.lit(9.0),
        "external_qa_passed": F.lit(True), "batch_valid": F.lit(True), "resume_valid": F.lit(False), "refresh_valid": F.lit(True), "p95_ms": F.lit(20_000), "sentiment_gate": F.lit(True), "ux_score": F.lit(9.0), "ux_external": F.lit(False),
    }
    got = scores.competition(_evaluation(spark, sf_dir).withColumns(given))
    return got.select("external_footprint_intelligence", "official_company_foundation", "research_agent", "daily_extensibility_refresh", "product_ux_design", "raw_score", "target_met", "qualification_passed", F.array_join("unproven_or_failed", ", ").alias("unproven"))


@query(
    "prediction_report",
    """with j as (select doc_id as k, case when doc_id % 10 < 4 then 'positive' when doc_id % 10 < 7 then 'negative' when doc_id % 10 < 9 then 'neutral' else 'mixed' end as g from documents),
p as (select *, case when k % 13 = 0 then null when k % 17 = 0 then 'neutral' when k % 19 = 0 then 'odd' else g end as p from j),
l as (select unnest(['positive', 'neutral', 'negative', 'mixed']) as label), t as (select label, count(*) filter (where g = label and p = label) as tp, count(*) filter (where g <> label and p = label) as fp, count(*) filter (where g = label) as n from p, l group by 1),
f as (select avg(case when tp = 0 then 0.0 else 2.0 * (tp / (tp + fp)) * (tp / n) / (tp / (tp + fp) + tp / n) end) as macro from t where n > 0),
s as (select count(*) as gold_items, count(*) filter (where p is not null and p <> 'odd') as published_predictions, count(*) filter (where p = g) as good, count(*) filter (where p is not null and p <> 'odd' and k % 101 = 0) as wrong from p)
select gold_items, published_predictions, round_even(good / gold_items, 6) as accuracy, round_even(macro, 6) as macro_f1, wrong as wrong_entity_predictions, round_even((published_predictions - wrong) / published_predictions, 6) as exact_entity_precision, published_predictions as evidence_supported_predictions, cast(1 as double) as evidence_support_rate,
  0 as company_owned_predictions, round_even(published_predictions / gold_items, 6) as coverage, true as required_labels_present, wrong = 0 and gold_items >= 300 as qualification_passed, wrong = 0 and gold_items >= 600 as production_scale_gate_passed from s, f""",
)
def prediction_report(spark, sf_dir):
    """AGG3: predictions of sentiment against gold, with accuracy, macro F1, coverage and the gate."""
    k = F.col("doc_id")
    gold = table(spark, sf_dir, "documents").select(k.cast("string").alias("id"), "doc_id", F.when(k % 10 < 4, "positive").when(k % 10 < 7, "negative").when(k % 10 < 9, "neutral").otherwise("mixed").alias("label"))
    told = F.when(k % 17 == 0, "neutral").when(k % 19 == 0, "odd").otherwise(F.col("label"))
    predictions = gold.filter(k % 13 != 0).select("id", told.alias("label"), (k % 101 != 0).alias("exact_entity"), F.lit("public_news").alias("source_class"), F.lit(True).alias("supported"))
    out = scores.prediction_report(gold, predictions)
    return out.withColumn("company_owned_predictions", F.col("company_owned_predictions").cast("int"))


@query(
    "research_suite",
    """with s as (select c_custkey % 4 <> 0 as exact, c_custkey % 2 = 0 as plan_exact, c_custkey >= 0 as cited from customer), t as (select avg(case when exact then 1.0 else 0 end) as s, avg(case when plan_exact then 1.0 else 0 end) as p from s)
select cast(4 as double) as cited_single_company_qa, round_even(3 * s, 6) as cross_company_screening, round_even(2 * p, 6) as exact_inspectable_filters, cast(1 as double) as unsupported_abstention, cast(0 as double) as saved_history, cast(1 as double) as provenance_export, round_even(6 + 3 * s + 2 * p, 6) as score, false as qualification_passed from t""",
)
def research_suite(spark, sf_dir):
    """AGG17."""
    k = F.col("c_custkey")
    screens = table(spark, sf_dir, "customer").select((k % 4 != 0).alias("exact"), (k % 2 == 0).alias("plan_exact"), (k >= 0).alias("citations_complete"))
    return scores.research_suite(screens, F.lit(True), F.lit(True), F.lit(False))
