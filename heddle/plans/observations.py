"""Publication rules, footprints, sentiment and scores over events read as observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import footprint as fp
from heddle.plans.base import OBSERVATIONS_SQL, observations
from heddle.registry import query
from heddle.session import table

AS_OF, DAYS = "2024-01-30 00:00:00", 10


@query("observation_reasons", f"with {OBSERVATIONS_SQL} select id, array_to_string(reasons, '; ') as reasons from judged")
def observation_reasons(spark, sf_dir):
    return observations(spark, sf_dir).select("id", F.array_join("reasons", "; ").alias("reasons"))


@query("rejection_histogram", f"with {OBSERVATIONS_SQL} select reason, count(*) as n from (select unnest(reasons) as reason from judged) group by 1")
def rejection_histogram(spark, sf_dir):
    return observations(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("footprint_summary", f"""with {OBSERVATIONS_SQL}, ok as (select *, len(reasons) = 0 as ok from judged), g as (select organisation_number,
  count(*) filter (where ok) as accepted, count(*) filter (where not ok) as rejected, coalesce(array_to_string(list_sort(list_distinct(list(platform) filter (where ok))), ','), '') as platforms,
  count(*) filter (where ok and epoch(timestamp '{AS_OF}') - floor(epoch(retrieved_at)) between 0 and {DAYS * 86400}) as fresh,
  count(*) filter (where ok and signal_type in ('review', 'review_summary')) as review_signals, count(distinct source_url) filter (where ok and signal_type = 'job_posting') as active_jobs,
  count(distinct source_url) filter (where ok and signal_type in ('public_post', 'public_mention', 'buzz_metrics')) as public_items,
  coalesce(sum(engagement) filter (where ok and signal_type in ('public_post', 'public_mention', 'buzz_metrics')), 0) as engagement,
  count(*) filter (where ok and sentiment_label is not null) as sentiment_items, count(distinct host) filter (where ok and sentiment_label is not null) as sentiment_hosts,
  count(distinct reviewer_id) filter (where ok and sentiment_label is not null) as sentiment_reviewers,
  sum(case sentiment_label when 'positive' then 1 when 'negative' then -1 when 'neutral' then 0 end) filter (where ok) as s, count(*) filter (where ok and sentiment_label in ('positive', 'negative', 'neutral')) as n
  from ok group by 1) select organisation_number, accepted, rejected, platforms, fresh, review_signals, active_jobs, public_items, cast(engagement as bigint) as engagement, sentiment_items, sentiment_hosts, sentiment_reviewers,
  case when sentiment_items >= 10 and (sentiment_hosts >= 2 or sentiment_reviewers >= 10) then 'available' else 'abstain' end as sentiment_status,
  case when sentiment_items >= 10 and (sentiment_hosts >= 2 or sentiment_reviewers >= 10) and n > 0 then round_even(50 + 50 * s / n, 1) end as sentiment_score from g""")
def footprint_summary(spark, sf_dir):
    return fp.footprint(observations(spark, sf_dir), AS_OF, DAYS)


@query("sentiment_rollup", f"""with {OBSERVATIONS_SQL}, i as (select organisation_number, sentiment_label as label, host as source_id, (exact_entity and source_class = 'public_news' and source_url is not null and evidence_span is not null and sentiment_label is not null) as ok from judged),
  g as (select organisation_number, count(*) filter (where ok) as accepted, count(*) filter (where not ok) as rejected, count(distinct source_id) filter (where ok and source_id <> '') as sources, list_distinct(list(label) filter (where ok and label <> 'neutral')) as l from i group by 1)
  select organisation_number, accepted, rejected, sources, case when sources >= 2 then 'available' else 'abstain' end as status, case when sources >= 2 then case coalesce(len(l), 0) when 0 then 'neutral' when 1 then l[1] else 'mixed' end end as label from g""")
def sentiment_rollup(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("text", F.col("evidence_span"))
    ok = (F.size(fp.eligibility_reasons()) == 0) & F.coalesce(F.col("sentiment_label").isin(fp.LABELS), F.lit(False))
    return fp.company_sentiment(rows.select("organisation_number", F.col("sentiment_label").alias("label"), F.col("host").alias("source_id"), ok.alias("ok")))


@query("sentiment_eligibility", f"with {OBSERVATIONS_SQL} select id, array_to_string(list_filter([case when not exact_entity then 'exact company identity is not verified' end, case when source_class <> 'public_news' then 'source is not an allowed independent class' end, case when source_url is null then 'missing source_url' end, case when evidence_span is null then 'missing evidence_span' end, case when evidence_span is null then 'missing text' end], lambda x: x is not null), '; ') as reasons from judged")
def sentiment_eligibility(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("text", F.col("evidence_span")).select("id", F.array_join(fp.eligibility_reasons(), "; ").alias("reasons"))


_EVAL_SQL = """with j as (select d.doc_id, case when quality = 1 then 'positive' else 'negative' end as g, case when n_chars < 300 then null when n_chars % 3 = 0 then 'negative' else 'positive' end as p from labels l join documents d using (doc_id)),
t as (select label, count(*) filter (where g = label and p is not distinct from label) as tp, count(*) filter (where g <> label and p is not distinct from label) as fp, count(*) filter (where g = label and p is distinct from label) as fn from j cross join (select unnest(['positive', 'negative', 'neutral']) as label) group by 1),
r as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as r from t)
select label, tp, fp, fn, round_even(p, 6) as precision, round_even(r, 6) as recall, round_even(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 6) as f1 from r"""


@query("sentiment_eval", _EVAL_SQL)
def sentiment_eval(spark, sf_dir):
    """Labels as gold, a rule on the length as predictions, of which some are missing."""
    d, gold = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    predicted = d.filter("n_chars >= 300").select("doc_id", F.when(F.col("n_chars") % 3 == 0, "negative").otherwise("positive").alias("label"))
    return fp.classification(gold, predicted, "doc_id", ["positive", "negative", "neutral"])


def components_sql(wide: bool) -> dict[str, str]:
    """The components of the score of a group of observations, whose flags ``ok`` and ``experimental`` tell which count."""
    row = "(ok or experimental)" if wide else "ok"
    f = lambda cond, row=row: f"coalesce(max(case when {row} and {cond} then 1 else 0 end), 0)"
    places = "platform = 'google_places' and signal_type = 'place_summary'"
    known = f(f"(platform = 'wikidata' and signal_type = 'company_profile' or {places})", "ok")
    if wide:
        known = f"greatest({known}, {f(f"(platform = 'company_directory' and signal_type = 'company_profile' or {places})", 'experimental')})"
    enough = lambda row: (
        f"(count(*) filter (where {row} and sentiment_label is not null) >= 10 and (count(distinct host) filter (where {row} and sentiment_label is not null) >= 2"
        f" or count(distinct reviewer_id) filter (where {row} and sentiment_label is not null) >= 10))"
    )
    felt = f"{enough('ok')} or {enough('experimental')}" if wide else enough("ok")
    kinds = lambda *x: f"signal_type in ({', '.join(repr(v) for v in x)})"
    return {
        "exact_external_identity": f"20.0 * {known}", "verified_handles": f"least(15.0, 5.0 * count(distinct platform) filter (where {row} and signal_type = 'profile_handle'))", "profile_metrics": f"10.0 * {f(kinds('profile_metrics'))}",
        "places_identity": f"5.0 * {f(kinds('place_summary'))}", "places_reviews": f"10.0 * {f(kinds('review', 'review_summary'))}", "workforce_jobs": f"10.0 * {f(kinds('job_posting', 'workforce_snapshot'))}",
        "public_buzz": f"10.0 * {f(kinds('public_post', 'public_mention', 'buzz_metrics'))}", "independent_sentiment": f"15.0 * (case when {felt} then 1 else 0 end)", "freshness_evidence": f"5.0 * {f('true', 'ok')}",
    }


def _score_sql(wide: bool) -> str:
    return " + ".join(components_sql(wide).values())


@query("development_score", f"with {OBSERVATIONS_SQL}, o as (select *, len(reasons) = 0 as ok, acquisition_mode = 'jobspy_experiment' and exact_entity and identity_proof <> '' as experimental from judged) select organisation_number, cast({_score_sql(False)} as double) as score, cast({_score_sql(True)} as double) as exp_score from o group by 1")
def development_score(spark, sf_dir):
    exp = F.col("acquisition_mode").isin(fp.EXPERIMENTAL_MODES) & F.col("exact_entity") & (F.col("identity_proof") != "")
    return fp.development_score(observations(spark, sf_dir).withColumn("experimental", exp))
