"""AGG3, AGG9-AGG12, AGG17: completeness, transfer, external evaluation, competition, predictions and the research suite, as reports of one row from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import footprint as fp

#: Weights of what official records and external evidence add to a company's completeness (fixed values).
FOUNDATION = {"official_identity": 5.0, "annual_accounts": 10.0, "roles": 5.0, "locations": 5.0, "website_terminal_state": 5.0}
ENRICHMENT = {"exact_external_identity": 8.0, "verified_handles": 8.0, "profile_metrics": 8.0, "places_identity": 4.0, "places_reviews": 8.0, "workforce_jobs": 8.0, "public_buzz": 8.0, "independent_sentiment": 12.0, "freshness_evidence": 6.0}
STRICT_AT, EXPERIMENTAL_AT = 50, 65
SENTIMENT_LABELS = ["positive", "neutral", "negative", "mixed"]


def ratio(a: Column, b: Column) -> Column:
    """0 of nothing."""
    return F.when(b > 0, a / b).otherwise(0.0)


def capped(weight: float, value: Column) -> Column:
    """AGG12, SCA35: a weight's share, from none to all of it."""
    return F.bround(F.lit(float(weight)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))), 3)


def module_present(record: Column) -> Column:
    """FLT11: there is a record, and it isn't one of an error or of a module that wasn't run."""
    return record.isNotNull() & ~F.coalesce(record["status"].isin("error", "not_run"), F.lit(False))


def completeness(profiles: DataFrame, states: DataFrame, key: str = "organisation_number") -> DataFrame:
    """AGG9: a row for each company with a state of its observations (see :func:`footprint.score_states`): the components of its foundation and enrichment, and its scores.

    Profiles have ``evidence``, a map by module of records with ``status``, and ``registry_number``, the number in the register's live record. A company without a
    profile fails the query.
    """
    c, e = F.col, F.col("evidence")
    known = profiles.select(key, "registry_number", "evidence", F.lit(True).alias("_known"))
    rows = states.join(known, key, "left").withColumn("_known", F.when(c("_known"), True).otherwise(F.raise_error(F.concat(F.lit("missing profile for "), c(key))).cast("boolean"))).filter("_known")
    accounts = F.coalesce(e["financials"], e["financial"])["status"] == "available"
    has = {"official_identity": c("registry_number") == c(key), "annual_accounts": accounts, "roles": module_present(e["roles"]), "locations": module_present(e["locations"]), "website_terminal_state": module_present(e["website"])}
    foundation = {k: F.when(F.coalesce(v, F.lit(False)), F.lit(FOUNDATION[k])).otherwise(0.0) for k, v in has.items()}
    rich = lambda wide: {k: capped(ENRICHMENT[k], v / F.lit(fp.COMPONENTS[k])) for k, v in fp.state_components(wide).items()}
    told = lambda parts, name: F.struct(*[v.alias(k) for k, v in parts.items()]).alias(name)
    out = rows.select(key, told(foundation, "foundation"), told(rich(False), "strict"), told(rich(True), "experimental"))
    total = lambda name, keys: sum((c(f"{name}.{k}") for k in keys), F.lit(0.0))
    base = F.bround(total("foundation", FOUNDATION), 3)
    return out.withColumns({"foundation_score": base, "strict_score": F.bround(base + total("strict", ENRICHMENT), 3), "experimental_score": F.bround(base + total("experimental", ENRICHMENT), 3)})


def _summary() -> list[Column]:
    c = F.col
    mean = lambda x: F.bround(F.avg(x), 3)
    covered = lambda group, keys: [F.bround(F.avg((c(f"{group}.{k}") > 0).cast("double")), 4).alias(f"{group}_{k}") for k in keys]
    return [
        F.count("*").alias("companies"), mean("foundation_score").alias("foundation_mean"), mean("strict_score").alias("strict_mean"), mean("experimental_score").alias("experimental_mean"),
        F.count_if(c("strict_score") >= STRICT_AT).alias("strict_at_50"), F.count_if(c("experimental_score") >= EXPERIMENTAL_AT).alias("experimental_at_65"), *covered("foundation", FOUNDATION), *covered("strict", ENRICHMENT),
    ]


def completeness_summary(scored: DataFrame, *by: str) -> DataFrame:
    """AGG9: means, companies at the thresholds, and the shares that have each component; of all or for each group."""
    return scored.groupBy(*by).agg(*_summary()) if by else scored.agg(*_summary())


def transfer(scored: DataFrame, position: str, base_size: int) -> DataFrame:
    """AGG10: one row: the means of the first ``base_size`` companies by position, of those behind, and what is kept of the first. Fails the query if there are
    none behind."""
    c = F.col
    part = F.when(c(position) < base_size, "base").otherwise("extension")
    g = scored.withColumn("_part", part).agg(
        *[F.bround(F.avg(F.when(c("_part") == p, c(f"{s}_score"))), 3).alias(f"{p}_{s}_mean") for p in ("base", "extension") for s in ("foundation", "strict", "experimental")],
        F.count_if(c("_part") == "base").alias("base_companies"), F.count_if(c("_part") == "extension").alias("extension_companies"),
    )
    g = g.withColumn("extension_companies", F.when(c("extension_companies") > 0, c("extension_companies")).otherwise(F.raise_error(F.lit("results must include a non-empty extension after base-size")).cast("long")))
    change = {f"{s}_mean_delta": F.bround(c(f"extension_{s}_mean") - c(f"base_{s}_mean"), 3) for s in ("strict", "experimental")}
    kept = {f"{s}_retention": F.bround(c(f"extension_{s}_mean") / F.nullif(c(f"base_{s}_mean"), F.lit(0.0)), 4) for s in ("strict", "experimental")}
    return g.withColumns(change | kept)


def external_evaluation(profiles: DataFrame, observations: DataFrame, labels: DataFrame, minimum_audit: int = 100) -> DataFrame:
    """AGG11: one row: how right the audited observations that may be published are (``labels``: ``id, exact_entity, metric_correct, sentiment_correct``), and what share of all
    companies has what. Observations have ``reasons``. Two labels of one id fail the query."""
    c = F.col
    once = labels.groupBy("id").agg(F.count("*").alias("_n"), *[F.max(x).alias(f"_{x}") for x in ("exact_entity", "metric_correct", "sentiment_correct")])
    once = once.withColumn("_n", F.when(c("_n") == 1, 1).otherwise(F.raise_error(F.lit("Label IDs must be unique")).cast("int")))
    ok = F.size("reasons") == 0
    audited = observations.select("id", ok.alias("_ok"), "sentiment_label").join(once, "id").filter("_n = 1")
    right = lambda x: F.coalesce(c(f"_{x}"), F.lit(False))
    felt = c("_ok") & c("sentiment_label").isNotNull()
    audit = audited.agg(
        F.count("*").alias("audited_observations"), F.count_if("_ok").alias("published_audited"), F.count_if(c("_ok") & ~right("exact_entity")).alias("wrong_entity_publications"), F.count_if(c("_ok") & ~right("metric_correct")).alias("_wrong_metric"),
        F.count_if(felt).alias("sentiment_audited"), F.count_if(felt & right("sentiment_correct")).alias("_felt_right"),
    )
    n_labels = labels.agg(F.count("*").alias("_labels"))
    kinds = {"workforce_jobs": ["job_posting", "workforce_snapshot"], "ratings_reviews": ["review", "review_summary", "place_summary"], "buzz_engagement": ["public_post", "public_mention", "profile_metrics"]}
    seen = observations.filter(ok).groupBy("organisation_number").agg(
        (F.min("platform") < F.max("platform")).alias("two_platforms"), *[F.max(c("signal_type").isin(v)).alias(k) for k, v in kinds.items()], F.max(c("sentiment_label").isNotNull()).alias("sentiment"), F.lit(True).alias("any_external")
    )
    share = lambda x: F.bround(ratio(F.count_if(F.coalesce(c(x), F.lit(False))), F.count("*")), 6).alias(x)
    covered = profiles.select("organisation_number").distinct().join(seen, "organisation_number", "left").agg(F.count("*").alias("profiles"), *[share(x) for x in ("any_external", "two_platforms", *kinds, "sentiment")])
    rows = audit.join(covered).join(n_labels)
    published = c("published_audited")
    entity, metric = ratio(published - c("wrong_entity_publications"), published), ratio(published - c("_wrong_metric"), published)
    gate = (c("_labels") >= minimum_audit) & (published > 0) & (c("wrong_entity_publications") == 0) & (entity >= 0.995) & (metric >= 0.98)
    # What may be published has no reason against it, so none is without support.
    out = rows.withColumns({"unsupported_publications": F.lit(0).cast("long"), "entity_precision": F.bround(entity, 6), "metric_precision": F.bround(metric, 6), "sentiment_accuracy": F.bround(c("_felt_right") / F.nullif(c("sentiment_audited"), F.lit(0)), 6), "audit_size_gate": c("_labels") >= minimum_audit, "qualification_passed": gate})
    return out.drop("_wrong_metric", "_felt_right", "_labels")


def competition(reports: DataFrame, target: float = 80.0) -> DataFrame:
    """AGG12: one row from the row of a run's reports: points by category, the raw score, the gates, and what is awarded.

    Of the external evaluation it needs its columns and ``external_qualified``, ``fresh_coverage``, ``connector_policy_passed``; of profiles the shares ``exact_registry, financial, roles_locations,
    website_terminal``; ``research_score, external_qa_passed, batch_valid, resume_valid, refresh_valid, p95_ms, sentiment_gate, ux_score, ux_external``.
    """
    c = F.col
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    qualified, audited = yes("external_qualified"), F.coalesce("published_audited", F.lit(0)) > 0
    zero_wrong, supported = (c("wrong_entity_publications") == 0) & audited, (F.coalesce("unsupported_publications", F.lit(0)) == 0) & audited
    when = lambda cond, x: F.when(cond, x).otherwise(0.0)
    # Identity that was never wrong, then the shares of companies with two platforms, workforce, ratings, buzz, sentiment, and fresh evidence.
    shares = [(10, "two_platforms"), (7, "workforce_jobs"), (8, "ratings_reviews"), (7, "buzz_engagement"), (3, "fresh_coverage")]
    external = [when(qualified & zero_wrong, F.lit(10.0)), when(yes("sentiment_gate"), capped(10, c("sentiment"))), *[when(qualified, capped(w, c(x))) for w, x in shares]]
    foundation = [capped(4, c("exact_registry")), capped(4, c("financial")), capped(4, c("roles_locations")), capped(3, c("website_terminal"))]
    research = F.bround(F.least(F.lit(10.0), F.least(F.lit(12.0), F.coalesce("research_score", F.lit(0.0))) * 10 / 12), 3)
    research = F.when(yes("external_qa_passed"), research).otherwise(F.least(F.lit(5.0), research))
    batch, policy = yes("batch_valid"), yes("connector_policy_passed")
    extend = [when(batch, F.lit(4.0)), when(yes("resume_valid"), F.lit(2.0)), when(yes("refresh_valid"), F.lit(3.0)), when(batch & (c("p95_ms") <= 10_000), F.lit(1.0)), when(policy, F.lit(2.0))]
    ux = F.least(F.lit(8.0), F.coalesce("ux_score", F.lit(0.0)))
    add = lambda xs: F.bround(sum(xs, F.lit(0.0)), 3)
    rows = reports.withColumns(
        {
            "external_footprint_intelligence": add(external), "official_company_foundation": add(foundation), "research_agent": research, "daily_extensibility_refresh": add(extend),
            "product_ux_design": F.when(yes("ux_external"), ux).otherwise(F.least(F.lit(4.0), ux)),
        }
    )
    categories = ["external_footprint_intelligence", "official_company_foundation", "research_agent", "daily_extensibility_refresh", "product_ux_design"]
    gates = {
        "external_audit_at_least_100": yes("audit_size_gate"), "zero_wrong_company_external_publications": zero_wrong, "external_claims_supported": supported, "external_connector_policy": policy,
        "official_identity_complete": c("exact_registry") == 1.0, "terminal_batch_contract": batch, "refresh_replay": yes("refresh_valid"),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in gates.items()]))
    rows = rows.withColumns({"raw_score": add([c(x) for x in categories]), "unproven_or_failed": failed})
    passed = F.size("unproven_or_failed") == 0
    return rows.select(*categories, "raw_score", (c("raw_score") >= target).alias("target_met"), passed.alias("qualification_passed"), F.when(passed, c("raw_score")).otherwise(0.0).alias("awardable_score"), "unproven_or_failed")


def prediction_report(gold: DataFrame, predictions: DataFrame, minimum_items: int = 300) -> DataFrame:
    """AGG3: one row on predicted sentiment (``id, label, exact_entity, source_class, supported``) against ``gold`` (``id, label``): accuracy, macro F1 over the labels that gold has, entities, support,
    coverage and the gate. Ids that are there twice, and gold labels outside the four, fail the query."""
    c = F.col
    if minimum_items < 300:
        raise ValueError("the least number of items can't be below 300")
    unique = lambda rows, who: rows.groupBy("id").agg(F.count("*").alias("_n"), F.first(F.struct(*[x for x in rows.columns if x != "id"])).alias(who)).withColumn("_n", F.when(c("_n") == 1, 1).otherwise(F.raise_error(F.lit(f"{who} item IDs must be unique")).cast("int"))).filter("_n = 1").drop("_n")
    g = unique(gold.select("id", "label"), "gold").withColumn("_g", F.when(c("gold.label").isin(SENTIMENT_LABELS), c("gold.label")).otherwise(F.raise_error(F.lit("Gold labels must be one of: " + ", ".join(SENTIMENT_LABELS)))))
    rows = g.join(unique(predictions, "predicted"), "id", "left").withColumn("_p", c("predicted.label"))
    out = c("_p").isin(SENTIMENT_LABELS)
    hit = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    each = [hit(cond).alias(f"{what}_{x}") for x in SENTIMENT_LABELS for what, cond in (("tp", (c("_g") == x) & (c("_p") == x)), ("fp", (c("_g") != x) & (c("_p") == x)), ("n", c("_g") == x))]
    t = rows.agg(
        F.count("*").alias("gold_items"), hit(out).alias("published_predictions"), hit(c("_g") == c("_p")).alias("_right"), hit(out & ~F.coalesce(c("predicted.exact_entity"), F.lit(False))).alias("wrong_entity_predictions"),
        hit(out & c("predicted.supported")).alias("evidence_supported_predictions"), hit(out & (c("predicted.source_class") == "company_owned")).alias("company_owned_predictions"), *each,
    )
    part = {}
    for x in SENTIMENT_LABELS:
        part[f"precision_{x}"], part[f"recall_{x}"] = ratio(c(f"tp_{x}"), c(f"tp_{x}") + c(f"fp_{x}")), ratio(c(f"tp_{x}"), c(f"n_{x}"))
    t = t.withColumns(part).withColumns({f"f1_{x}": F.when(c(f"precision_{x}") + c(f"recall_{x}") > 0, 2 * c(f"precision_{x}") * c(f"recall_{x}") / (c(f"precision_{x}") + c(f"recall_{x}"))).otherwise(0.0) for x in SENTIMENT_LABELS})
    active = sum((F.when(c(f"n_{x}") > 0, 1).otherwise(0) for x in SENTIMENT_LABELS), F.lit(0))
    macro = ratio(sum((F.when(c(f"n_{x}") > 0, c(f"f1_{x}")).otherwise(0.0) for x in SENTIMENT_LABELS), F.lit(0.0)), active)
    n, published = c("gold_items"), c("published_predictions")
    needed = (c("n_positive") > 0) & (c("n_neutral") > 0) & (c("n_negative") > 0)
    gate = (
        (n >= minimum_items) & needed & (c("wrong_entity_predictions") == 0) & (c("company_owned_predictions") == 0) & (macro >= 0.8) & (c("precision_positive") >= 0.9) & (c("precision_negative") >= 0.9)
        & (c("evidence_supported_predictions") == published) & (ratio(published, n) >= 0.5)
    )
    share = lambda a, b: F.bround(a / F.nullif(b, F.lit(0)), 6)
    t = t.withColumns({"accuracy": share(c("_right"), n), "macro_f1": F.bround(macro, 6), "coverage": share(published, n), "exact_entity_precision": share(published - c("wrong_entity_predictions"), published), "evidence_support_rate": share(c("evidence_supported_predictions"), published), "required_labels_present": needed, "qualification_passed": gate, "production_scale_gate_passed": gate & (n >= 600) & (c("n_mixed") > 0)})
    return t.select("gold_items", "published_predictions", "accuracy", "macro_f1", "wrong_entity_predictions", "exact_entity_precision", "evidence_supported_predictions", "evidence_support_rate", "company_owned_predictions", "coverage", "required_labels_present", "qualification_passed", "production_scale_gate_passed")


def research_suite(screens: DataFrame, single_supported: Column, abstained: Column, saved: Column) -> DataFrame:
    """AGG17: one row of points for the research suite from its screens (``exact, plan_exact, citations_complete``) and three flags."""
    c = F.col
    n = F.count("*")
    share = lambda x: ratio(F.count_if(x), n)
    t = screens.agg(share("exact").alias("_s"), share("plan_exact").alias("_p"), F.coalesce(F.min("citations_complete"), F.lit(True)).alias("_c"))
    t = t.withColumns({"cited_single_company_qa": F.when(single_supported, 4.0).otherwise(0.0), "cross_company_screening": 3 * c("_s"), "exact_inspectable_filters": 2 * c("_p"), "unsupported_abstention": F.when(abstained, 1.0).otherwise(0.0), "saved_history": F.when(saved, 1.0).otherwise(0.0), "provenance_export": F.when(c("_c"), 1.0).otherwise(0.0)})
    points = ["cited_single_company_qa", "cross_company_screening", "exact_inspectable_filters", "unsupported_abstention", "saved_history", "provenance_export"]
    total = F.bround(sum((c(p) for p in points), F.lit(0.0)), 6)
    return t.select(*[F.bround(p, 6).alias(p) for p in points], total.alias("score"), (single_supported & (c("_s") == 1) & (c("_p") == 1) & abstained & saved & c("_c")).alias("qualification_passed"))
