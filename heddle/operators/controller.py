"""STR7, UDF3: the order in which evidence strategies are tried for each company, and what each try brings.

A company tries each strategy once. The next is the one of the highest priority: the mean gain that earlier runs saw, and a bonus for what
was tried little. As a strategy isn't tried again, its own gain changes no later choice of the company; only the number of runs so far does. So
the choices are a fold over the strategies left, per history, and the scores a running merge of the
states (see :func:`footprint.score_states`) that each strategy adds. Both hold at most one entry a strategy: a company
with any number of observations is a few rows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators import footprint as fp

#: Strategies in the order that decides ties, and the one for observations that name none (fixed values).
STRATEGIES = [
    "company_site_feed",
    "company_site_identity",
    "company_site_activity",
    "company_directory_identity",
    "verified_handle_extraction",
    "registry_workforce_snapshot",
    "about_contact_deep_pages",
    "youtube_channel_feed",
    "places_identity_resolution",
    "places_rating_reviews",
    "jobs_feed_discovery",
    "linkedin_workforce_snapshot",
    "annual_report_workforce_snapshot",
    "social_profile_metrics",
    "independent_news_discovery",
    "exact_entity_article_capture",
    "independent_sentiment",
    "buzz_peer_normalization",
]
UNNAMED = "buzz_peer_normalization"
#: Weight of the bonus for what was tried little, and of gains that can't be published yet (fixed values).
EXPLORE, EXPERIMENTAL_SHARE = 0.35, 0.25
GAIN = "decimal(24,6)"


def thousandths(total: Column, n: Column) -> Column:
    """A decimal sum over a count, rounded half to even at three places by whole numbers, as a double can't hold such a half."""
    micro, step = F.abs(total * 1_000_000).cast("decimal(38,0)"), (n * 1000).cast("decimal(38,0)")
    low = F.floor(micro / step).cast("long")
    rest = 2 * (micro - low * step)
    up = (rest > step) | (rest == step) & (low % 2 == 1)
    return F.signum(total.cast("double")) * (low + up.cast("int")).cast("double") / 1000


def histories(runs: DataFrame, by: tuple[str, ...] = (), of: DataFrame | None = None) -> DataFrame:
    """AGG18: of earlier runs (``strategy``, ``learning_gain``, ``score_delta``) a row for each strategy: runs, successes, mean gain, and that as it is shown.

    A run's gain is its learning gain or, where that is null or zero, its score's change; a run that gained over zero is a success. Strategies
    without runs are there with zeros (for each row of ``of``, if runs are told apart ``by`` its columns), others than those known as well.
    Sums are of decimals, so any order of rows gives the same mean.
    """
    gain = F.coalesce(F.nullif(F.col("learning_gain").cast(GAIN), F.lit(0).cast(GAIN)), F.col("score_delta").cast(GAIN), F.lit(0).cast(GAIN))
    each = runs.select(*by, F.coalesce(F.col("strategy").cast("string"), F.lit("")).alias("strategy"), gain.alias("gain"))
    seen = each.groupBy(*by, "strategy").agg(F.count("*").alias("runs"), F.count_if(F.col("gain") > 0).alias("successes"), F.sum("gain").alias("_sum"))
    seen = seen.withColumns({"mean": F.col("_sum").cast("double") / F.col("runs"), "mean_shown": thousandths(F.col("_sum"), F.col("runs"))}).drop("_sum")
    known = runs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(STRATEGIES)], "strategy string, place int")
    if by:
        of = of if of is not None else runs.select(*by).distinct()
        known, seen = of.select(*by).crossJoin(F.broadcast(known)), seen.join(of.select(*by), list(by), "left_semi")
    full = known.join(seen, [*by, "strategy"], "full")
    return full.select(*by, "strategy", "place", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "successes")], F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("mean_shown", F.lit(0.0)).alias("mean_shown"))


def priority(mean: Column, runs: Column, total: Column) -> Column:
    """TOP4: mean gain and a bonus that falls with the strategy's runs and grows with all runs."""
    return mean + EXPLORE * F.sqrt(F.ln(F.greatest(total, F.lit(1)) + 1) / (runs + 1))


def orders(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The strategies of each history in the order in which they are tried: ``iteration`` from 1, ties by their fixed order.

    At most as many entries as there are strategies are held for a history.
    """
    entry = F.struct("place", "strategy", "runs", "successes", "mean", "mean_shown")
    g = history.groupBy(*by).agg(F.sum("runs").alias("total"), F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), entry))).alias("left"))

    def choose(state: Column, i: Column) -> Column:
        rated = F.transform(state["left"], lambda x: F.struct((-priority(x["mean"], x["runs"], F.col("total") + i)).alias("rank"), x["place"].alias("place"), x.alias("x")))
        best = F.array_min(rated)["x"]
        return F.struct(F.filter(state["left"], lambda x: x["place"] != best["place"]).alias("left"), F.concat(state["done"], F.array(best)).alias("done"))

    start = F.struct("left", F.slice("left", 1, 0).alias("done"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(len(STRATEGIES) - 1)), start, choose, lambda s: s["done"])
    return g.select(*by, F.posexplode(done).alias("at", "x")).select(*by, (F.col("at") + 1).alias("iteration"), "x.strategy", "x.runs", "x.successes", F.col("x.mean_shown").alias("mean"))


def trace(companies: DataFrame, observations: DataFrame, runs: DataFrame, *, own_history: bool = False, most_iterations: int | None = None) -> DataFrame:
    """One row for each company and iteration: the strategy, what was known of it, what it added, and the scores before and after.

    ``companies`` has ``organisation_number``, each once, and may have ``site_identity``. ``observations`` as :func:`footprint.score_states` needs them, with
    ``strategy``; null is the fixed one, and strategies outside the list are never tried. ``runs`` are earlier ones of all companies or, with
    ``own_history``, each of the company that it names; a company without any has an empty history.
    """
    by = ("organisation_number",) if own_history else ()
    who = companies.select("organisation_number", *[c for c in ("site_identity",) if c in companies.columns])
    if own_history:
        steps = who.join(orders(histories(runs, by, who), by), list(by))
    else:
        # As many rows as there are strategies.
        steps = who.crossJoin(F.broadcast(orders(histories(runs))))
    if most_iterations is not None:
        steps = steps.filter(F.col("iteration") <= most_iterations)
    states = fp.score_states(observations.withColumn("strategy", F.coalesce("strategy", F.lit(UNNAMED))), ("strategy",))
    if "site_identity" in who.columns:
        states, own = states.drop("site"), F.coalesce(F.col("site_identity"), F.lit(False)).cast("int")
    rows = steps.join(states, ["organisation_number", "strategy"], "left").withColumn("added", F.coalesce("seen", F.lit(0)))
    if "site_identity" in who.columns:
        rows = rows.withColumn("site", own)
    so_far = Window.partitionBy("organisation_number").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    kept = ["organisation_number", "iteration", "strategy", "runs", "successes", "mean", "added"]
    after = rows.select(*kept, *[v.alias(k) for k, v in fp.merged_states(so_far).items()])
    scored = after.select(*kept, *[v.alias(k) for k, v in fp.state_scores().items()])
    in_order = Window.partitionBy("organisation_number").orderBy("iteration")
    c = F.col
    before = lambda n: F.coalesce(F.lag(n).over(in_order), F.lit(0.0))
    delta = scored.withColumns({"before": before("score"), "delta": F.bround(c("score") - before("score"), 3), "exp_delta": F.bround(c("exp_score") - before("exp_score"), 3)})
    status = lambda x: F.when(x, "available").otherwise("abstain")
    return delta.select(
        "organisation_number", "iteration", "strategy", F.when(c("mean") > 0, "replicate").otherwise("explore").alias("controller_action"),
        c("runs").alias("prior_runs"), c("successes").alias("prior_successes"), c("mean").alias("prior_mean_learning_gain"), c("added").alias("new_observations"),
        c("before").alias("score_before"), c("score").alias("score_after"), c("delta").alias("score_delta"), c("exp_delta").alias("experimental_potential_delta"),
        F.bround(c("delta") + F.greatest(F.lit(0.0), c("exp_delta") - c("delta")) * EXPERIMENTAL_SHARE, 3).alias("learning_gain"), c("exp_score").alias("experimental_potential_score"),
        status(c("sentiment_ready")).alias("sentiment_status"), status(c("exp_sentiment_ready")).alias("experimental_sentiment_status"),
        F.when(c("delta") > 0, "reinforce_publishable").when(c("exp_delta") > 0, "reinforce_experimental").when(c("added") > 0, "hold").otherwise("blocked_no_input").alias("result"),
    )


def outcome(traced: DataFrame, target: float = 80.0) -> DataFrame:
    """One row a company: iterations, the last score, and whether it reached the target."""
    last = traced.groupBy("organisation_number").agg(F.count("*").alias("iterations_run"), F.max_by(F.struct("score_after", "experimental_potential_score"), "iteration").alias("x"))
    return last.select("organisation_number", "iterations_run", F.col("x.score_after").alias("final_score"), F.col("x.experimental_potential_score").alias("final_potential"), (F.col("x.score_after") >= target).alias("target_reached"))
