"""The controller over events read as observations and as earlier runs: histories, orders, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import controller
from heddle.operators import footprint as fp
from heddle.plans.base import OBSERVATIONS_SQL, observations
from heddle.plans.observations import _score_sql
from heddle.registry import query
from heddle.session import table

_NAMES = "[" + ", ".join(f"'{s}'" for s in controller.STRATEGIES) + "]"
_N = len(controller.STRATEGIES)

#: Runs: an event as a try of one of the first 17 strategies, so that the last is untried; every seventh has no learning gain of its own.
RUNS_SQL = f"""runs as (select cast(user_id as varchar) as org, event_id % {_N - 1} as idx, cast(coalesce(nullif(case when event_id % 7 <> 0 then round_even((value - 50) / 25, 3) end, 0), round_even(value / 100, 3), 0) as decimal(24,6)) as gain from events)"""


#: A mean at three places, half to even, by whole numbers: of micro units ``total`` over ``n`` runs.
_SHOWN = "(sign(total) * (abs(total) // (1000 * n) + case when 2 * (abs(total) % (1000 * n)) > 1000 * n or 2 * (abs(total) % (1000 * n)) = 1000 * n and (abs(total) // (1000 * n)) % 2 = 1 then 1 else 0 end) / 1000.0)"
_TOTAL = "cast(sum(gain) * 1000000 as bigint) as total"


def _half_even(x, places: int):
    """A double rounded as the SQL rounds it, half to even by its scaled double: 0.5075 is 507.5 thousandths less a bit there, and 0.507."""
    return F.rint(x * 10.0**places) / 10.0**places


def runs(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    names = F.array(*map(F.lit, controller.STRATEGIES))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("organisation_number"), F.get(names, (e % (_N - 1)).cast("int")).alias("strategy"),
        F.when(e % 7 != 0, _half_even((v - 50) / 25, 3)).alias("learning_gain"), _half_even(v / 100, 3).alias("score_delta"),
    )


def found(spark, sf_dir):
    """Observations with the strategy that found them, every nineteenth without a name."""
    names = F.array(*map(F.lit, controller.STRATEGIES))
    exp = F.col("acquisition_mode").isin(fp.EXPERIMENTAL_MODES) & F.col("exact_entity") & (F.col("identity_proof") != "")
    at = (F.col("id").cast("bigint") % (_N + 1)).cast("int")
    return observations(spark, sf_dir).withColumns({"experimental": exp, "strategy": F.get(names, at)})


@query("strategy_history", f"with {RUNS_SQL}, s as (select unnest({_NAMES}) as strategy, unnest(range({_N})) as idx), g as (select idx, count(*) as n, count(*) filter (where gain > 0) as ok, {_TOTAL} from runs group by 1) select strategy, coalesce(n, 0) as runs, coalesce(ok, 0) as successes, cast(coalesce({_SHOWN}, 0) as double) as mean_gain from s left join g using (idx)")
def strategy_history(spark, sf_dir):
    """AGG18: runs, runs that gained, and mean gain, for strategies without runs too."""
    h = controller.histories(runs(spark, sf_dir))
    return h.select("strategy", "runs", "successes", F.col("mean_shown").alias("mean_gain"))


def _walk_sql(by_company: bool) -> str:
    """The order of strategies as a recursion: in each step the best of those that are left."""
    org = "cast(user_id as varchar)" if by_company else "''"
    return f"""{RUNS_SQL}, orgs as (select distinct {org} as org from events), s as (select unnest(range({_N})) as idx, unnest({_NAMES}) as strategy),
g as (select {'org' if by_company else "'' as org"}, idx, count(*) as n, count(*) filter (where gain > 0) as ok, cast(sum(gain) as double) / count(*) as mean, {_TOTAL} from runs group by all),
gs as (select *, cast({_SHOWN} as double) as shown from g),
h as (select orgs.org, s.idx, s.strategy, coalesce(n, 0) as n, coalesce(ok, 0) as ok, coalesce(mean, 0) as mean, coalesce(shown, 0) as shown, sum(coalesce(n, 0)) over (partition by orgs.org) as total from orgs cross join s left join gs as g on g.org = orgs.org and g.idx = s.idx),
walk as (select org, 0 as i, cast(-1 as bigint) as idx, cast([] as bigint[]) as used from orgs
  union all select org, i + 1, best, list_append(used, best) from (
    select w.org, w.i, any_value(w.used) as used, arg_min(h.idx, (-(h.mean + 0.35 * sqrt(ln(greatest(1, h.total + w.i) + 1) / (h.n + 1))), h.idx)) as best
    from walk as w join h on h.org = w.org and not list_contains(w.used, h.idx) where w.i < {_N} group by w.org, w.i)),
steps as (select walk.org, i, h.idx, strategy, n, ok, shown as mean from walk join h on h.org = walk.org and h.idx = walk.idx where i > 0)"""


@query("strategy_order", f"with recursive {_walk_sql(False)} select strategy, cast(i as int) as place, n as runs from steps")
def strategy_order(spark, sf_dir):
    """TOP4: the order in which a company tries its strategies after all runs so far; those never tried have the bonus alone, ties by fixed order."""
    return controller.orders(controller.histories(runs(spark, sf_dir))).select("strategy", F.col("iteration").alias("place"), "runs")


def _ready(kind: str) -> str:
    felt = f"{kind} and sentiment_label is not null"
    return f"(count(*) filter (where {felt}) >= 10 and (count(distinct host) filter (where {felt}) >= 2 or count(distinct reviewer_id) filter (where {felt}) >= 10))"


def _trace_sql(by_company: bool) -> str:
    companies = "select distinct cast(user_id as varchar) as org from events" if by_company else "select cast(c_custkey as varchar) as org from customer"
    on = "steps.org = c.org" if by_company else "true"
    return f"""with recursive {OBSERVATIONS_SQL}, {_walk_sql(by_company)},
o as (select *, cast(id as bigint) as k, len(reasons) = 0 as ok, acquisition_mode = 'jobspy_experiment' and exact_entity and identity_proof <> '' as experimental from judged),
c as ({companies}), plan as (select c.org, i, idx, strategy, n, steps.ok as good, mean from c join steps on {on}),
placed as (select o.*, plan.i from o join plan on plan.org = o.organisation_number and plan.idx = case when k % {_N + 1} = {_N} then {_N - 1} else k % {_N + 1} end),
v as (select plan.org, plan.i, count(*) filter (where placed.i = plan.i) as added, cast({_score_sql(False)} as double) as score, cast({_score_sql(True)} as double) as exp_score, {_ready('ok')} as ready, {_ready('experimental')} as exp_ready
  from plan left join placed on placed.organisation_number = plan.org and placed.i <= plan.i group by 1, 2),
d as (select *, coalesce(lag(score) over w, 0) as before, score - coalesce(lag(score) over w, 0) as delta, exp_score - coalesce(lag(exp_score) over w, 0) as exp_delta from v window w as (partition by org order by i)),
t as (select plan.org as organisation_number, cast(plan.i as int) as iteration, strategy, case when mean > 0 then 'replicate' else 'explore' end as controller_action, n as prior_runs, good as prior_successes,
  mean as prior_mean_learning_gain, added as new_observations, before as score_before, score as score_after, delta as score_delta, exp_delta as experimental_potential_delta,
  round_even(delta + greatest(0.0, exp_delta - delta) * 0.25, 3) as learning_gain, exp_score as experimental_potential_score, case when ready then 'available' else 'abstain' end as sentiment_status,
  case when exp_ready then 'available' else 'abstain' end as experimental_sentiment_status,
  case when delta > 0 then 'reinforce_publishable' when exp_delta > 0 then 'reinforce_experimental' when added > 0 then 'hold' else 'blocked_no_input' end as result from plan join d on d.org = plan.org and d.i = plan.i)"""


@query("controller_trace", f"{_trace_sql(False)} select * from t")
def controller_trace(spark, sf_dir):
    """STR7: all companies, also those of which nothing was found, after the runs of all."""
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("organisation_number"))
    return controller.trace(companies, found(spark, sf_dir), runs(spark, sf_dir))


@query("controller_own_history", f"{_trace_sql(True)} select * from t")
def controller_own_history(spark, sf_dir):
    """STR7 where each company follows its own earlier runs."""
    companies = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("organisation_number")).distinct()
    return controller.trace(companies, found(spark, sf_dir), runs(spark, sf_dir), own_history=True)


@query("controller_outcome", f"{_trace_sql(False)} select organisation_number, count(*) as iterations_run, arg_max(score_after, iteration) as final_score, arg_max(experimental_potential_score, iteration) as final_potential, arg_max(score_after, iteration) >= 80 as target_reached from t group by 1")
def controller_outcome(spark, sf_dir):
    return controller.outcome(controller_trace(spark, sf_dir))


@query("controller_final_score", f"with {OBSERVATIONS_SQL}, o as (select *, len(reasons) = 0 as ok, false as experimental from judged) select organisation_number, cast({_score_sql(False)} as double) as score from o group by 1")
def controller_final_score(spark, sf_dir):
    """The controller's last score doesn't depend on the order of its steps: it is the score of all that they found."""
    rows = observations(spark, sf_dir).withColumn("experimental", F.lit(False))
    return fp.development_score(rows).select("organisation_number", "score")
