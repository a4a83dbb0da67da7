"""Rows that only larger tables have, and plans that larger tables need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heddle.functions import numbers
from heddle.operators import pages, refresh
from heddle.plans import changes, companies, connected, control, found, listings, registers, screens
from heddle.registry import ORACLES


def test_amounts_that_round_to_a_thousand_are_whole(spark):
    rows = spark.createDataFrame([(1, 999.6), (2, -999.51), (3, 999.5), (4, 12.5), (5, 1000.0), (6, None)], "id int, x double")
    got = [r.t for r in rows.select("id", numbers.currency(F.col("x")).alias("t")).orderBy("id").collect()]
    assert got == ["1000 NOK", "-1000 NOK", "1000 NOK", "12 NOK", "1.0k NOK", "N/A"]


def test_losses_that_round_to_nothing_keep_their_sign(spark, duck, tmp_path):
    """As one balance in some twenty thousand has them: the SQL and the reference write -0, and halves go to the even number."""
    balances = [-0.5, -0.49, -0.01, 0.0, 0.5, -0.51, -1.5, 2.5, -999.5, 999.5, -1050.0]
    told = ", ".join(f"({i + 1}, {x}::double)" for i, x in enumerate(balances))
    made = {
        "customer": f"select i::bigint as c_custkey, 'C' || i as c_name, 0 as c_nationkey, x as c_acctbal, 'BUILDING' as c_mktsegment from (values {told}) t(i, x)",
        "orders": f"select i::bigint as o_orderkey, i::bigint as o_custkey, 100.0::double as o_totalprice, timestamp '2020-01-01' as o_orderdate from (values {told}) t(i, x)", "nation": "select 0 as n_nationkey, 'N' as n_name",
    }
    own = duck.cursor()
    own.execute("create schema small_losses")
    own.execute("set schema = 'small_losses'")
    for name, sql in made.items():
        own.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        own.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet')")
    want = own.execute(f"select organisation_number, brief from ({ORACLES['company_brief']}) order by 1").fetchall()
    got = [tuple(r) for r in companies.company_brief(spark, str(tmp_path)).orderBy("organisation_number").collect()]
    assert [b.split("operating result of ")[1].split(",")[0] for _, b in got] == ["-0 NOK", "-0 NOK", "-0 NOK", "0 NOK", "0 NOK", "-1 NOK", "-2 NOK", "2 NOK", "-1000 NOK", "1000 NOK", "-1.0k NOK"]
    assert got == want


def test_runs_are_rounded_as_the_sql_rounds_them(spark, duck, tmp_path):
    """Halves that a scaled double misses (0.5075) or meets (0.1715), as one table in a hundred has them."""
    values = [50.75, 17.15, 51.15, 50.15, 48.65, 0.65, 99.99]
    told = ", ".join(f"({7 * i}, {v}::double)" for i, v in enumerate(values))
    duck.execute(f"copy (select i::bigint as event_id, 1::bigint as user_id, v as value from (values {told}) t(i, v)) to '{tmp_path}/events.parquet' (format parquet)")
    want = [r[0] for r in duck.execute(f"select round_even(value / 100, 3) from read_parquet('{tmp_path}/events.parquet') order by event_id").fetchall()]
    rows = control.runs(spark, str(tmp_path)).select("strategy", "score_delta").collect()
    assert sorted(r.score_delta for r in rows) == sorted(want)


@pytest.mark.parametrize(
    ("html", "title", "main"),
    [
        ("<title>A &amp; B&amp</title><p>c&amp d&copy; &#65; &#65 &lt", "A & B&amp", "c&amp d© A &#65 &lt"),
        ("<title>x</title><script>var a='&amp';</script><!-- &amp --><p>a & b &nosuch; <a href='/?x=1&copy=2'>l</a>", "x", "a & b &nosuch; l"),
    ],
)
def test_entities_need_their_semicolon(spark, html, title, main):
    r = pages.with_parts(spark.createDataFrame([(html,)], "html string")).head()
    assert (r.title, r.main_text) == (title, main)


def test_scripts_keep_their_ampersands(spark):
    html = """<script type="application/ld+json">{"name":"A & B &amp"}</script><a href="/?x=1&copy=2">l</a>"""
    r = pages.with_parts(spark.createDataFrame([(html,)], "html string")).head()
    assert (r.json_ld, r.links[0].href) == (['{"name":"A & B &amp"}'], "/?x=1&copy=2")


@pytest.mark.parametrize("made", [lambda *a: found._jobs(*a)[0], lambda *a: found._jobs(*a)[1], lambda *a: found._handles(*a)[0], lambda *a: found._handles(*a)[1], found.discovered_handles], ids=["jobs", "report", "observations", "outcomes", "discovered"])
def test_pages_made_of_rows_are_not_sent_through_the_driver(spark, sf_dir, made):
    plan = made(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_profiles_are_not_sorted_before_they_are_sent(spark, sf_dir):
    plan = changes.refresh_profiles(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SortAggregate" not in plan


def test_hashes_are_sent_as_bytes_and_come_back_as_they_were(spark):
    texts = ["ab" * 32, "", "AB" * 32, "abc", "no hash", "ab\n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    packed = rows.select("id", refresh._packed_hash(F.col("x")).alias("p"))
    got = packed.select("id", F.length("p.bytes").alias("n"), refresh._unpacked_hash(F.col("p")).alias("x")).orderBy("id").collect()
    assert [r.x for r in got] == texts and got[0].n == 32


def test_listings_are_made_by_all_tasks(spark, sf_dir):
    """The customers are one row group, so one task would make and sort all of their listings."""
    assert listings._listings(spark, sf_dir).rdd.getNumPartitions() == 4 and listings._profiles(spark, sf_dir).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("made", [registers.workspaces, screens._asked, connected.account_normalise], ids=["workspaces", "screens", "accounts"])
def test_rows_that_cost_much_are_dealt_over_all_tasks(spark, sf_dir, made):
    assert made(spark, sf_dir).rdd.getNumPartitions() == 4


def test_screens_are_read_after_they_are_dealt(spark, sf_dir):
    """Once, and above the exchange by the part's key; a filter on what was read would be moved below it."""
    plan = screens.screen_refused(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression")
