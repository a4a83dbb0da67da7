"""Operators on literal rows: nulls, ties, missing keys, idempotence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heddle.functions import numbers, text, udfs, urls
from heddle.operators import refresh
from heddle.operators import relational as rel
from heddle.operators.screen import parse
from heddle.sources import readers


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(("raw", "value"), [("1 234,5", 1234.5), ("(7)", -7.0), ("0", 0.0), ("-", None), (None, None), ("x", None), ("1.000.000", None), ("1.000.000,5", 1000000.5), ("1,234.5", None), ("1.5", 1.5), ("--5", 5.0)])
def test_numbers(spark, raw, value):
    assert one(spark, numbers.norwegian_number(F.col("raw")), raw=raw) == value


def test_missing_is_not_zero(spark):
    assert one(spark, numbers.norwegian_number(F.col("raw")), raw="") is None
    assert one(spark, numbers.norwegian_number(F.col("raw")), raw="0") == 0.0


def test_folding_agrees_with_the_general_form(spark):
    words = ["Blåbær ØL", "Crème brûlée", "ÆØÅ", "", None, "naïve Ÿ"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select(F.regexp_replace(text.folded(F.col("w")), "[^a-z0-9 ]", "").alias("a"), F.regexp_replace(udfs.ascii_folded(F.col("w")), "[^a-z0-9 ]", "").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_difference_ratio(spark):
    from difflib import SequenceMatcher

    assert one(spark, udfs.sequence_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()


def test_canonical_url_is_stable(spark):
    url = "HTTPS://Www.Example.com:443//a//b?b=2&utm_source=x&a=1&c=#top"
    once = one(spark, urls.canonical(F.col("u")), u=url)
    assert once == "https://www.example.com/a/b?a=1&b=2"
    assert one(spark, urls.canonical(F.col("u")), u=once) == once


def test_anchor_keeps_every_manifest_row(spark):
    m = spark.createDataFrame([("1", 0), ("2", 1), ("3", 2)], "k string, position int")
    b = spark.createDataFrame([("3", "c"), ("1", "a")], "k string, v string")
    assert [(r.k, r.v, r.status) for r in rel.anchor(m, b, "k", "position").collect()] == [("1", "a", "available"), ("2", None, "not_available"), ("3", "c", "available")]


def test_failed_source_is_no_removal(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    new = spark.createDataFrame([("1", None, "source_error"), ("2", None, "available")], "k string, v string, s string")
    got = refresh.changes(old, new, "k", {"v": "v"}, "s").collect()
    assert [(r.k, r.old_value, r.new_value) for r in got] == [("2", "b", None)]


def test_same_snapshot_twice_is_no_change(spark):
    rows, none = spark.createDataFrame([("1", "a", None)], "k string, v string, w string"), {"v": "v", "w": "w"}
    assert refresh.changes(rows, rows, "k", none).count() == 0


def test_strict_changes_need_the_same_entities(spark):
    a, b = spark.createDataFrame([("1", "a")], "k string, v string"), spark.createDataFrame([("2", "a")], "k string, v string")
    assert {r.side for r in refresh.changes(a, b, "k", {"v": "v"}).collect()} == {"only_old", "only_new"}
    with pytest.raises(Exception, match="same entities"):
        refresh.changes(a, b, "k", {"v": "v"}, strict=True).collect()


def test_values_at_places(spark):
    values = [None, 5.0, 1.0, 1.0, 1.0, 9.0, 3.0] + [7.0] * 300 + [float(i) for i in range(100, 400)]
    rows = spark.createDataFrame([(g, v) for g in ("a", "b", None) for v in values], "g string, v double")
    places = {"first": "0", "half": "n div 2", "last": "n - 1"}
    want = sorted(v for v in values if v is not None)
    got = rel.values_at(rows, "v", places, "g", runs=8).collect()
    assert {(r.g, r.first, r.half, r.last) for r in got} == {(g, want[0], want[len(want) // 2], want[-1]) for g in ("a", "b", None)}
    assert rel.values_at(rows.filter("false"), "v", places, "g").count() == 0


def test_nothing_expected_and_nothing_seen_is_perfect(spark):
    none = spark.createDataFrame([], "k string")
    r = refresh.replay_metrics(none, none, ["k"]).head()
    assert (r.precision, r.recall) == (1.0, 1.0)


def test_spacing_is_the_recurrence(spark):
    times = [0.0, 1.0, 1.5, 10.0, 10.1, 10.2]
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate(times)], "g string, i int, t double")
    got = [round(r.start, 6) for r in rel.spaced(rows, "g", F.col("t"), ["i"], 2.1).orderBy("i").collect()]
    want, last = [], None
    for t in times:
        last = t if last is None else max(t, last + 2.1)
        want.append(round(last, 6))
    assert got == want


def test_sample_does_not_depend_on_order(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    a = rel.hash_sample(rows, "k", 10, "s").collect()
    assert a == rel.hash_sample(rows.orderBy(F.desc("k")).repartition(7), "k", 10, "s").collect()


def test_screen_refuses_what_it_cannot_prove():
    assert not parse("companies with good reviews").executable
    assert not parse("hello there").executable
    assert parse("top 500 by revenue").limit == 100


def test_registers_in_two_forms(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿organisasjonsnummer;navn;antallAnsatte;konkurs\n912345678;A AS;x;true\n12;B;1;false\n812345678;C;0;\n", encoding="utf-8")
    got = readers.bulk(spark, str(tmp_path / "r.csv")).orderBy("organisation_number").collect()
    assert [(r.organisation_number, r.employees, r.bankrupt) for r in got] == [("812345678", 0, False), ("912345678", None, True)]


def test_manifest_refuses_bad_and_repeated_keys(spark, tmp_path):
    (tmp_path / "a.txt").write_text("912 345 678\n812345678\n")
    assert [r.organisation_number for r in readers.manifest(spark, str(tmp_path / "a.txt")).orderBy("position").collect()] == ["912345678", "812345678"]
    (tmp_path / "b.txt").write_text("912345678\n912345678\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.manifest(spark, str(tmp_path / "b.txt"))


def test_missing_response_has_status_zero(spark):
    got = readers.responses(spark.createDataFrame([("u",), ("w",)], "url string"), spark.createDataFrame([("u", 200, "b")], "url string, status int, body string")).orderBy("url").collect()
    assert [(r.url, r.status) for r in got] == [("u", 200), ("w", 0)]


def test_profiles_of_platforms(spark):
    from heddle.functions import urls

    profile = lambda u: one(spark, urls.social_profile(F.col("u"))["url"], u=u)
    assert profile("https://no.linkedin.com/company/Fjord/about?x=1") == "https://linkedin.com/company/Fjord"
    assert profile("https://x.com/Fjord/status/1") is None and profile("https://linkedin.com/in/ola") is None and profile("https://twitter.com/fjord") == "https://x.com/fjord"
    assert one(spark, urls.canonical(F.col("u")), u="https://a.no:80/x?b=%C3%A5&a=1+2&utm_source=z") == "https://a.no:80/x?a=1+2&b=%C3%A5"
    assert one(spark, urls.canonical(F.col("u")), u="http://a.no:80//x") == "http://a.no/x"


def test_candidates_need_their_name_in_the_host(spark):
    from heddle.functions import identity

    args = [F.lit(x) for x in ("Fjord Kraft AS", "912345678", "Bergen", "Fjord Kraft", "kraft i Bergen")]
    got = one(spark, identity.candidate(*args, F.col("h")), h="kraftnytt.no")
    assert (got.score, got.publishable) == (0.55, False)
    assert one(spark, identity.candidate(*args, F.col("h")), h="fjordkraft.no").status == "accepted_for_crawl"
    assert one(spark, identity.candidate(*args, F.col("h")), h="no.proff.no").score == 0
    assert one(spark, identity.handle_score(F.lit("Fjord AS"), F.col("h")), h="fjord") == 0.98


def test_refused_requests_cost_nothing(spark):
    rows = spark.createDataFrame([(0, i, c, h) for i, (c, h) in enumerate([(5, False), (5, False), (20, False), (3, True), (20, True), (1, True)])], "budget int, at int, cost int, high boolean")
    got = rel.admitted(rows, ["at"], "cost", 10, 25, F.col("high")).orderBy("at").collect()
    plain, made = [], 0
    for cost, high in [(5, False), (5, False), (20, False), (3, True), (20, True), (1, True)]:
        plain.append((made, made < (25 if high else 10)))
        made += cost if plain[-1][1] else 0
    assert [(r.used_before, r.admitted) for r in got] == plain


def test_last_bulk_row_counts(spark):
    m = spark.createDataFrame([("a", 0), ("b", 1)], "k string, position int")
    b = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("c", 1, "z")], "k string, at int, v string")
    assert [(r.k, r.v, r.status) for r in rel.anchor(m, b, "k", "position", "at").collect()] == [("a", "y", "available"), ("b", None, "not_available")]


def test_ratios_and_folds_of_whole_tables(spark, sf_dir):
    """The two Arrow functions against the standard library, on every page and document."""
    import unicodedata
    from difflib import SequenceMatcher
    from hashlib import sha256

    from heddle.functions.udfs import KEPT
    from heddle.plans import texts
    from heddle.registry import QUERIES

    pages = {r.page_id: (r.title, r.h1) for r in texts._pages(spark, sf_dir).collect()}
    assert {r.page_id: r.ratio for r in QUERIES["sequence_ratio"](spark, sf_dir).collect()} == {k: round(SequenceMatcher(None, a, b).ratio(), 6) for k, (a, b) in pages.items()}
    plain = lambda t: unicodedata.normalize("NFKD", t.translate(KEPT)).encode("ascii", "ignore").decode().casefold()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {r.doc_id: r.folded_sha256 for r in QUERIES["ascii_fold"](spark, sf_dir).collect()} == {r.doc_id: sha256(plain(r.text).encode()).hexdigest() for r in docs}


def test_workspaces_recover(spark):
    from heddle.operators import register

    cases = {None: ([], 0, None), "": ([], 0, "JSONDecodeError"), "{": ([], 0, "JSONDecodeError"), "[]": ([], 0, "ValueError"), '{"schema_version":1,"pins":"x","history":[]}': ([], 0, "ValueError"), '{"schema_version":1,"pins":["b"],"history":[{"a":1}]}': (["b"], 1, None)}
    rows = spark.createDataFrame([(b,) for b in cases], "b string").select("b", register.workspace(F.col("b")).alias("w")).collect()
    assert {r.b: (r.w.pins, len(r.w.history), r.w.warning and r.w.warning.split()[-1]) for r in rows} == cases
