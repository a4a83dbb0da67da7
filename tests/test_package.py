"""Resumable writes, envelope packages, and orders of written tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heddle.operators import package, written
from heddle.sources import resumable

AT = {"key": "organisation_number", "position": "position"}


@pytest.fixture
def manifest(spark):
    return spark.createDataFrame([(f"{900000000 + k}", k * 7) for k in range(103)], "organisation_number string, position long")


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, manifest):
    calls = []

    def work(batch, number):
        calls.append(number)
        if number == 2 and len(calls) == 3:
            raise RuntimeError("killed")
        return batch.select("organisation_number", (F.col("position") * 2).alias("v"))

    folder, whole = str(tmp_path / "a"), str(tmp_path / "b")
    options = AT | {"rows": 25, "parameters": {"scale": 2}}
    with pytest.raises(RuntimeError):
        resumable.run(manifest, work, folder, **options)
    # What a stopped batch has left is not read, and is written over.
    spark.createDataFrame([("x", 1)], "organisation_number string, v long").write.parquet(f"{folder}/rows/batch=2")
    schema = "organisation_number string, v long"
    assert resumable.committed(spark, folder, schema).count() == 50
    told = resumable.run(manifest.repartition(5), work, folder, **options)
    assert told == {"batches": 5, "skipped": 2, "done": 3, "complete": True} and calls == [0, 1, 2, 2, 3, 4]
    resumable.run(manifest, work, whole, **options)
    rows = lambda f: sorted(map(tuple, resumable.committed(spark, f, schema).collect()))
    assert rows(folder) == rows(whole) and len(rows(folder)) == 103
    assert sorted(map(tuple, resumable.report(spark, folder).collect())) == sorted(map(tuple, resumable.report(spark, whole).collect()))
    assert [r.n for r in resumable.committed(spark, folder, schema).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [25, 25, 25, 25, 3]


def test_another_input_is_refused(spark, tmp_path, manifest):
    folder, work = str(tmp_path / "a"), lambda batch, number: batch
    options = AT | {"rows": 50, "parameters": {"a": 1}}
    resumable.run(manifest, work, folder, **options, most_batches=1)
    for other, more in ((manifest.limit(102), {}), (manifest.withColumn("position", -F.col("position")), {}), (manifest, {"parameters": {"a": 2}}), (manifest, {"rows": 51})):
        with pytest.raises(resumable.Refused, match="another input"):
            resumable.run(other, work, folder, **(options | more))
    assert resumable.run(manifest, work, folder, **options)["skipped"] == 1
    assert resumable.run(manifest, work, folder, **options) == {"batches": 3, "skipped": 3, "done": 0, "complete": True}


def test_an_empty_manifest_gives_an_empty_run(spark, tmp_path, manifest):
    folder = str(tmp_path / "a")
    assert resumable.run(manifest.limit(0), lambda b, n: b, folder, **AT, rows=5, parameters={})["batches"] == 0


def profiles(manifest, **states):
    one = lambda name, status: package.evidence(name, status, f"{name}_source", F.lit("https://x/"), F.lit("t1"), note=F.lit("robots.txt"))
    return manifest.select("organisation_number", F.create_map(*[x for m, s in states.items() for x in (F.lit(m), one(m, s))]).alias("evidence"))


def test_envelopes_end_in_a_state(spark, manifest):
    k = F.col("organisation_number").cast("long") % 7
    status = F.element_at(F.array(*map(F.lit, ["available", "not_found", "not_applicable", "blocked", "source_error", "not_fetched", "available"])), (k + 1).cast("int"))
    rows = profiles(manifest, registry=F.lit("available"), website=status)
    got = package.envelopes(rows, ["registry", "website", "roles"], run_id="r", started_at="t0", completed_at="t2").limit(7).collect()
    assert {r.modules["roles"].state for r in got} == {"submission_error"} and {r.state for r in got} == {"submission_error"}
    assert {r.modules["roles"].final_timestamp for r in got} == {"t2"} and {r.modules["website"].final_timestamp for r in got} == {"t1"}
    fine = package.envelopes(rows, ["registry", "website"], run_id="r", started_at="t0", completed_at="t2")
    states = {r[0] for r in fine.select(F.col("modules")["website"]["state"]).distinct().collect()}
    assert states == {"complete", "not_found", "not_applicable", "blocked_robots", "source_error", "submission_error"}
    complete = rows.select(package.module_complete(F.col("evidence"), ["registry", "website"]).alias("x"), package.module_complete(F.col("evidence"), ["roles"]).alias("y"))
    assert {tuple(r) for r in complete.distinct().collect()} == {(True, False), (False, False)}


def test_packages_are_checked_as_they_are_written(spark, tmp_path, manifest):
    sizes = {r.batch: r["count"] for r in resumable.batched(manifest, "organisation_number", "position", 40).groupBy("batch").count().collect()}

    def build(batch, again):
        rows = package.envelopes(profiles(batch, registry=F.lit("available")), ["registry"], run_id="r", started_at="t0", completed_at="t2")
        return rows.union(rows.limit(1)) if again else rows

    for again in (False, True):
        check = package.checked(build(manifest, False), sizes.get)[1]
        go = lambda again=again, check=check: resumable.run(manifest, lambda b, n: package.checked(build(b, again), sizes.get)[0], str(tmp_path / str(again)), **AT, rows=40, parameters={}, check=check)
        if again:
            with pytest.raises(resumable.Refused, match="exact_expected_count, unique_organisation_numbers, zero_silent_drops"):
                go()
            assert resumable.report(spark, str(tmp_path / "True")).count() == 0
        else:
            assert go()["done"] == 3


def test_envelope_sets_are_validated(spark, manifest):
    rows = package.envelopes(profiles(manifest, registry=F.lit("available")), ["registry"], run_id="r", started_at="t0", completed_at="t2")
    assert package.validated(rows, 103).head().asDict() == {"passed": True, "exact_expected_count": True, "unique_organisation_numbers": True, "all_entity_states_terminal": True, "all_module_states_terminal": True, "zero_silent_drops": True, "invalid_states": 0}
    odd = rows.withColumn("modules", F.transform_values("modules", lambda k, v: v.withField("state", F.lit("running")))).withColumn("state", F.lit(None).cast("string"))
    got = package.validated(odd.union(rows.limit(1)), 103).head()
    assert not (got.passed or got.exact_expected_count or got.unique_organisation_numbers or got.all_entity_states_terminal or got.all_module_states_terminal or got.zero_silent_drops)
    assert package.invalid_states(odd).count() == got.invalid_states == 103


def test_orders_of_written_tables(spark, tmp_path):
    def write(name, keys, files):
        path = str(tmp_path / name)
        spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long").repartitionByRange(files, "i").sortWithinPartitions("i").select("k").write.parquet(path)
        return written.placed(spark, path, "k")

    keys = [f"k{i:03}" for i in range(90)]
    want = write("want", keys, 3)
    assert [r.k for r in want.orderBy("place").collect()] == keys
    same = write("same", keys, 7)
    assert written.order_faults(want, same, "k").count() == 0 and written.same_order(want, same, "k").head().same
    cases = {
        "missing": (keys[:40] + keys[41:], {("k040", "missing")}),
        "unexpected": (keys[:40] + ["new"] + keys[40:], {("new", "unexpected")}),
        "repeated": (keys[:40] + ["k010"] + keys[40:], {("k010", "repeated")}),
        "swapped": ([*keys[:10], "k011", "k010", *keys[12:]], {("k010", "moved"), ("k011", "moved")}),
    }
    for name, (there, faults) in cases.items():
        found = write(name, there, 4)
        assert {(r.k, r.fault) for r in written.order_faults(want, found, "k").collect()} == faults, name
        first = written.first_mismatches(want, found, "k", width=30).orderBy("range_start").head()
        at = next(i for i, (a, b) in enumerate(zip(keys, there, strict=False)) if a != b)
        assert (first.place, first.expected, first.found) == (at, keys[at], there[at]), name
        told = written.same_order(want, found, "k").head()
        assert not told.same and (told.expected_rows, told.found_rows) == (90, len(there))


def test_numbers_are_finite_at_any_depth(spark):
    schema = "a double, b struct<c:array<struct<d:float,e:string>>,f:map<string,double>>, g string, h array<array<double>>"
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, ([(1.0, "x")], {"p": 2.0}), "NaN", [[1.0]]), (nan, ([(1.0, "x"), (inf, "y")], {"p": -inf, "q": 1.0}), "x", [[1.0, nan], [], [inf]]), (None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [r.x for r in df.select(written.not_finite_paths(df.schema).alias("x")).collect()]
    assert got == [[], ["a", "b.c[1].d", "b.f.p", "h[0][1]", "h[2][0]"], []]


def test_contract_of_a_package(spark):
    claim, ev = "array<struct<availability:string,value:string,evidence_ids:array<string>>>", "array<struct<id:string,source_url:string,retrieved_at:string,content_sha256:string>>"
    good = [("e1", "u", "t", "h")]
    rows = [([("available", "0", ["e1"]), ("not_available", None, [])], good), ([("not_available", "0.0", [])], good), ([("available", "x", [])], good), ([("available", "x", None)], good), ([("available", "x", ["e2"])], good), ([], [("e1", "", "t", "h")])]
    df = spark.createDataFrame(rows, f"claims {claim}, evidence {ev}")
    got = [[k for k, v in r.asDict().items() if v] for r in df.select(*[v.alias(k) for k, v in written.contract_faults().items()]).collect()]
    assert got == [[], ["missing converted to zero"], ["available claim without evidence"], ["available claim without evidence"], ["unknown evidence"], ["evidence without mandatory fields"]]
