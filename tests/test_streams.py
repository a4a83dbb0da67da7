"""The crawl as a stream against the same rules over a finished table: several files, late and repeated rows, restarts."""

from __future__ import annotations

import random
import uuid
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heddle.plans.streams import ON_DISK
from heddle.streaming import crawl, events

SCHEMA = "organisation_number string, page_kind string, final_url string, status string, links int, ts timestamp"
T0 = datetime(2024, 5, 1, tzinfo=UTC)


def log(seed):
    """Pages of 40 companies over six hours, out of order by at most half an hour, some repeated; pages of no seed, before the start, after the deadline."""
    r = random.Random(seed)
    rows = []
    for org in range(40):
        for k in range(r.choice([0, 1, 2, 5, 9])):
            at = T0 + timedelta(seconds=r.randint(-600, 4 * 3600))
            row = (f"o{org}", "homepage" if k == 0 else "priority", f"/{k}", r.choice(["available", "source_error"]), r.choice([None, 0, 1, 3, 8]), at)
            rows += [row] * r.choice([1, 1, 2])
            if r.random() < 0.3:
                rows.append((*row[:5], at + timedelta(seconds=r.randint(1, 1800))))
    rows += [("o1", "priority", None, "available", 0, T0 + timedelta(hours=1)), ("nobody", "homepage", "/0", "available", 0, T0 + timedelta(hours=1))]
    rows += [("end", "homepage", "/0", "available", 0, T0 + timedelta(hours=9))]
    return sorted(rows, key=lambda x: x[5] + timedelta(seconds=r.randint(0, 1800)))


@pytest.fixture
def seeds(spark):
    return spark.createDataFrame([(f"o{k}", T0, T0 + timedelta(hours=3)) for k in range(42)], "organisation_number string, started_at timestamp, deadline timestamp")


def streamed(spark, path, seeds, folder, **more):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return events.run_to_table(crawl.terminal_stream(rows, seeds, **more), folder, **ON_DISK)


@pytest.mark.parametrize(("seed", "files", "most_pages"), [(1, 1, 200), (2, 5, 200), (3, 6, 4)])
def test_a_company_ends_once_as_in_the_finished_table(spark, tmp_path, seeds, seed, files, most_pages):
    rows = log(seed)
    path = str(tmp_path / "log")
    step = -(-len(rows) // files)
    for at in range(0, len(rows), step):
        spark.createDataFrame(rows[at : at + step], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = sorted(map(tuple, streamed(spark, path, seeds, str(tmp_path / uuid.uuid4().hex), most_pages=most_pages).collect()))
    want = sorted(map(tuple, crawl.terminal_events(spark.read.parquet(path), seeds, most_pages=most_pages).collect()))
    assert got == want
    assert {x[1] for x in got} >= {"complete", "timeout", "synthetic"} and len(got) == 42


def test_a_stopped_stream_goes_on_and_late_rows_change_nothing(spark, tmp_path, seeds):
    rows, path, folder = log(4), str(tmp_path / "log"), str(tmp_path / "run")
    half = len(rows) // 2
    spark.createDataFrame(rows[:half], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    streamed(spark, path, seeds, folder)
    spark.createDataFrame(rows[half:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    first = sorted(map(tuple, streamed(spark, path, seeds, folder).collect()))
    assert first == sorted(map(tuple, crawl.terminal_events(spark.read.parquet(path), seeds).collect()))
    late = [("o3", "homepage", "/new", "source_error", 0, T0 + timedelta(minutes=1)), ("end", "homepage", "/1", "available", 0, T0 + timedelta(hours=12))]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert sorted(map(tuple, streamed(spark, path, seeds, folder).collect())) == first


def test_upsert_touches_only_buckets_of_its_keys(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "t")
    schema = "k long, v string, version long"
    for at, rows in enumerate([[(k, "a", 1) for k in range(100)], [(3, "b", 2), (5, "old", 0)], [(100, "c", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        frame = spark.readStream.schema(schema).parquet(path)
        got = {r.k: r.v for r in events.upsert_batches(frame, "k", "version", folder, buckets=8).collect()}
        want = {k: "a" for k in range(100)} | ({3: "b"} if at else {}) | ({100: "c"} if at == 2 else {})
        assert got == want
    log = spark.read.parquet(f"{folder}/generations").groupBy("batch").agg(F.count("*").alias("n")).collect()
    assert {r.batch: r.n for r in log}[1] <= 2 and {r.batch: r.n for r in log}[2] == 1


def test_companies_without_a_page_have_no_state_of_their_own(spark, tmp_path):
    """300 of 340 companies never have a page; deadlines differ within a bucket, and a page without an address is none."""
    path, folder = str(tmp_path / "log"), str(tmp_path / "run")
    rows = [*log(5), ("x7", "homepage", None, "available", 0, T0 + timedelta(minutes=5)), (None, "homepage", "/0", "available", 0, T0 + timedelta(hours=10))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    known = [(f"o{k}", T0, T0 + timedelta(hours=3 - k % 2)) for k in range(40)] + [(f"x{k}", T0, T0 + timedelta(hours=3 - k % 2)) for k in range(300)]
    seeds = spark.createDataFrame(known, "organisation_number string, started_at timestamp, deadline timestamp")
    seen = []

    def note(batch, number):
        seen.extend(map(tuple, batch.collect()))

    frame = crawl.terminal_stream(spark.readStream.schema(SCHEMA).parquet(path), seeds, buckets=4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(*next(iter(ON_DISK.items())))
    try:
        query = frame.writeStream.foreachBatch(note).option("checkpointLocation", folder).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(seen, key=str) == sorted(map(tuple, crawl.terminal_events(spark.read.parquet(path), seeds).collect()), key=str)
    assert sum(o["numRowsTotal"] for o in query.recentProgress[0]["stateOperators"]) < 300
