"""STR5, SNK2: work on a manifest in batches that a run which was stopped takes up again.

The folder of a run holds the manifest, cut into batches in its order, the rows of each batch, and a log to which a batch is appended once its
rows lie there and were checked. Before any work the log is read: it names the manifest and the parameters that the run was begun with, by a
hash; another input or another parameter is refused, and batches in the log are skipped. A batch that was stopped half way is written anew over what
it left, so a run ends with the same rows however often it was stopped. All files are read and written by Spark, in a folder that executors share.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

LOG = "kind string, guard string, batch long, rows long, digest string"


@dataclass(frozen=True)
class Check:
    """What a batch has to hold: aggregates that are observed while it is written, and what they must satisfy, by name."""

    measures: dict[str, Column]
    holds: Callable[[dict], dict[str, bool]]


class Refused(ValueError):
    """A run that belongs to another input, or a batch whose checks don't hold."""


def manifest_hash(manifest: DataFrame, key: str, position: str) -> str:
    """A hash of keys and their places that doesn't depend on how the rows are dealt to tasks."""
    one = F.xxhash64(F.col(position).cast("long"), F.col(key).cast("string")).cast("decimal(38,0)")
    n, total, squares = manifest.agg(F.count("*"), F.sum(one), F.sum(F.pmod(one * F.lit(31), F.lit(1_000_000_007)))).head()
    return hashlib.sha256(f"{n}:{total}:{squares}".encode()).hexdigest()


def batched(manifest: DataFrame, key: str, position: str, rows: int) -> DataFrame:
    """The manifest with ``batch``: places counted without gaps, ``rows`` to a batch.

    Places are counted in ranges: a row's rank in its range, and how many rows the ranges before it have. Ranges are of the position's own order.
    """
    spread = manifest.agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count("*").alias("n")).head()
    if not spread["n"]:
        return manifest.withColumn("batch", F.lit(0).cast("long"))
    width = max(1, -(-(spread["hi"] - spread["lo"] + 1) // max(1, -(-spread["n"] // 10_000))))
    ranged = manifest.withColumn("_range", F.floor((F.col(position) - F.lit(spread["lo"])) / F.lit(width)).cast("long"))
    # As many rows as there are ranges.
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_in")).withColumn("_start", F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")).drop("_in")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(position, key)) - 1 + F.col("_start")
    return ranged.join(F.broadcast(starts), "_range").withColumn("batch", F.floor(at / F.lit(rows)).cast("long")).drop("_range", "_start")


def _log(spark: SparkSession, folder: str) -> list:
    try:
        return spark.read.schema(LOG).parquet(f"{folder}/log").collect()
    except AnalysisException as nothing:
        if nothing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _append(spark: SparkSession, folder: str, *row) -> None:
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def run(manifest: DataFrame, work: Callable[[DataFrame, int], DataFrame], folder: str, *, key: str, position: str, rows: int, parameters: dict, check: Check | None = None, most_batches: int | None = None) -> dict:
    """Runs ``work`` on each batch of the manifest that the log doesn't have, in order, and tells how many were done and skipped.

    ``parameters`` are all that ``work`` depends on besides the manifest; they are hashed as JSON. ``most_batches`` stops a run early. The log has a row a
    batch; it is the only thing that is read by the driver.
    """
    spark = manifest.sparkSession
    guard = hashlib.sha256(json.dumps({"manifest": manifest_hash(manifest, key, position), "rows": rows, "parameters": parameters}, sort_keys=True).encode()).hexdigest()
    log = _log(spark, folder)
    begun = [r for r in log if r.kind == "begun"]
    if any(r.guard != guard for r in begun):
        raise Refused("the folder belongs to a run with another input or other parameters")
    if not begun:
        batched(manifest, key, position, rows).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/manifest")
        _append(spark, folder, "begun", guard, None, None, None)
    cut = spark.read.schema(f"{_ddl(manifest)}, batch long").parquet(f"{folder}/manifest")
    done = {r.batch for r in log if r.kind == "done"}
    batches = [r.batch for r in cut.select("batch").distinct().orderBy("batch").collect()]
    left = [b for b in batches if b not in done]
    for b in left[:most_batches]:
        told = Observation()
        digest = F.sum(F.xxhash64(*_hashable(out := work(cut.filter(F.col("batch") == b).drop("batch"), b))).cast("decimal(38,0)"))
        measures = {"rows": F.count(F.lit(1)), "digest": digest} | (check.measures if check else {})
        out.observe(told, *[v.alias(k) for k, v in measures.items()]).write.mode("overwrite").parquet(f"{folder}/rows/batch={b}")
        seen = told.get
        broken = [name for name, ok in (check.holds(seen | {"batch": b}) if check else {}).items() if not ok]
        if broken:
            raise Refused(f"batch {b}: {', '.join(broken)}")
        _append(spark, folder, "done", guard, b, seen["rows"], str(seen["digest"]))
    return {"batches": len(batches), "skipped": len(batches) - len(left), "done": len(left[:most_batches]), "complete": most_batches is None or len(left) <= most_batches}


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _hashable(rows: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed: maps as sorted entries."""
    return [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in rows.schema]


def committed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all batches in the log, with ``batch``; what a stopped batch left behind isn't among them."""
    done = spark.read.schema(LOG).parquet(f"{folder}/log").filter("kind = 'done'").select("batch").distinct()
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{ddl}, batch long").parquet(f"{folder}/rows").join(F.broadcast(done), "batch", "left_semi")


def report(spark: SparkSession, folder: str) -> DataFrame:
    """The log's batches: ``batch, rows, digest``."""
    return spark.read.schema(LOG).parquet(f"{folder}/log").filter("kind = 'done'").select("batch", "rows", "digest")
