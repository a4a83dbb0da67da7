"""§2.13: an append-only event log as a stream: duplicates suppressed, latest state kept, windows counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, sf_dir: str, files_at_once: int = 1) -> DataFrame:
    """The events table as a file stream; Parquet's own timestamp type is made a session one for the watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # The file source lists folders; a glob makes one of a single file.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, within the time that events may be late, so state stays bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their sum for each window and type; a window ends when the watermark has passed it."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_table(frame: DataFrame, folder: str, mode: str = "append", **settings: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet below ``folder``, and returns what it wrote: all rows in ``append`` mode, else those of the last batch.

    ``settings`` hold for the session while the stream runs.
    """
    spark = frame.sparkSession
    out = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", f"{folder}/rows")
    else:
        out = out.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/v{number}"))
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = out.start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows" if mode == "append" else f"{folder}/rows/v{last}")


def upsert_batches(frame: DataFrame, key: str, version: str, folder: str, buckets: int = 64) -> DataFrame:
    """SNK3 as a stream: the latest row of each key, in a table of hash buckets. A batch reads and writes the buckets that its keys fall into, and no others.

    A batch writes its buckets as a generation of its own and then, in one commit, notes them in a log; a batch that is run again writes the
    same generation. Readers take each bucket's last generation.
    """
    from heddle.sources.readers import upsert

    spark = frame.sparkSession
    noted = "bucket int, batch long"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def current(of: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        log = spark.read.schema(noted).parquet(f"{folder}/generations")
        if before is not None:
            log = log.filter(F.col("batch") < before)
        # A row a bucket, so at most ``buckets``.
        last = {b: n for b, n in log.groupBy("bucket").agg(F.max("batch")).collect() if of is None or b in of}
        paths = [f"{folder}/rows/batch={n}/bucket={b}" for b, n in sorted(last.items())]
        return spark.read.schema(frame.schema).parquet(*paths) if paths else None

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = [b for (b,) in batch.select(bucket.alias("b")).distinct().collect()]
        if touched:
            there = current(touched, number)
            new = upsert(batch.limit(0) if there is None else there, batch, key, version).withColumn("bucket", bucket)
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/batch={number}")
            spark.createDataFrame([(b, number) for b in touched], noted).coalesce(1).write.mode("append").parquet(f"{folder}/generations")
        batch.unpersist()

    spark.createDataFrame([], noted).write.mode("append").parquet(f"{folder}/generations")
    query = frame.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    found = current()
    return frame.sparkSession.createDataFrame([], frame.schema) if found is None else found
