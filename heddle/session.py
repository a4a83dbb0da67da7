"""The one place where session settings are chosen."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, name: str = "heddle", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of the input folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see. Where it is unset, as in tests, one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="heddle-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that what is made of it several times isn't computed again, and the copy outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for the right of a join whose sides both grow with the companies. Spark guesses sizes by the files read and not by what is made of their rows, so it would send pages made of
    short rows whole through the driver to every task."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all tasks by ``keys``, for work that costs much a row. A table may be a file of one row group, which one task reads, and nothing before the work moves its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a session, so that they import it from wherever the driver was started."""
    sent = spark.conf.get("spark.heddle.shipped", None)
    if sent == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="heddle-"), "heddle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("heddle", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    spark.conf.set("spark.heddle.shipped", spark.sparkContext.applicationId)
