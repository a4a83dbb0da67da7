"""What several corpus operators share: reading, durable cuts of lineage, word hashes, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space between words: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Words of a shingle wherever near duplicates are sought.
SHINGLE_WORDS = 5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that it may lie in any store."""
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
    """``df`` computed once and written to the shared folder, so that the copy outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As :func:`durable`, but as Parquet, of which later steps read only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/heddle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(side: DataFrame, most_rows: int = 100_000, bytes_of: Column | None = None, most_bytes: int = 8_000_000) -> DataFrame:
    """A written table (see :func:`durable`), marked for broadcast if it was counted to have at most ``most_rows`` rows,
    or, if rows vary in width, at most ``most_bytes`` by ``bytes_of``, the width of a row.

    Else Spark joins by shuffling, as it would without the count.
    """
    if bytes_of is not None:
        return F.broadcast(side) if (side.agg(F.sum(bytes_of)).head()[0] or 0) <= most_bytes else side
    return F.broadcast(side) if side.limit(most_rows + 1).count() <= most_rows else side


def packed(docs: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` as one column ``_all``, beside it the columns named, so that no other name can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"), *[docs[c].alias(n) for n, c in names.items()])


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that were packed, those in ``new`` replaced in their place or else added behind."""
    kept = [new[c].alias(c) if c in new else F.col("_all").getField(c).alias(c) for c in columns]
    return rows.select(*kept, *[v.alias(c) for c, v in new.items() if c not in columns])


def free_names(columns: list[str], wanted: list[str]) -> dict[str, str]:
    """For each column that is to be added the name it gets: its own, with an underscore behind as often as that is taken."""
    taken, out = {c.lower() for c in columns}, {}
    for name in wanted:
        free = name
        while free.lower() in taken:
            free += "_"
        out[name] = free
        taken.add(free.lower())
    return out


def word_array(text: Column) -> Column:
    """All words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def window_hashes(hashes: str, size: int = SHINGLE_WORDS) -> Column:
    """A 64-bit hash of every window of ``size`` words, from the column of word hashes named."""
    h = F.col(hashes)
    return F.when(
        F.size(h) >= size,
        F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))


def gapless_rank(df: DataFrame, group: str, order: list[str], rank: str, rows_per_run: int = 10_000) -> DataFrame:
    """Adds ``rank``: 0, 1, 2 ... within each group, in no task more than about ``rows_per_run`` rows.

    Rows of a group are dealt by hash into runs; a run is ranked by one window, and the runs' sizes, summed
    up before, give where each run begins. The number of runs follows the number of rows, so a group that
    holds a third of them is spread like any other. Ties in ``order`` are rows alike in those columns.
    """
    total = df.count()
    runs = max(1, -(-total // rows_per_run))
    run = F.pmod(F.xxhash64(*order), F.lit(runs)).alias("_hd_run")
    dealt = df.withColumn("_hd_run", run)
    before = Window.partitionBy(group).orderBy("_hd_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "_hd_run").agg(F.count("*").alias("_hd_n"))
        .withColumn("_hd_start", F.coalesce(F.sum("_hd_n").over(before), F.lit(0)))
        .select(F.col(group).alias("_hd_g"), F.col("_hd_run").alias("_hd_r"), "_hd_start")
    )
    inside = Window.partitionBy(group, "_hd_run").orderBy(*order)
    ranked = dealt.withColumn("_hd_k", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_hd_g")) & (F.col("_hd_run") == F.col("_hd_r")), "left")
    return joined.withColumn(rank, (F.col("_hd_start") + F.col("_hd_k")).cast("bigint")).drop("_hd_g", "_hd_r", "_hd_start", "_hd_k", "_hd_run")
