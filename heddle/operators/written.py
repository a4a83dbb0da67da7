"""FLT14: whether written tables hold the same keys in the same order, and whether their numbers are finite, at any depth.

Spark doesn't keep an order between the files that it reads, but files have an order and rows have places in them. So a row's place in a table is the number
of rows in the files before its own, and its index in that; rows are numbered where they lie, nothing is sorted, and no task sees more than a
file's part. Two tables are then compared by a join on places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def placed(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``key, place`` of a Parquet table in the order in which it was written: by the number in its file's name, then by row."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path).select(F.col(key), part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_part", "_file").agg(F.count("*").alias("_n"))
    # As many rows as there are files.
    starts = files.withColumn("_start", F.sum("_n").over(Window.orderBy("_part", "_file")) - F.col("_n")).select("_file", "_start")
    return rows.join(F.broadcast(starts), "_file").select(key, (F.col("_start") + F.col("_at")).alias("place"))


def order_faults(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys at which two placed tables differ: ``missing`` or ``unexpected`` ones, ``repeated`` ones, and those that are ``moved``, with their first places.

    Rows behind a missing or repeated one have moved with it; what is told as moved is out of order against its neighbours: its place isn't
    the expected one even when places are counted among the keys that both tables have once.
    """
    of = lambda rows, p: rows.groupBy(key).agg(F.min("place").alias(f"{p}_place"), F.count("*").alias(f"{p}_n"))
    both = of(expected, "expected").join(of(found, "found"), key, "full")
    c = F.col
    shared = both.filter("expected_n = 1 and found_n = 1").select(key, "expected_place", "found_place")
    # Two orders are the same if each key's next key is the same in both: neighbours by rank, counted in ranges.
    ranked = _dense(_dense(shared, "expected_place", "expected_rank"), "found_place", "found_rank")
    moved = ranked.filter("expected_rank <> found_rank").select(key, F.lit(True).alias("_moved"))
    kind = F.when(c("found_n").isNull(), "missing").when(c("expected_n").isNull(), "unexpected").when((c("found_n") > 1) | (c("expected_n") > 1), "repeated").when(c("_moved"), "moved")
    return both.join(moved, key, "left").withColumn("fault", kind).filter("fault is not null").select(key, "fault", "expected_place", "found_place")


def _dense(rows: DataFrame, place: str, rank: str, width: int = 10_000) -> DataFrame:
    """Ranks without gaps of different places, counted in ranges of ``width`` places; the starts are as many rows as there are ranges."""
    ranged = rows.withColumn("_range", F.floor(F.col(place) / width))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_in")).withColumn("_start", F.sum("_in").over(Window.orderBy("_range")) - F.col("_in")).drop("_in")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(place)) + F.col("_start")
    return ranged.join(F.broadcast(starts), "_range").withColumn(rank, at).drop("_range", "_start")


def first_mismatches(expected: DataFrame, found: DataFrame, key: str, width: int = 10_000) -> DataFrame:
    """Of each range of ``width`` places the first at which the tables differ: ``range_start, place, expected, found``; none if they are equal."""
    at = lambda rows, name: rows.select("place", F.col(key).alias(name))
    both = at(expected, "expected").join(at(found, "found"), "place", "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
    start = (F.floor(F.col("place") / width) * width).cast("long")
    return both.groupBy(start.alias("range_start")).agg(F.min(F.struct("place", "expected", "found")).alias("x")).select("range_start", "x.*")


def same_order(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: whether places and keys are all equal, and how many rows each table has."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    return first_mismatches(expected, found, key).agg((F.count("*") == 0).alias("same")).join(count(expected, "expected_rows")).join(count(found, "found_rows"))


def not_finite_paths(schema: StructType) -> Column:
    """SCA42: the paths of a row's values that are NaN or infinite, through structs, arrays and maps: ``a.b[2].c``."""

    def walk(kind: DataType, value: Column, path: Column) -> Column | None:
        if isinstance(kind, (DoubleType, FloatType)):
            bad = F.isnan(value) | (F.abs(value) == float("inf"))
            return F.when(bad, F.array(path)).otherwise(none())
        if isinstance(kind, StructType):
            parts = [x for f in kind if (x := walk(f.dataType, value[f.name], F.concat(path, F.lit(f".{f.name}")))) is not None]
            return F.concat(*[F.coalesce(x, none()) for x in parts]) if parts else None
        if isinstance(kind, ArrayType) and _has_float(kind):
            each = lambda x, i: walk(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
            return F.flatten(F.transform(value, each))
        if isinstance(kind, MapType) and _has_float(kind.valueType):
            each = lambda e: walk(kind.valueType, e["value"], F.concat(path, F.lit("."), e["key"].cast("string")))
            return F.flatten(F.transform(F.map_entries(value), each))
        return None

    none = lambda: F.array().cast("array<string>")
    found = [x for f in schema if (x := walk(f.dataType, F.col(f"`{f.name}`"), F.lit(f.name))) is not None]
    return F.concat(none(), *[F.coalesce(x, none()) for x in found])


def _has_float(kind: DataType) -> bool:
    inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType if isinstance(kind, MapType) else None
    if isinstance(kind, StructType):
        return any(_has_float(f.dataType) for f in kind)
    return isinstance(kind, (DoubleType, FloatType)) or inner is not None and _has_float(inner)


def contract_faults() -> dict[str, Column]:
    """FLT14 on one envelope of ``claims`` (``availability, value, evidence_ids``) and ``evidence`` (``id, source_url, retrieved_at, content_sha256``): the rules
    of a package that its writer's own validator doesn't have, each true where it is broken."""
    blank = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
    known = F.transform("evidence", lambda e: e["id"])
    return {
        "missing converted to zero": F.exists("claims", lambda c: (c["availability"] != "available") & F.coalesce(c["value"].try_cast("double") == 0, F.lit(False))),
        "available claim without evidence": F.exists("claims", lambda c: (c["availability"] == "available") & (F.coalesce(F.size(c["evidence_ids"]), F.lit(0)) == 0)),
        "unknown evidence": F.exists("claims", lambda c: F.size(F.array_except(F.coalesce(c["evidence_ids"], F.array().cast("array<string>")), known)) > 0),
        "evidence without mandatory fields": F.exists("evidence", lambda e: blank(e["id"]) | blank(e["source_url"]) | blank(e["retrieved_at"]) | blank(e["content_sha256"])),
    }
