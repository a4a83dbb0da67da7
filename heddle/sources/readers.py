"""SRC1-SRC8, SNK1-SNK3: registers, manifests, captured responses; atomic and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers of register files and the names they get (fixed values); the first that is there and not blank counts.
HEADERS = {
    "organisation_number": ["organisasjonsnummer", "organisation_number", "orgnr"], "name": ["navn", "name"], "legal_form": ["organisasjonsform.kode", "legal_form"],
    "employees": ["antallAnsatte", "employees"], "municipality": ["forretningsadresse.kommune", "municipality"], "website": ["hjemmeside", "website"],
    "latest_submitted_accounts": ["sisteInnsendteAarsregnskap", "latest_submitted_accounts"], "bankrupt": ["konkurs", "bankrupt"], "liquidating": ["underAvvikling", "liquidating"],
}


def delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the first line of a text file has most of."""
    line = spark.read.text(path).limit(1).head()
    return max(";,\t", key=(line[0] if line else "").count)


def bulk(spark: SparkSession, path: str) -> DataFrame:
    """SRC1, SRC2: a register as JSON lines or delimited text, gzipped or not, in one set of columns.

    Only rows with nine-digit keys; a count that is no number is null, not 0; truth is the word ``true``.
    """
    if ".json" in path:
        raw = spark.read.json(path)
    else:
        raw = spark.read.csv(path, header=True, sep=delimiter(spark, path), encoding="UTF-8")
        raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    there = set(raw.columns)
    out = {}
    for name, options in HEADERS.items():
        some = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in options if c in there]
        out[name] = F.coalesce(*some, F.lit(None)) if some else F.lit(None).cast("string")
    out["employees"] = out["employees"].try_cast("int")
    for flag in ("bankrupt", "liquidating"):
        out[flag] = F.lower(F.coalesce(out[flag], F.lit(""))) == "true"
    return raw.select(*[v.alias(k) for k, v in out.items()]).filter(F.length("organisation_number") == 9)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC3, SRC4: keys in file order with ``evaluation_split`` and ``sample_slice`` where they are told: from a text file with one key a line, from JSON lines, or from one JSON
    value, a list or an object with the list ``organisation_numbers``; entries are keys or objects. Fails on a key that hasn't nine digits and on a
    repeated one."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.organisation_numbers", "array<variant>"), F.array().cast("array<variant>"))
        entries = whole.select(F.posexplode(listed).alias("position", "v"))
    else:
        lines = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("position"), "value")
        # A line that is no JSON is the key itself.
        entries = lines.select("position", F.parse_json("value").alias("v")) if ".jsonl" in path else lines.select("position", F.to_variant_object(F.struct(F.col("value").alias("organisation_number"))).alias("v"))
    told = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    digits = F.regexp_replace(F.coalesce(told("organisation_number"), F.when(F.try_variant_get("v", "$", "map<string,variant>").isNull(), F.try_variant_get("v", "$", "string")), F.lit("")), r"\D", "")
    rows = entries.select(digits.alias("organisation_number"), F.col("position").cast("long").alias("position"), told("evaluation_split").alias("evaluation_split"), told("sample_slice").alias("sample_slice"))
    bad = F.assert_true(F.length("organisation_number") == 9, F.concat(F.lit("not a nine-digit key: "), F.col("organisation_number")))
    rows = rows.filter(bad.isNull())
    twice = rows.groupBy("organisation_number").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key: {twice[0][0]}")
    return rows


def responses(requests: DataFrame, captured: DataFrame) -> DataFrame:
    """SRC8: requests with what was captured for their url: a missing one has status 0; the body's hash goes along."""
    joined = requests.join(captured.select("url", F.col("status").alias("_s"), "body"), "url", "left")
    return joined.withColumns({"status": F.coalesce("_s", F.lit(0)), "content_sha256": F.sha2(F.coalesce("body", F.lit("")), 256)}).drop("_s")


def classified(status: Column) -> Column:
    """PRJ18: what a response says about its fact."""
    return F.when(status == 200, "available").when(status.isin(404, 410), "not_found").otherwise("source_error")


def write_lines(rows: DataFrame, path: str) -> None:
    """SNK1: JSON lines; the committer makes the folder appear whole or not at all."""
    rows.write.mode("overwrite").json(path)


def upsert(table: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """SNK3: the table with new rows put in; of a key the highest version stays."""
    both = table.unionByName(new)
    cols = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("_b"))
    return best.select(key, "_b.*")
