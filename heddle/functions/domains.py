"""SCA17: registered domains by a list of public suffixes, with its wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public suffixes where nothing else is given (fixed values): ``*.x`` makes each name below x a suffix, ``!y.x`` is one that isn't.
RULES = [
    "com", "net", "org", "info", "biz", "edu", "gov", "int", "eu", "io", "app", "dev", "ai", "co", "me", "tv",
    "no", "co.no", "priv.no", "kommune.no", "fylkesbibl.no", "gs.oslo.no", "vgs.no", "stat.no", "dep.no", "mil.no", "museum.no", "folkebibl.no", "herad.no",
    "se", "dk", "fi", "is", "de", "fr", "es", "it", "nl", "pl", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "us", "ca", "jp", "co.jp",
    "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "*.er", "github.io", "blogspot.com", "wordpress.com", "azurewebsites.net",
]


def rules(spark, suffixes: list[str] = RULES) -> DataFrame:
    """Rules as rows ``base, kind``: the labels that a host must end with, and what follows from it."""
    kind = lambda r: ("wildcard", r[2:]) if r.startswith("*.") else ("exception", r[1:]) if r.startswith("!") else ("plain", r)
    return spark.createDataFrame([(base, k) for k, base in map(kind, suffixes)], "base string, kind string")


def with_domain(rows: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Adds ``public_suffix`` and ``registered_domain`` of the hosts in a column; null for addresses, blanks and names that are a suffix themselves.

    Each different host is cut at its labels once, and the pieces meet the rules by equality, so the list may be of any length. Of the rules
    that match, an exception counts before all others, then the longest; a host that none matches has its last label as suffix.
    """
    clean = F.regexp_replace(F.lower(F.trim(F.col(host))), r"\.$", "")
    named = clean.rlike(r"^[^.\s:/@]+(\.[^.\s:/@]+)*$") & ~clean.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    hosts = rows.select(F.col(host).alias("_host"), F.when(named, F.split(clean, r"\.")).alias("_labels")).filter("_labels is not null").distinct()
    last = lambda n: F.array_join(F.slice("_labels", F.size("_labels") - n + 1, n), ".")
    pieces = hosts.select("_host", "_labels", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_n")).withColumn("base", last(F.col("_n")))
    n, size = F.col("_n"), F.size("_labels")
    length = F.when(F.col("kind") == "plain", n).when((F.col("kind") == "wildcard") & (n < size), n + 1)
    found = pieces.join(suffixes, "base", "left").groupBy("_host", "_labels").agg(F.max(F.when(F.col("kind") == "exception", n - 1)).alias("_except"), F.max(length).alias("_best"))
    found = found.withColumn("_n", F.coalesce("_except", "_best", F.lit(1)))
    told = found.select("_host", last(F.col("_n")).alias("public_suffix"), F.when(F.col("_n") < F.size("_labels"), last(F.col("_n") + 1)).alias("registered_domain"))
    return rows.join(told, F.col(host) == F.col("_host"), "left").drop("_host")
