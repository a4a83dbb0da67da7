"""Keyed joins, keep-first and keep-last, hash-rank samples, percentiles, budgets and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchor(manifest: DataFrame, bulk: DataFrame, key: str, position: str, order: str | None = None) -> DataFrame:
    """JN1: every manifest row once, in manifest order, with its bulk row if there is one; ``status`` tells which. Of a repeated bulk key
    the row with the last ``order`` counts, or the largest row where there is none."""
    whole = F.struct(*[c for c in bulk.columns if c != key])
    last = bulk.groupBy(key).agg(F.max_by(whole, F.col(order)) if order else F.max(whole)).toDF(key, "_bulk")
    found = last.select(key, "_bulk.*", F.lit(True).alias("_found"))
    return manifest.join(found, key, "left").withColumn("status", F.when(F.col("_found"), "available").otherwise("not_available")).drop("_found").orderBy(position)


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN1: of each key the last row in ``order``, which has to be total."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN2: of each key the first row in ``order``, which has to be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """JN6: rows whose key isn't among the others."""
    return rows.join(others.select(key), key, "left_anti")


def audited(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """JN5: rows whose key is among the others."""
    return rows.join(others.select(key), key, "left_semi")


def hash_rank(key: Column, seed: str) -> Column:
    """SMP2: the rank of a key under a seed, as lower-case hex, which sorts like the number."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """SMP2, SMP6: the ``n`` rows that rank lowest."""
    return rows.withColumn("hash_rank", hash_rank(F.col(key), seed)).orderBy("hash_rank", key).limit(n)


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """SMP1: the ``n`` rows of each stratum that rank lowest; re-specified so that input order doesn't matter."""
    ranked = rows.withColumn("hash_rank", hash_rank(F.col(key), seed))
    w = Window.partitionBy(*strata).orderBy("hash_rank", key)
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def largest_remainders(weights: DataFrame, key: str, weight: str, total: Column, cap: str | None = None) -> DataFrame:
    """``weights`` (a row a stratum) with ``quota``: a total shared out in proportion to the weights, what rounding down leaves to the largest remainders, then by
    key. With ``cap`` no quota is above that column, and what it cuts off is lost."""
    whole = F.sum(weight).over(Window.partitionBy())
    share = F.col(weight) * total / F.when(whole > 0, whole)
    rows = weights.withColumn("_share", F.coalesce(share, F.lit(0.0))).withColumn("_low", F.floor("_share").cast("long"))
    left = total - F.sum("_low").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_low")), key))
    quota = F.col("_low") + F.when((place <= left) & (F.col(weight) > 0), 1).otherwise(0)
    return rows.withColumn("quota", (F.least(quota, F.col(cap)) if cap else quota).cast("long")).drop("_share", "_low")


def population_and_stress(rows: DataFrame, stratum: str, key: str, count: int, seed: str, population: float = 0.7) -> DataFrame:
    """SMP1: ``count`` rows, most of them in proportion to their strata, and the rest such that small strata are there too: with ``sample_slice``, ``population`` or
    ``stress``, and ``place``, the rank in the stratum.

    Quotas come from the counted strata: the population by largest remainders; then one to three rows of each stratum, as far as the
    rest reaches, by name of the stratum; then what is still missing in proportion to what the strata have left. Rows are ranked in their stratum by
    hash, and no task sends more of a stratum than the largest quota, so no stratum is sorted whole and none is sorted with others.
    """
    c = F.col
    strata = rows.groupBy(c(stratum).alias("_stratum")).agg(F.count("*").alias("_have"))
    total = F.sum("_have").over(Window.partitionBy())
    most = round(count * population)
    first = largest_remainders(strata.withColumn("_all", total), "_stratum", "_have", F.least(F.lit(most), c("_all"))).withColumnRenamed("quota", "_population")
    n = F.count("*").over(Window.partitionBy())
    least = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.lit(count - most) / n)))
    floor = first.withColumn("_floor", F.least(least, c("_have") - c("_population")))
    before = F.coalesce(F.sum("_floor").over(Window.orderBy("_stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(count) - F.sum("_population").over(Window.partitionBy())
    floor = floor.withColumn("_floor", F.greatest(F.lit(0), F.least(c("_floor"), room - before)).cast("long"))
    rest = floor.withColumn("_left", c("_have") - c("_population") - c("_floor")).withColumn("_missing", room - F.sum("_floor").over(Window.partitionBy()))
    rest = rest.withColumn("_missing", F.least(c("_missing"), F.sum("_left").over(Window.partitionBy())))
    quotas = largest_remainders(rest, "_stratum", "_left", c("_missing")).select("_stratum", "_population", (c("_population") + c("_floor") + c("quota")).alias("_quota"))
    largest = quotas.agg(F.max("_quota")).head()[0] or 0
    ranked = rows.withColumn("hash_rank", hash_rank(c(key), seed))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("hash_rank", key))).filter(c("place") <= F.lit(largest))
    chosen = ranked.join(quotas, c(stratum).eqNullSafe(c("_stratum"))).filter("place <= _quota")
    return chosen.withColumn("sample_slice", F.when(c("place") <= c("_population"), "population").otherwise("stress")).drop("_stratum", "_population", "_quota")


def split(rows: DataFrame, key: str, seed: str, digits: int = 4) -> DataFrame:
    """WIN5: development, validation and held-out by rank, at 60, 20 and 20 %, rounded half to even.

    Ranks are counted in runs of the hash's first ``digits``; of these there are at most ``16 ** digits``, whose starts are broadcast.
    """
    hashed = rows.withColumn("_hash", hash_rank(F.col(key), seed)).withColumn("_run", F.substring("_hash", 1, digits))
    runs = hashed.groupBy("_run").agg(F.count("*").alias("_in"))
    w = Window.orderBy("_run")
    starts = runs.select("_run", (F.sum("_in").over(w) - F.col("_in")).alias("_start"), F.sum("_in").over(Window.partitionBy()).alias("_n"))
    at = F.row_number().over(Window.partitionBy("_run").orderBy("_hash", key)) + F.col("_start")
    dev, val = F.bround(F.col("_n") * 0.6), F.bround(F.col("_n") * 0.2)
    named = F.when(at <= dev, "development").when(at <= dev + val, "validation").otherwise("held_out")
    return hashed.join(F.broadcast(starts), "_run").withColumn("split", named).drop("_hash", "_run", "_start", "_n")


def nearest_rank(column: str, q: float) -> Column:
    """AGG5: the ``ceil(q n)``-th smallest value."""
    return F.expr(f"percentile_disc({q}) within group (order by {column})")


def coarse(value: Column, runs: int = 1024) -> Column:
    """A number rounded to so many steps between powers of two (a power of two itself), which keeps order: a smaller number never gets a larger one.

    The number is split at a bit by a product that rounds, so this is arithmetic alone; what is too large for the product stands for itself.
    """
    x = value.cast("double")
    high = x * F.lit(float(2 ** (53 - runs.bit_length()) + 1))
    return F.when(F.abs(x) < 1e280, high - (high - x)).otherwise(x)


def values_at(rows: DataFrame, column: str, at: dict[str, str], by: str | None = None, runs: int = 1024, summary: bool = False) -> DataFrame:
    """AGG5-AGG7: the values at zero-based places of the sorted ones, given as SQL over ``n``, the number of rows that aren't null; for
    each ``by``, if given, and with ``summary`` beside ``n`` and ``top``, the largest. A group without values, or an empty table with ``by``, gives no row.

    Rows are read twice. First they are counted by their value rounded to ``runs`` steps between powers of two, which tells the step that
    each place falls into; then only the values of those steps are counted one by one.
    """
    group = F.col(by) if by else F.lit(0)
    there = rows.filter(F.col(column).isNotNull()).select(group.alias("_g"), F.col(column).alias("_v")).withColumn("_s", coarse(F.col("_v"), runs))
    w = Window.partitionBy("_g")
    steps = there.groupBy("_g", "_s").agg(F.count("*").alias("_in"), F.max("_v").alias("_most"))
    steps = steps.withColumns({"n": F.sum("_in").over(w), "top": F.max("_most").over(w), "_upto": F.sum("_in").over(w.orderBy("_s"))})
    places = {name: F.expr(place) for name, place in at.items()}
    has = [(F.col("_upto") > p) & (F.col("_upto") - F.col("_in") <= p) for p in places.values()]
    wanted = steps.filter(F.greatest(*has, F.lit(False))).select(F.col("_g").alias("_h"), F.col("_s").alias("_t"), "n", "top", (F.col("_upto") - F.col("_in")).alias("_before"))
    here = F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_s") == F.col("_t"))
    each = there.join(wanted, here).groupBy("_g", "_s", "_v", "n", "top", "_before").agg(F.count("*").alias("_c"))
    last = F.sum("_c").over(Window.partitionBy("_g", "_s").orderBy("_v")) + F.col("_before")
    found = each.withColumn("_last", last)
    at_place = lambda p: (F.col("_last") > p) & (F.col("_last") - F.col("_c") <= p)
    picked = [F.max(F.when(at_place(p), F.col("_v"))).alias(name) for name, p in places.items()]
    picked += [F.max(x).alias(x) for x in ("n", "top") if summary]
    return found.groupBy(F.col("_g").alias(by)).agg(*picked) if by else found.agg(*picked)


def admitted(rows: DataFrame, order: list[str], cost: str, soft: float, hard: float, high: Column) -> DataFrame:
    """FLT19, WIN6: whether each request is made, by what the made ones before it cost: up to ``hard``, others than high priority
    up to ``soft``. What is refused costs nothing.

    Until ``soft`` is reached all are made, from then on those of high priority until ``hard``; so running sums over
    all, and over the later ones of high priority, tell what a step by step account would.
    """
    by = Window.partitionBy("budget").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(by), F.lit(0))
    out = rows.withColumn("_early", before(F.col(cost)) < soft)
    out = out.withColumn("_asked", F.when(F.col("_early") | high, F.col(cost)).otherwise(0))
    out = out.withColumn("admitted", F.col("_early") | high & (before(F.col("_asked")) < hard))
    return out.withColumn("used_before", before(F.when(F.col("admitted"), F.col(cost)).otherwise(0))).drop("_early", "_asked")


def spaced(rows: DataFrame, group: str, time: Column, order: list[str], gap: Column | float) -> DataFrame:
    """WIN7: starts at least ``gap`` apart: ``start(i) = max(t(i), start(i-1) + gap)``, as a running maximum."""
    w = Window.partitionBy(group).orderBy(*order)
    i = F.row_number().over(w)
    gap = F.lit(gap) if not isinstance(gap, Column) else gap
    lead = rows.withColumn("_i", i).withColumn("_lead", time - gap * F.col("_i"))
    return lead.withColumn("start", F.max("_lead").over(w.rowsBetween(Window.unboundedPreceding, 0)) + gap * F.col("_i")).drop("_i", "_lead")
