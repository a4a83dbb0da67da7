"""Quality rules whose thresholds come from the corpus itself, for each language and source.

Two passes, both only DataFrame functions. The first measures every document and adds its figures to
quantile sketches: a figure falls into a bucket that keeps its six leading bits, and a sketch is the count
of each bucket, so sketches merge by addition, give the same thresholds in any order, and stay within
``64 + 32 * 58`` counters a group and figure. The second joins every document with its group's thresholds.

Defined results: a null or empty text has no words and fails the base rule; nulls in ``lang`` or ``source``
form a group of their own; repeated rows are judged one by one; an empty table gives an empty result;
other columns are ignored by :func:`judge` and kept as they are by :func:`keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import SHINGLE_WORDS, durable, packed, small_or_shuffled, unpacked, window_hashes, word_array

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Figures that the sketches hold, each an integer.
FIGURES = ("symbols_per_mille", "dup_lines_per_mille", "repeats_per_mille", "word_length_cent")
LEADING_BITS = 6


@dataclass(frozen=True)
class Rules:
    """``margins``: for each figure at least how much a document may lie beyond the outer quartiles of its group, below
    (None: no lower fence) and above; ``spread``: how many interquartile ranges. Where a group's quartiles are close, the
    margin alone decides, as a fixed distance from them. That of repeats is half of what the base rule allows."""

    least_words: int = 10
    most_repeated_percent: int = 20
    lower_quantile: float = 0.25
    upper_quantile: float = 0.75
    spread: int = 4
    margins: tuple[tuple[str, int | None, int], ...] = (
        ("symbols_per_mille", None, 100),
        ("dup_lines_per_mille", None, 300),
        ("repeats_per_mille", None, 100),
        ("word_length_cent", 250, 600),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` and the integer figures of the sketches, in a struct ``_m``, and ``_once``, a number."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.withColumns({"_words": word_array(F.col(text)), "_lines": lines})
    b = a.withColumns({"_h": F.transform("_words", lambda w: F.xxhash64(w)), "_chars": F.length(F.array_join("_words", "")), "_n_lines": F.size("_lines"), "_n_kinds": F.size(F.array_distinct("_lines"))}).drop("_words", "_lines")
    c = b.withColumns({"_n": F.size("_h"), "_win": window_hashes("_h")}).drop("_h")
    w, at = F.col("_win"), F.col("_at")
    twice = F.size(F.array_distinct(w)) < F.size(w)
    d = c.withColumn("_sorted", F.when(twice, F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_win")
    s = F.col("_sorted")
    alike = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
    e = d.withColumn("_at", F.sort_array(F.transform(F.filter(s, alike), lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.lit(SHINGLE_WORDS), F.coalesce(F.get(at, k + 1) - p, F.lit(SHINGLE_WORDS)))), F.lit(0), lambda x, y: x + y
    )
    n = F.col("_n").cast("bigint")
    per = lambda x, y, scale: F.expr(f"({scale} * cast({x} as bigint)) div greatest({y}, 1)")
    f = e.select(
        *docs.columns,
        n.alias("_n_words"),
        F.col("_chars").cast("bigint").alias("_word_chars"),
        F.when(t.rlike(f"[{SYMBOLS}]"), F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0).cast("bigint").alias("_n_symbols"),
        (F.col("_n_lines") - F.col("_n_kinds")).cast("bigint").alias("_n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("_n_repeat_words"),
        "_n_lines",
    )
    return f.select(
        *docs.columns,
        # Keeps Spark from moving filters on the figures below the steps that compute them, which would repeat all of them.
        F.monotonically_increasing_id().alias("_once"),
        F.struct(
            F.col("_n_words").alias("n_words"),
            F.col("_word_chars").alias("word_chars"),
            F.col("_n_symbols").alias("n_symbols"),
            F.col("_n_dup_lines").alias("n_dup_lines"),
            F.col("_n_repeat_words").alias("n_repeat_words"),
            per("_n_symbols", "_n_words", 1000).alias("symbols_per_mille"),
            per("_n_dup_lines", "_n_lines", 1000).alias("dup_lines_per_mille"),
            per("_n_repeat_words", "_n_words", 1000).alias("repeats_per_mille"),
            per("_word_chars", "_n_words", 100).alias("word_length_cent"),
        ).alias("_m"),
    )


def base_failed(rules: Rules) -> Column:
    m = F.col("_m")
    return (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.most_repeated_percent * m["n_words"])


def bucket_floor(value: Column) -> Column:
    """The lower end of the bucket of a non-negative integer: its leading bits, the others zero."""
    low = F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(figures: DataFrame, rules: Rules, lang: str, source: str) -> DataFrame:
    """Rows of ``_lang, _source, figure, bucket, count``: one mergeable sketch for each group and figure.

    Documents that fail the base rule don't shape the thresholds.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), bucket_floor(F.col("_m")[f]).alias("bucket")) for f in FIGURES]))
    return (
        figures.filter((F.col("_once") >= 0) & ~base_failed(rules)).select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), each.alias("x"))
        .groupBy("_lang", "_source", "x.figure", "x.bucket").agg(F.count("*").alias("count"))
    )


def merge(*parts: DataFrame) -> DataFrame:
    """Sketches of several corpora as those of their union."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("_lang", "_source", "figure", "bucket").agg(F.sum("count").alias("count"))


def thresholds(sketch: DataFrame, rules: Rules) -> DataFrame:
    """One row a group: ``<figure>_low`` and ``<figure>_high`` for every figure."""
    by = Window.partitionBy("_lang", "_source", "figure")
    up = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"_below": F.sum("count").over(up), "_all": F.sum("count").over(by)})
    at = lambda q: F.min(F.when(F.col("_below") >= F.ceil(F.col("_all") * F.lit(q)), F.col("bucket")))
    q = ranked.groupBy("_lang", "_source", "figure").agg(at(rules.lower_quantile).alias("lo"), at(rules.upper_quantile).alias("hi"))
    aggs = []
    for figure, below, above in rules.margins:
        reach = lambda margin: F.greatest(F.lit(rules.spread) * (F.col("hi") - F.col("lo")), F.lit(margin))
        low = F.lit(-1).cast("bigint") if below is None else F.col("lo") - reach(below)
        aggs += [F.max(F.when(F.col("figure") == figure, low)).alias(f"{figure}_low"), F.max(F.when(F.col("figure") == figure, F.col("hi") + reach(above))).alias(f"{figure}_high")]
    return q.groupBy("_lang", "_source").agg(*aggs)


def _verdict(figures: DataFrame, limits: DataFrame, rules: Rules, lang: str, source: str) -> DataFrame:
    right = limits.select(*[F.col(c).alias(f"_t_{c}") for c in limits.columns])
    joined = figures.join(right, F.col(lang).eqNullSafe(F.col("_t__lang")) & F.col(source).eqNullSafe(F.col("_t__source")), "left")
    inside = F.lit(True)
    for f in FIGURES:
        inside = inside & F.col("_m")[f].between(F.col(f"_t_{f}_low"), F.col(f"_t_{f}_high"))
    bad = base_failed(rules)
    out = joined.withColumns({"_base_failed": bad, "_kept": (F.col("_once") >= 0) & ~bad & F.coalesce(inside, F.lit(False))})
    return out.drop(*right.columns)


def judge(docs: DataFrame, rules: Rules = Rules(), *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """For every row: the key, the measured counts, ``base_failed`` and ``kept``."""
    figures = durable(measured(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_l"), F.col(source).alias("_s")), "_text").drop("_text"))
    judged = _verdict(figures, thresholds(sketches(figures, rules, "_l", "_s"), rules), rules, "_l", "_s")
    return judged.select(F.col("_key").alias(key), *[F.col("_m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep(docs: DataFrame, rules: Rules = Rules(), *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Texts are measured twice, and shuffled only if there
    are over 100,000 groups."""
    figures = measured(packed(docs, _text=text, _l=lang, _s=source), "_text")
    limits = small_or_shuffled(durable(thresholds(sketches(figures, rules, "_l", "_s"), rules)))
    return unpacked(_verdict(figures, limits, rules, "_l", "_s").filter("_kept"), docs.columns)
