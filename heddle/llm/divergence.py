"""How far the sources of a language lie apart in their words, by an inverted index that corrects a baseline.

A term's smoothed share in a group (a language's source) is a whole number, ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``, over the ``V``
terms that the language keeps. Two groups are as far apart as the sum of ``|p - q|`` over all kept terms, also those that neither has.

1. *Index.* Tasks count words of whole texts by language, source and term before they send anything; one shuffle by
   language and term gives each term its postings, one for each source that has it. Terms in too few documents go.
2. *Baseline.* Where both counts are zero ``|p - q|`` is one number for a pair of groups, so a pair starts at ``V`` times that.
3. *Corrections.* What a group's own postings change against another group's zero counts depends on the posting's share alone, so
   postings are first added up by share. What two groups that both have the term change comes from the pairs in one posting list.
   Each is added to the pair's baseline, on the map side first; terms that neither has are never touched.
4. *Ranks.* Windows over a group: all other sources, and the terms in which it exceeds its language, to the 50th.
   Spark keeps 50 a group before the shuffle.

All arithmetic is of whole numbers; products that may exceed 64 bits are decimals. A posting list has a place for each source of the language,
and the result a row for each pair of sources, as the contract of the query says: the number of sources is what they grow with.

Defined results: a null text, language or source is an empty string; a group without terms has only zero counts; a language without kept terms has
distances 0 and no term rows; repeated rows are documents of their own; texts are read whole; an empty table gives an empty result; other
columns are ignored. The input has to be read the same way twice (a file, a table, a checkpoint).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import small_or_shuffled, written

#: Bytes that are part of no term become spaces: 0 to 0x40, 0x5B to 0x60 and 0x7B to 0x7F; capitals A to Z become small.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Counters that a task holds before it sends them on.
HELD = 500_000


@dataclass(frozen=True)
class Audit:
    least_documents: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    most_terms: int = 50


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``lang, source, text`` to counts of terms and of the documents that have them."""

    def sent() -> pa.RecordBatch:
        cells = [(*group, term, n, had[term]) for group, (all_, had) in held.items() for term, n in all_.items()]
        lang, source, term, n, docs = zip(*cells, strict=True) if cells else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.large_binary()), strict=True):
            terms = (text.as_py() or b"").translate(FOLD).split()
            all_, had = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(all_)
            all_.update(terms)
            had.update(set(terms))
            size += len(all_)
            if size > HELD:
                yield sent()
                held, size = {}, 0
    yield sent()


def inverted_index(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """``lang, term, total, postings``: for each kept term of a language its count and, for each source that has it, ``source, n``."""
    counts = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    one = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = one.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return kept.filter(F.col("docs") >= how.least_documents).drop("docs")


def _share(count: Column | str, of: Column | str, how: Audit) -> Column:
    """``1 + floor(scale (count + smoothing) / of)``, exact; null where ``of`` is 0."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(27,0)")
    # Both sides are whole and positive, so the product less its remainder divides evenly.
    product = (wide(count) + how.smoothing) * F.lit(how.scale).cast("decimal(10,0)")
    whole = F.nullif(wide(of), F.lit(0).cast("decimal(27,0)"))
    return (F.lit(1) + F.call_function("div", product, whole)).cast("long")


def shares(index: DataFrame, groups: DataFrame, how: Audit = Audit()) -> tuple[DataFrame, DataFrame]:
    """Of groups ``lang, source`` the table ``lang, source, sid, all, zero, kept``, and of postings ``lang, term, source, sid, zero, p, q``.

    ``sid`` numbers a language's sources, ``zero`` is the share of a count of zero, ``kept`` the language's number of terms, ``q`` the share in the language.
    """
    posting = index.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    own = posting.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("sum"))
    smooth = F.lit(how.smoothing) * F.coalesce("kept", F.lit(0))
    table = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    table = table.withColumn("of", F.coalesce("own", F.lit(0)) + smooth).withColumn("lang_of", F.coalesce("sum", F.lit(0)) + smooth)
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    table = written(table.select("lang", "source", sid.alias("sid"), "of", "lang_of", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce(_share(F.lit(0), "of", how), F.lit(0)).alias("zero")))
    with_groups = posting.join(small_or_shuffled(table.select("lang", "source", "sid", "of", "lang_of", "zero")), ["lang", "source"])
    return table, with_groups.select("lang", "term", "source", "sid", "zero", _share("n", "of", how).alias("p"), _share("total", "lang_of", how).alias("q"))


def corrections(posting: DataFrame, table: DataFrame) -> DataFrame:
    """``lang, a, b, value``: what postings change in the distance of sources numbered ``a`` and ``b``, for ``a < b``."""
    # Against a zero count of the other, by distinct share; where the other has the term too, the next step takes it back.
    by_share = posting.groupBy("lang", "sid", "zero", "p").agg(F.count("*").alias("k"))
    other = small_or_shuffled(table.select("lang", F.col("sid").alias("other"), F.col("zero").alias("other_zero")))
    alone = by_share.join(other, "lang").filter("sid <> other").select(
        "lang", F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"),
        (F.col("k") * (F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("zero") - F.col("other_zero")))).alias("value"),
    )
    lists = posting.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "zero")).alias("list"))
    one = lists.select("lang", "list", F.explode("list").alias("x"))
    two = one.select("lang", "x", F.explode(F.filter("list", lambda y: y["sid"] > F.col("x.sid"))).alias("y"))
    gap = lambda u, v: F.abs(F.col(u) - F.col(v))
    both = two.select("lang", F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), (gap("x.p", "y.p") - gap("x.p", "y.zero") - gap("x.zero", "y.p") + gap("x.zero", "y.zero")).alias("value"))
    return alone.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).unionByName(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, how: Audit = Audit(), *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's distance to the others, and the terms in which it exceeds its language."""
    rows = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])
    index = written(inverted_index(rows, how))
    table, posting = shares(index, rows.select("lang", "source").distinct(), how)
    posting = written(posting)
    x, y = (table.select("lang", F.col("source").alias(f"source_{s}"), F.col("sid").alias(s), F.col("zero").alias(f"zero_{s}"), "kept") for s in "ab")
    pairs = x.join(y.drop("kept"), "lang").filter("a < b")
    base = pairs.select("lang", "a", "b", (F.col("kept") * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value"))
    distance = base.unionByName(corrections(posting, table)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = small_or_shuffled(table.select("lang", "source", "sid"))
    named = distance.join(names.select("lang", F.col("sid").alias("a"), F.col("source").alias("x")), ["lang", "a"]).join(names.select("lang", F.col("sid").alias("b"), F.col("source").alias("y")), ["lang", "b"])
    ways = named.select("lang", "value", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("w"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    near = ranked(ways.select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value"))
    above = posting.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return near.unionByName(ranked(above).filter(F.col("rank") <= how.most_terms))
