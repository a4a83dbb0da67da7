"""Fuzzy deduplication of lines: of every group of near-equal lines in the corpus one occurrence stays.

All in DataFrame functions:

1. *Signatures*, in one scan. A line's signature is over all its character shingles of ``width`` characters, the same
   ones that decide, so its estimate holds for lines of any length, script and white space. The hashes are sorted once;
   band ``j`` is the ``rows`` smallest hashes above the ``j``-th of ``bands`` fixed bounds, going round at the end. Two
   lines agree there with probability about ``J ** rows``, as for ``rows`` independent minima: 0.995 in any of ten bands
   of four at a similarity of 0.8. Keys, places and bands are written once; all later steps read those.
2. *Buckets*. Bands are dealt once; those that different lines share are found by their least and greatest key and
   looked up again in the rows dealt, which pass by one after the other. A band that a third of all lines have takes no memory.
3. *Stars*: in a bucket every line first meets one line, that with the most bucket neighbours. Of an original
   and its variants this is the original, since a variant has left some of the buckets.
4. *Verification*: the exact Jaccard similarity of all character shingles of both lines, from their texts.
5. *The rest*: after *union-find* by star contraction (:mod:`heddle.llm.graph`), every line of a bucket meets all lines of it
   that are in other components, so components are those of all candidate pairs. Two bounds that no alike pair exceeds come
   before, on the sizes and on the bits in which parity maps of the shingles differ; a pair comes from the least band that it
   shares alone. Of ``n`` lines of one bucket that stars leave apart each is sent to ``1 + n / BUCKET_RUN`` salts without its
   text: work, and beyond some such lines rows too, grow with the square of ``n``.
6. The first occurrence of a component stays.

Defined results: null texts stay null; lines of fewer than ``least_words`` words are never touched, nor are
empty ones; repeated rows are separate occurrences, so a second copy loses its lines; of places with the same key the
smaller row number is first; a document all of whose long lines go and which has no other line with a word is dropped,
since its text is kept elsewhere; a line of any length is signed whole, in memory of a few arrays with a hash for each character
of the longest line; an empty table gives an empty one; other columns are kept, whatever their names, and a new column whose name is taken gets an
underscore behind. The input has to be
read the same way twice (a file, a table, a checkpoint).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import durable, free_names, packed, small_or_shuffled, unpacked, written
from heddle.llm.graph import components

WORD = r"[^\x20\x09-\x0D]"
SPACE = " \t\n\x0b\x0c\r"
#: 64-bit words of a line's parity map; about how many lines of a bucket meet its others in one salt.
MAP_WORDS, BUCKET_RUN = 8, 1_000
#: Sorted hashes that are put behind the last one, so that a band can go round: at least as many as a band has.
NEAR = 9


@dataclass(frozen=True)
class Likeness:
    """How lines are compared. ``percent``: the least similarity."""

    width: int = 8
    bands: int = 10
    rows: int = 4
    percent: int = 80
    least_words: int = 5


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used: as an element of an array it has a name."""
    return F.transform(F.array(value), use)[0]


def shingles(line: Column, how: Likeness) -> Column:
    """Hashes of a line's character shingles, at every place. A line shorter than a shingle is its own only one.

    Of UTF-32, where each character takes four bytes, a piece is cut out without looking for its place.
    """
    last = lambda b: F.greatest(F.octet_length(b) - (4 * how.width - 1), F.lit(1))
    return once(F.encode(line, "UTF-32"), lambda b: F.transform(F.sequence(F.lit(1), last(b), F.lit(4)), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * how.width)))))


def _with_bands(lines: DataFrame, how: Likeness) -> DataFrame:
    """Adds ``_bands`` of ``_line``, each one hash.

    The bounds are sorted among the distinct hashes, so that a bound's place, less the bounds before it, tells where its band
    begins. Each step's arrays are columns, as within one column they would be worked out for each band.
    """
    bounds = F.array(*[F.lit(-(2**63) + (2**64 // how.bands) * j) for j in range(how.bands)])
    same = lambda x: x
    rows = lines.withColumn("_sorted", F.sort_array(F.array_distinct(shingles(F.col("_line"), how))))
    rows = rows.withColumns({"_ring": F.concat("_sorted", F.slice("_sorted", 1, max(NEAR, how.rows))), "_among": F.sort_array(F.concat("_sorted", bounds)), "_n": once(F.least(F.size("_sorted"), F.lit(how.rows)), same)})
    bands = F.array(*[F.xxhash64(F.lit(j), F.slice("_ring", F.array_position("_among", bounds[j]).cast("int") - j, F.col("_n"))) for j in range(how.bands)])
    return rows.select(*lines.columns, bands.alias("_bands"))


def occurrences(rows: DataFrame, how: Likeness) -> DataFrame:
    """Written: of every long line of ``rows`` (``_row, _order, _text``) its place, 128-bit key, a 64-bit one, and bands."""
    lines = rows.select("_row", "_order", F.posexplode(F.split("_text", "\n")).alias("_pos", "_raw")).select("_row", "_order", "_pos", F.btrim("_raw", F.lit(SPACE)).alias("_line"))
    long = lines.filter(F.col("_line").rlike(rf"^(?:{WORD}++[\x20\x09-\x0D]++){{{max(1, how.least_words) - 1}}}{WORD}"))
    return written(_with_bands(long, how).select("_row", "_order", "_pos", F.unhex(F.md5("_line")).alias("_key"), F.xxhash64("_line").alias("_k"), "_bands"))


def buckets(found: DataFrame) -> DataFrame:
    """``_band, _k`` of the bands that different lines share."""
    rows = found.select("_k", F.explode("_bands").alias("_band")).repartition("_band")
    shared = rows.groupBy("_band").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi")).filter("_lo < _hi").select("_band")
    return rows.join(shared.hint("shuffle_hash"), "_band").select("_band", "_k").distinct()


def _picked(rows: DataFrame, places: DataFrame, how: Likeness) -> DataFrame:
    """Written: the lines at the places ``_at`` (``p``, ``key``, ``k``), with a number each and the number of their shingles."""
    at = once(F.split("_text", "\n"), lambda x: F.transform("_at", lambda a: F.struct(a["key"].alias("key"), a["k"].alias("k"), x[a["p"]].alias("raw"))))
    lines = rows.join(places, "_row").select(F.explode(at).alias("x")).select(F.col("x.k").alias("_k"), F.col("x.key").alias("_key"), F.btrim("x.raw", F.lit(SPACE)).alias("_line"))
    return written(lines.select("*", F.size(F.array_distinct(shingles(F.col("_line"), how))).alias("_size")).withColumn("_id", F.monotonically_increasing_id()))


def _alike(pairs: DataFrame, lines: DataFrame, how: Likeness) -> DataFrame:
    """The pairs ``a, b`` of lines' numbers whose similarity is large enough."""
    left, right = (lines.select(F.col("_id").alias(x), F.col("_line").alias(f"_l{x}"), F.col("_size").alias(f"_n{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("_common", F.size(F.array_intersect(shingles(F.col("_la"), how), shingles(F.col("_lb"), how))))
    return both.filter(100 * F.col("_common") >= how.percent * (F.col("_na") + F.col("_nb") - F.col("_common"))).select("a", "b")


def _parity(word: int) -> Column:
    """64 bits: of every shingle hash ``_h`` of a line that is dealt to this word one bit is turned."""
    turned = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_h", F.lit(64)).cast("int"))
    return F.bit_xor(F.when(F.pmod(F.shiftright("_h", 6), F.lit(MAP_WORDS)) == word, turned).otherwise(F.lit(0).cast("bigint")))


def _may_be_alike(how: Likeness) -> Column:
    """False only for pairs that can't be alike. Every bit in which the maps differ is a shingle of one line alone."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"_m{i}a").bitwiseXOR(F.col(f"_m{i}b"))) for i in range(MAP_WORDS)])
    na, nb = F.col("_na"), F.col("_nb")
    return (100 * F.least(na, nb) >= how.percent * F.greatest(na, nb)) & ((100 + how.percent) * differ <= (100 - how.percent) * (na + nb))


def _across(members: DataFrame, label: DataFrame, lines: DataFrame, how: Likeness) -> DataFrame:
    """Pairs ``a, b`` that share a bucket, are in two components and may be alike. Large buckets are dealt by a salt."""
    part = members.join(label.withColumnRenamed("node", "_id"), "_id", "left").withColumn("_part", F.coalesce("component", "_id")).drop("component")
    mixed = part.groupBy("_band").agg(F.min("_part").alias("_p0"), F.max("_part").alias("_p1"), F.count("*").alias("_n")).filter("_p0 < _p1").select("_band", F.expr(f"1 + _n div {BUCKET_RUN}").alias("_salts"))
    part = durable(part.join(mixed, "_band"))
    own = part.groupBy("_id").agg(F.collect_list("_band").alias("_in"))
    hashes = lines.select("_id", "_line").join(own.select("_id"), "_id").select("_id", F.explode(F.array_distinct(shingles(F.col("_line"), how))).alias("_h"))
    maps = hashes.groupBy("_id").agg(*[_parity(i).alias(f"_m{i}") for i in range(MAP_WORDS)])
    full = part.join(durable(own.join(maps, "_id")), "_id")
    of = lambda rows, x: rows.select(F.col("_band").alias(f"_band{x}"), F.col("_salt").alias(f"_salt{x}"), F.col("_id").alias(x), F.col("_part").alias(f"_p{x}"), F.col("_size").alias(f"_n{x}"), F.col("_in").alias(f"_in{x}"), *[F.col(f"_m{i}").alias(f"_m{i}{x}") for i in range(MAP_WORDS)])
    one = of(full.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts"))), "a")
    two = of(full.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))), "b").hint("merge")
    met = one.join(two, (F.col("_banda") == F.col("_bandb")) & (F.col("_salta") == F.col("_saltb")) & (F.col("_pa") < F.col("_pb")) & _may_be_alike(how))
    return met.filter(F.array_min(F.array_intersect("_ina", "_inb")) == F.col("_banda")).select("a", "b")


def near_pairs(rows: DataFrame, found: DataFrame, firsts: DataFrame, how: Likeness) -> tuple[DataFrame, DataFrame]:
    """Edges ``a, b`` between numbers of different lines, with the components of all verified candidate pairs, and the
    ``_key`` of each number ``_id``.

    ``found`` are the occurrences, ``firsts`` has the place where each key is first.
    """
    shared = durable(buckets(found))
    places = firsts.join(shared.select("_k").distinct(), "_k", "left_semi").groupBy("_first.r").agg(F.collect_list(F.struct(F.col("_first.p").alias("p"), F.col("_key").alias("key"), F.col("_k").alias("k"))).alias("_at"))
    places = small_or_shuffled(durable(places.withColumnRenamed("r", "_row")), bytes_of=32 * F.size("_at") + 32)
    lines = _picked(rows, places, how)
    members = durable(shared.join(lines.select("_k", "_id", "_size"), "_k").drop("_k"))
    counts = members.groupBy("_band").agg(F.count("*").alias("_n"))
    weights = members.join(counts, "_band").groupBy("_id").agg(F.sum("_n").alias("_w"))
    heads = members.join(weights, "_id").groupBy("_band").agg(F.max(F.struct("_w", "_id", "_size")).alias("h")).select("_band", F.col("h._id").alias("a"), F.col("h._size").alias("_size_a"))
    sizes = how.percent * F.greatest("_size", "_size_a") <= 100 * F.least("_size", "_size_a")
    pairs = heads.join(members, "_band").filter((F.col("a") != F.col("_id")) & sizes).select("a", F.col("_id").alias("b")).distinct()
    label = durable(components(_alike(pairs, lines, how), "a", "b"))
    edges = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_alike(_across(members, label, lines, how), lines, how))
    return edges, lines.select("_id", "_key")


def removals(rows: DataFrame, how: Likeness) -> DataFrame:
    """``_row`` and ``_gone``, the places of the lines that go, for the rows of ``rows`` that lose any."""
    found = occurrences(rows, how)
    place = F.struct(F.col("_order").alias("o"), F.col("_row").alias("r"), F.col("_pos").alias("p"))
    firsts = written(found.select("_key", "_k", place.alias("_at")).groupBy("_key", "_k").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    edges, keys = near_pairs(rows, found, firsts, how)
    group = durable(components(edges, "a", "b").withColumnRenamed("node", "_id").join(keys, "_id").select("_key", "component"))
    grouped = firsts.join(group, "_key")
    stays = grouped.groupBy("component").agg(F.min("_first").alias("_stays"))
    near = grouped.join(stays, "component").select("_key", "_stays.r", "_stays.p")
    copied = firsts.filter("_n > 1").join(group, "_key", "left_anti").select("_key", "_first.r", "_first.p")
    gone = found.select("_row", "_pos", "_key").join(near.unionByName(copied), "_key").filter("_row <> r or _pos <> p")
    return gone.groupBy("_row").agg(F.collect_list("_pos").alias("_gone"))


def dedup_lines(docs: DataFrame, how: Likeness = Likeness(), *, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without the lines that have an earlier near copy (by ``key``, then place).

    With ``counts``, also ``n_lines`` and ``n_removed`` (long), and no document is dropped.
    """
    numbered = packed(docs, _order=key, _text=text).withColumn("_row", F.monotonically_increasing_id())
    gone = small_or_shuffled(durable(removals(numbered.select("_row", "_order", "_text"), how)), bytes_of=4 * F.size("_gone") + 32)
    lines = F.split("_text", "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    joined = numbered.join(gone, "_row", "left")
    out = joined.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("_text")))
    if not counts:
        return unpacked(out.filter(F.col("_gone").isNull() | F.col("_left").rlike(WORD)), docs.columns, **{text: F.col("_left")})
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    n_removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint")
    names = free_names(docs.columns, ["n_lines", "n_removed"])
    return unpacked(out, docs.columns, **{text: F.col("_left"), names["n_lines"]: n_lines, names["n_removed"]: n_removed})
