"""Jaccard join of documents on their word shingles, as a blocked sparse product of incidence matrices.

A document is a row of a 0/1 matrix, a shingle a column; the overlaps of all pairs are the product of the
matrix with its transpose. What is wanted are the connected components of the pairs whose overlap is large
against their sizes, so the product is computed only where such an entry can be:

1. *Columns in blocks.* The column space is cut by hash into as many blocks as the matrix needs to give
   each about ``block_entries`` entries. A block tells for every row how many of its entries are in columns
   with another row. A column found twice in one Arrow batch is settled there and sent once, so a column
   that fills a third of the rows stays small.
2. *Size bounds on rows.* A row of ``n`` entries that shares less than 80 % of ``n`` with all others together
   can't be in a pair. Rows with equal sets are one row from here on. Both steps repeat while rows fall out.
3. *Size bounds on entries.* Columns are put in order of their number of rows. Two rows that overlap enough
   have a common column among the first ``n - ceil(0.8 n) + 1`` of either. Only these give candidates.
4. *Masked product.* In a column every row first meets one row, that with the most neighbours. Overlaps are counted for
   these entries of the product, and components formed. Then every pair of rows in a column whose rows are
   still in two components and whose sizes are within 80 % and in which the column stands early enough is counted as well. Pairs already connected need
   no count, which is why large groups of near copies cost rows, not pairs, and no link is lost.

Overlaps are counts of equal 64-bit hashes of five words.

Defined results: a null or empty text, or one without words, has size 0 and links with nothing; a text of
fewer than five words is one shingle; a null id never becomes a component's id unless all its ids are null;
repeated rows are rows of one class; an empty table gives an empty result. The input has to be read the
same way twice (a file, a table, a checkpoint).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import SHINGLE_WORDS, durable, packed, small_or_shuffled, unpacked
from heddle.llm.graph import components

GAP = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: A block's entry that needs no answer: its batch has settled it.
SETTLED = np.uint32(0xFFFFFFFF)
#: Rows whose words a worker holds at once.
CHUNK = 400


@dataclass(frozen=True)
class Join:
    percent: int = 80
    words: int = SHINGLE_WORDS
    block_entries: int = 1_000_000
    most_passes: int = 4


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64)."""
    split = [[] if t is None else t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    flat = [w for x in split for w in x]
    if not flat:
        return [np.empty(0, np.uint64) for _ in texts]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for k in range(1, words):
            rolled[:-k] = rolled[:-k] * GAP + hashes[k:]
        out = []
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= words:
                out.append(np.unique(_mixed(rolled[end - n : end - words + 1])))
            elif n:
                h = np.uint64(n)
                for x in hashes[end - n : end]:
                    h = h * GAP + x
                out.append(_mixed(np.array([h], dtype=np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets."""
    with np.errstate(over="ignore"):
        a, b = np.bitwise_xor.reduce(_mixed(s * GAP)), np.add.reduce(_mixed(s + GAP))
    return int(a.view(np.int64)), int(b.view(np.int64))


PARTS = "block int, base long, keys binary, places binary, about_row binary, about_n binary, about_count binary, about_a binary, about_b binary"
ANSWER = "base long, places binary, counts binary, about_row binary, about_n binary, about_count binary, about_a binary, about_b binary"
COUNTED = "row long, shared long, n long, a long, b long"


def _scatter(blocks: int, words: int):
    """Cuts each batch of ``_row, text`` or ``_row, hashes`` into its entries by column block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                pdf = whole.iloc[at : at + CHUNK]
                if pdf.empty:
                    continue
                sets = shingle_sets(pdf["text"].tolist(), words) if "text" in pdf else [np.asarray(x).view(np.uint64) for x in pdf["hashes"]]
                rows = pdf["_row"].to_numpy(np.int64)
                # A batch is named by its first row, and its rows by their places in it.
                base = int(rows[0])
                n = np.array([len(s) for s in sets], dtype=np.int64)
                keys = [_set_key(s) if len(s) else (0, 0) for s in sets]
                flat = np.concatenate(sets) if n.sum() else np.empty(0, np.uint64)
                place = np.repeat(np.arange(len(rows), dtype=np.uint32), n)
                order = np.argsort(flat, kind="stable")
                flat, place = flat[order], place[order]
                new = np.ones(len(flat), bool)
                new[1:] = flat[1:] != flat[:-1]
                runs = np.flatnonzero(new)
                size = np.diff(np.append(runs, len(flat)))
                several = size > 1
                settled = np.bincount(place[np.repeat(several, size)], minlength=len(rows)) if len(flat) else np.zeros(len(rows), np.int64)
                sent_key, sent_place = flat[runs], np.where(several, SETTLED, place[runs])
                block = ((sent_key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
                cuts = np.searchsorted(block, np.arange(blocks + 1, dtype=np.uint64))
                low = (sent_key * GAP >> np.uint64(32)).astype(np.uint32)
                home = (base // 7) % blocks
                out = []
                for b in range(blocks):
                    x, y = cuts[b], cuts[b + 1]
                    if x == y and b != home:
                        continue
                    about = [rows, n, settled, np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)] if b == home else [np.empty(0, np.int64)] * 5
                    out.append((b, base, low[x:y].tobytes(), sent_place[x:y].tobytes(), *(np.asarray(z, np.int64).tobytes() for z in about)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    return run


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block, for each batch: the places of rows that share entries with another row, and how many."""
    keys, places = ([np.frombuffer(x, np.uint32) for x in pdf[c]] for c in ("keys", "places"))
    part = np.repeat(np.arange(len(pdf), dtype=np.int32), [len(k) for k in keys])
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    key, place, part = key[order], place[order], part[order]
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        eq = key[1:] == key[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    hit = same & (place != SETTLED)
    cell, count = np.unique(part[hit].astype(np.int64) << 32 | place[hit].astype(np.int64), return_counts=True)
    cuts = np.searchsorted(cell >> 32, np.arange(len(pdf) + 1))
    at = (cell & 0xFFFFFFFF).astype(np.uint32)
    out = pdf[["base", "about_row", "about_n", "about_count", "about_a", "about_b"]].copy()
    out["places"] = [at[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
    out["counts"] = [count[x:y].astype(np.int64).tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
    return out[[c.split()[0] for c in ANSWER.split(", ")]]


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: its rows with the sums of what the blocks have answered."""
    home = pdf[pdf["about_row"].map(len) > 0].iloc[0]
    row, n, shared, a, b = (np.frombuffer(home[c], np.int64).copy() for c in ("about_row", "about_n", "about_count", "about_a", "about_b"))
    for places, counts in zip(pdf["places"], pdf["counts"], strict=True):
        shared[np.frombuffer(places, np.uint32)] += np.frombuffer(counts, np.int64)
    return pd.DataFrame({"row": row, "shared": shared, "n": n, "a": a, "b": b})


def shared_counts(rows: DataFrame, blocks: int, words: int) -> DataFrame:
    """For each ``_row``: ``n`` entries, ``shared`` of them in columns with another row, and the set's key ``a, b``."""
    parts = rows.mapInPandas(_scatter(blocks, words), PARTS)
    answers = parts.groupBy("block").applyInPandas(_gather, ANSWER)
    return answers.groupBy("base").applyInPandas(_total, COUNTED)


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                pdf = whole.iloc[at : at + CHUNK]
                sets = shingle_sets(pdf["text"].tolist(), words)
                yield pd.DataFrame({"_row": pdf["_row"].to_numpy(), "n": [len(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]})

    return run


def _links(pairs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The pairs ``x, y`` whose entry in the product is large enough."""
    left, right = (sets.select(F.col("_row").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}")) for c in "xy")
    overlap = F.size(F.array_intersect("hx", "hy"))
    both = pairs.join(left, "x").join(right, "y").withColumn("_o", overlap)
    return both.filter(100 * F.col("_o") >= how.percent * (F.col("nx") + F.col("ny") - F.col("_o"))).select("x", "y")


def _may_link(na: str, nb: str, ia: str, ib: str, how: Join) -> Column:
    """Whether two rows of ``na`` and ``nb`` entries may link if their first common column is the ``ia``-th and ``ib``-th of
    theirs: by their sizes, and because what is common can't be more than what is left from there on."""
    sizes = 100 * F.least(na, nb) >= how.percent * F.greatest(na, nb)
    left = 1 + F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib))
    return sizes & ((100 + how.percent) * left >= how.percent * (F.col(na) + F.col(nb)))


def linked(docs: DataFrame, how: Join = Join(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` (see :func:`numbered`), ``n_shingles``, ``component_id`` and ``is_first``, one row a document."""
    rows = numbered(docs, key, text).select("_row", "_id", "text")
    est = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks_for = lambda entries: max(1, -(-int(entries) // how.block_entries))
    first = shared_counts(rows.select("_row", "text"), blocks_for(est / 6), how.words)
    stats = durable(first.join(rows.select(F.col("_row").alias("row"), "_id"), "row"))
    order = F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("row").alias("row"))
    classes = stats.filter("n > 0").groupBy("a", "b").agg(F.min(order).alias("rep"), F.max("n").alias("n"), F.min("shared").alias("shared"), F.count("*").alias("members"))
    enough = lambda shared, n: 100 * F.col(shared) >= how.percent * F.col(n)
    likely = small_or_shuffled(durable(classes.filter(enough("shared", "n")).select(F.col("rep.row").alias("_row"))))
    sets = durable(rows.join(likely, "_row", "left_semi").select("_row", "text").mapInPandas(_sets(how.words), "_row long, n long, hashes array<bigint>"))
    before = None
    for _ in range(how.most_passes):
        entries, n_rows = sets.agg(F.sum("n"), F.count("*")).head()
        if not n_rows or n_rows == before:
            break
        before = n_rows
        again = shared_counts(sets.select("_row", "hashes"), blocks_for(entries), how.words)
        sets = durable(sets.join(again.filter(enough("shared", "n")).select(F.col("row").alias("_row")), "_row", "left_semi"))
    entry = sets.select("_row", "n", F.explode("hashes").alias("h"))
    columns = entry.groupBy("h").agg(F.count("*").alias("df"))
    ranked = entry.join(columns, "h").groupBy("_row").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    prefix = F.expr(f"cast(n - (({how.percent} * n + 99) div 100) + 1 as int)")
    # A row's weight is the mean number of rows in its columns: of a group of near copies the one that all others were made from has most.
    weight = F.expr("aggregate(s, 0L, (t, x) -> t + x.df) / n")
    numbered_cells = F.filter(F.transform(F.slice("s", 1, prefix), lambda x, i: F.struct(x["df"].alias("df"), x["h"].alias("h"), (i + 1).alias("i"))), lambda x: x["df"] > 1)
    cells = durable(ranked.select("_row", "n", weight.alias("w"), F.explode(numbered_cells).alias("c")).select("_row", "n", "w", F.col("c.h").alias("h"), F.col("c.i").alias("i")))
    heads = cells.groupBy("h").agg(F.max_by(F.struct(F.col("_row").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix")), F.struct("w", -F.col("_row"))).alias("head"), F.count("*").alias("k")).filter("k > 1").select("h", "head.*")
    stars = cells.join(heads, "h").filter(F.col("_row") != F.col("x")).filter(_may_link("n", "nx", "i", "ix", how)).select("x", F.col("_row").alias("y")).distinct()
    links = durable(_links(stars, sets, how))
    label = components(links, "x", "y")
    part = cells.join(label.withColumnRenamed("node", "_row"), "_row", "left").withColumn("part", F.coalesce("component", "_row")).drop("component")
    mixed = part.groupBy("h").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).filter("p0 < p1").select("h")
    part = durable(part.join(mixed, "h", "left_semi"))
    one, two = (part.select("h", F.col("_row").alias(c), F.col("n").alias(f"n{c}"), F.col("i").alias(f"i{c}"), F.col("part").alias(f"p{c}")) for c in "xy")
    cross = one.join(two, (one["h"] == two["h"]) & (F.col("px") < F.col("py")) & _may_link("nx", "ny", "ix", "iy", how)).select("x", "y").distinct()
    more = durable(_links(cross.join(stars, ["x", "y"], "left_anti"), sets, how))
    final = components(links.unionByName(more), "x", "y")
    by_class = classes.select("a", "b", "rep", F.col("rep.row").alias("node")).join(final, "node", "left").withColumn("_c", F.coalesce("component", "node"))
    heads = by_class.groupBy("_c").agg(F.min("rep").alias("head"))
    known = by_class.join(heads, "_c").select("a", "b", "head")
    out = stats.join(known.withColumn("_has", F.lit(True)), ["a", "b"], "left").withColumn("_has", F.col("_has") & (F.col("n") > 0))
    return out.select(
        F.col("row").alias("_row"), F.col("_id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("_has"), F.col("head.id")).otherwise(F.col("_id")).alias("component_id"),
        F.coalesce(F.col("head.row") == F.col("row"), ~F.coalesce("_has", F.lit(False))).alias("is_first"),
    )


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` packed, with ``_row``, a number that every reading of the same files gives alike."""
    return packed(docs, _id=key, text=text).withColumn("_row", F.monotonically_increasing_id())


def join(docs: DataFrame, how: Join = Join(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the key, ``n_shingles`` and ``component_id``."""
    return linked(docs, how, key=key, text=text).select(key, "n_shingles", "component_id")


def keep_first(docs: DataFrame, how: Join = Join(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; documents without words stay."""
    later = small_or_shuffled(durable(linked(docs, how, key=key, text=text).filter("not is_first").select("_row")))
    return unpacked(numbered(docs, key, text).join(later, "_row", "left_anti"), docs.columns)
