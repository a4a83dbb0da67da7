"""Mixing sources to target weights by Pfair scheduling of their blocks.

The rows of a source are cut into blocks. Time is counted in block slots; with weight ``w`` the ``j``-th
block of a source is released at ``floor((j - 1) / w)`` and due at ``ceil(j / w)``, and each slot goes to
the released block that is due first. Weights are exact fractions, those of the decimals that they print as, and
are never rounded to a period, so at every slot of any table every source with blocks left has had its share within
less than one block. When a source runs out, the others' weights are scaled up and a new phase begins; so
all rows are placed, once each.

The driver walks through all slots, one for each block, and holds one row of the plan for each. A block has ``block_rows`` rows, or
so many more that there are about ``most_slots`` blocks, so the driver's work has a bound at any size of the table.

Defined results: rows with a null source are a source of their own; every source has its own weight, however
many there are; sources of weight 0 come after all others, with equal shares; blocks due at once go by weight,
then by name; without given weights they are the square roots of the sources' row counts; a source that given weights
don't name has the least of them; an empty table gives an empty one; all columns stay as they are, and a new column whose name is taken gets
an underscore behind (:func:`new_names`). Repeated rows each get a place.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import free_names, gapless_rank, packed, unpacked

NO_SOURCE = "\x00none"


@dataclass(frozen=True)
class Mix:
    """``period`` and ``most_sources`` bound nothing any more: weights are exact and all sources are kept apart."""

    weights: Mapping[str, float] | None = field(default=None)
    block_rows: int = 64
    most_slots: int = 1 << 20
    period: int = 1000
    most_sources: int = 100
    rows_per_run: int = 10_000


def _exact(weights: Mapping[str, float]) -> dict[str, Fraction]:
    out = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w < 0 for w in out.values()):
        raise ValueError("a weight is negative")
    return out


def parts(weights: Mapping[str, float], period: int) -> dict[str, Fraction]:
    """Each source's exact share of ``period`` slots; equal shares if all weights are 0."""
    exact = _exact(weights)
    total = sum(exact.values())
    return {k: period * (w / total if total else Fraction(1, len(exact))) for k, w in exact.items()}


def order(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[str]:
    """The source of every slot: of the released blocks the one that is due first."""
    live = {k: n for k, n in blocks.items() if n > 0}
    exact = _exact({k: weights[k] for k in live})
    for some in ([k for k in live if exact[k]], [k for k in live if not exact[k]]):
        scale = math.lcm(*[exact[k].denominator for k in some])
        yield from _order({k: live[k] for k in some}, {k: int(exact[k] * scale) or 1 for k in some})


def _order(left: dict[str, int], whole: Mapping[str, int]) -> Iterator[str]:
    """:func:`order` for whole weights above 0. A phase's first blocks are all released at its start and are due in the order
    of weights, so they are taken up one by one: a phase costs its own slots, not the number of sources."""
    names = sorted(left, key=lambda k: (-whole[k], k))
    total = sum(whole[k] for k in names)
    while names:
        fresh = 0
        waiting: list[tuple[int, int, str, int]] = []
        ready: list[tuple[int, int, str, int]] = []
        now, ended = 0, False
        while not ended:
            while waiting and waiting[0][0] <= now:
                _, w, k, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-j * total // -w), w, k, j))
            while fresh < len(names) and (not ready or -(-total // whole[names[fresh]]) <= ready[0][0]):
                k = names[fresh]
                heapq.heappush(ready, (-(-total // whole[k]), -whole[k], k, 1))
                fresh += 1
            due, w, k, j = heapq.heappop(ready)
            if due <= now:
                raise AssertionError("a block missed its deadline")
            yield k
            now += 1
            left[k] -= 1
            if left[k]:
                heapq.heappush(waiting, (j * total // -w, w, k, j + 1))
            else:
                ended = True
                del names[bisect_left(names, (-whole[k], k), key=lambda x: (-whole[x], x))]
                total -= whole[k]


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> list[tuple[str, int, int, int, int, int, int]]:
    """Rows ``source, first, last, parts, turn, offset, slot``: of the source's blocks ``first`` up to ``last``, those whose
    number after ``first`` leaves ``turn`` when divided by ``parts`` run at ``slot + offset + period * quotient``. Here each
    block has a row of its own, so the period plays no part."""
    done = dict.fromkeys(blocks, 0)
    out = []
    for slot, k in enumerate(order(blocks, weights)):
        out.append((k, done[k], done[k] + 1, 1, 0, 0, slot))
        done[k] += 1
    return out


def _table(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float], most_broadcast: int = 1_000_000) -> DataFrame:
    """``s, b, slot`` of every block; marked for broadcast unless very long."""
    names = sorted(blocks)
    code = {k: i for i, k in enumerate(names)}
    turn = np.fromiter((code[k] for k in order(blocks, weights)), np.int32)
    block = np.empty(len(turn), np.int64)
    by_source = np.argsort(turn, kind="stable")
    starts = np.searchsorted(turn[by_source], np.arange(len(names)))
    block[by_source] = np.arange(len(turn)) - np.repeat(starts, np.bincount(turn, minlength=len(names)))
    slots = pa.table({"c": turn, "b": block, "slot": np.arange(len(turn), dtype=np.int64)})
    coded = spark.createDataFrame([(i, k) for k, i in code.items()], "c int, s string")
    table = spark.createDataFrame(slots).join(F.broadcast(coded) if len(code) <= most_broadcast // 10 else coded, "c").select("s", "b", "slot")
    return F.broadcast(table) if len(turn) <= most_broadcast else table


def new_names(docs: DataFrame) -> dict[str, str]:
    """What the new columns of :func:`mixed` are called."""
    return free_names(docs.columns, ["block", "slot", "position"])


def mixed(docs: DataFrame, how: Mix = Mix(), *, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``block`` (its number within the source), ``slot`` and ``position``, by which to order; see :func:`new_names`."""
    spark = docs.sparkSession
    named = packed(docs, _key=key, _source=source).withColumn("_src", F.coalesce(F.col("_source").cast("string"), F.lit(NO_SOURCE))).drop("_source")
    sizes = {r["_src"]: r["count"] for r in named.groupBy("_src").count().collect()}
    given = how.weights or {k: math.sqrt(n) for k, n in sizes.items()}
    weights = {k: given.get("" if k == NO_SOURCE else k, min(given.values())) for k in sizes}
    block_rows = max(how.block_rows, -(-sum(sizes.values()) // how.most_slots))
    table = _table(spark, {k: -(-n // block_rows) for k, n in sizes.items()}, weights)
    ranked = gapless_rank(named, "_src", ["_key"], "_k", how.rows_per_run).withColumn("block", F.expr(f"_k div {block_rows}"))
    joined = ranked.join(table, (F.col("_src") == F.col("s")) & (F.col("block") == F.col("b")), "left")
    out = joined.withColumn("position", F.col("slot") * block_rows + F.col("_k") % block_rows)
    return unpacked(out, docs.columns, **{new: F.col(name) for name, new in new_names(docs).items()})
