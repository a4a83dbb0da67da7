"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Equal texts form a group and stay together. A group's vector is its bytes, tokens and rows. Groups are placed
from the largest down, each where the dot product of its vector with the shard's residual capacity is highest
among the shards whose bytes still have room for it; capacities are equal shares of the totals.

At any size the driver places a bounded number of items. Groups of more than ``1 / bundles`` of a total in some
dimension are items of their own, at most ``3 * bundles`` of them. All others are bundled by hash: ``bundles``
coarse bundles, and as many fine ones over a sixteenth of the groups, which are placed last and even out what
the coarse ones left. A group larger than a whole shard in some dimension can't stay together in it: it is dealt
into the fewest equal pieces that fit, by the hash of the row.

The law that holds is ``bytes``: shard sizes are equal within about the size of a fine bundle.

Defined results: a null text has size 1 and no tokens, and is grouped with the empty text; repeated rows keep to their group; ties go to
the lower shard; an empty table gives an empty result; all columns stay as they are, and a new column whose name is taken
gets an underscore behind (:func:`new_names`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import SPACES, durable, free_names, gapless_rank, packed, unpacked


@dataclass(frozen=True)
class Packing:
    shards: int = 8
    bundles: int = 4096
    fine_of: int = 16
    rows_per_run: int = 10_000


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, a row of non-negative figures; the first column is the one kept near equal."""
    total = np.maximum(items.sum(axis=0), 1).astype(float)
    share = items / total * shards
    room = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-share[:, 0], kind="stable"):
        fits = room[:, 0] >= share[i, 0]
        score = np.maximum(room, 0) @ share[i]
        if fits.any():
            score[~fits] = -1.0
            best = int(score.argmax())
        else:
            best = int(room[:, 0].argmax())
        out[i] = best
        room[best] -= share[i]
    return out


def new_names(docs: DataFrame) -> dict[str, str]:
    """What the new columns of :func:`sharded` are called."""
    return free_names(docs.columns, ["size", "text_crc32", "shard", "slot", "law", "grown_shard"])


def sharded(docs: DataFrame, how: Packing = Packing(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``; see :func:`new_names`."""
    spark = docs.sparkSession
    t = F.coalesce(F.col("_text"), F.lit(""))
    measured = packed(docs, _key=key, _text=text).withColumns(
        {
            "size": F.octet_length(t).cast("bigint") + 1,
            "text_crc32": F.crc32(F.encode(t, "UTF-8")),
            "_tokens": F.size(F.array_remove(F.split(t, SPACES), "")).cast("bigint"),
            "_group": F.xxhash64(t),
            "_piece_hash": F.xxhash64(F.col("_key"), F.lit(7)),
        }
    )
    # Written once, since totals, large groups and bundles are made of them.
    groups = durable(measured.groupBy("_group").agg(F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count("*").alias("r")))
    total = groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).head()
    total = [max(1, x or 0) for x in total]
    large = " or ".join(f"{c} * {how.bundles} > {n}" for c, n in zip("btr", total, strict=True))
    pieces = F.greatest(F.lit(1), *[F.ceil(F.col(c) * how.shards / F.lit(n)) for c, n in zip("btr", total, strict=True)]).cast("int")
    apart = [tuple(r) for r in groups.filter(large).select("_group", "b", "t", "r", pieces.alias("n")).orderBy("_group").collect()]
    known = spark.createDataFrame([(g, n) for g, *_, n in apart], "_g long, _n int")
    kind = F.when(F.pmod(F.shiftright("_group", 32), F.lit(how.fine_of)) == 0, F.lit(1)).otherwise(0)
    bundle = F.pmod(F.col("_group"), F.lit(how.bundles)) + how.bundles * kind
    rest = groups.join(F.broadcast(known), F.col("_group") == F.col("_g"), "left_anti")
    bundled = [tuple(r) for r in rest.groupBy(bundle.alias("n")).agg(F.sum("b"), F.sum("t"), F.sum("r")).orderBy("n").collect()]
    items, named = [], []
    for g, b, tok, r, n in apart:
        for k in range(n):
            items.append((b / n, tok / n, r / n))
            named.append((True, g, k))
    for n, b, tok, r in bundled:
        items.append((b, tok, r))
        named.append((False, int(n), 0))
    shard = place(np.array(items, dtype=float).reshape(-1, 3), how.shards).tolist()
    table = spark.createDataFrame([(*x, s) for x, s in zip(named, shard, strict=True)], "_alone boolean, _item long, _piece int, shard int")
    dealt = measured.join(F.broadcast(known), F.col("_group") == F.col("_g"), "left")
    dealt = dealt.withColumns({"_a": F.col("_g").isNotNull(), "_i": F.when(F.col("_g").isNotNull(), F.col("_group")).otherwise(bundle), "_p": F.when(F.col("_g").isNotNull(), F.pmod("_piece_hash", F.col("_n"))).otherwise(0).cast("int")})
    put = dealt.join(F.broadcast(table), (F.col("_a") == F.col("_alone")) & (F.col("_i") == F.col("_item")) & (F.col("_p") == F.col("_piece")), "left")
    put = put.select("_all", "_key", "size", "text_crc32", "shard")
    ranked = gapless_rank(put, "shard", ["_key", "text_crc32", "size"], "slot", how.rows_per_run)
    new = {c: F.col(c) for c in ("size", "text_crc32", "shard", "slot")} | {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    names = new_names(docs)
    return unpacked(ranked, docs.columns, **{names[c]: v for c, v in new.items()})
