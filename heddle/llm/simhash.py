"""Near duplicates by SimHash: fingerprints of whole texts, linked where few bits differ, by pigeonhole blocks.

A fingerprint has a bit set that is set in over half of the hashes of a text's word shingles. Fingerprints link at three or
fewer differing bits of 64, and a document's component is what links reach.

1. *Fingerprints.* Hashed in Arrow batches, written once; from here on a fingerprint stands for all its documents, so copies cost one row.
2. *Blocks.* Cut into four blocks, two fingerprints with three differing bits agree on at least one: four rows each, keyed by the bits of one
   block. A key with more than ``most_rows`` fingerprints is cut again by the same rule: the bits that are still free into four blocks, of which
   close pairs agree on one as well. This is exact at each depth. It ends where twelve bits are free, since a key then has at most 4,096 fingerprints.
   So no key grows with the corpus, however many texts share a template, and where keys are sparse four rows do.
3. *Verify.* Rows of a key meet in sorted runs. A run gives the edges of a spanning forest of its pairs within the distance,
   not the pairs: every pair is compared or was reached already, and no link is lost.
4. *Components* by star contractions over distinct fingerprints, then the smallest id of each.

Shingles are of three words, as the contract of the query says.

Defined results: a text that is null, empty or without words has fingerprint zero and links like any other; one of fewer than three words is one
shingle; repeated rows have one fingerprint and are one class; a component's id is the smallest id that isn't null, and null if all its
ids are; texts are hashed whole, in runs of ``CHUNK`` shingles; an empty table gives an empty result; other columns are ignored.
The input is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import durable, small_or_shuffled, written
from heddle.llm.graph import components

SEED = 42
BITS = 64
#: Shingles whose hashes are held at once.
CHUNK = 100_000
FULL = (1 << BITS) - 1


@dataclass(frozen=True)
class Near:
    """``most_bits`` may differ; blocks are one more. Keys of over ``most_rows`` fingerprints are cut again while over ``free_bits`` are free."""

    words: int = 3
    most_bits: int = 3
    most_rows: int = 4096
    free_bits: int = 12


def fingerprint(body: bytes, words: int = 3) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    found = body.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(found) - words + 1], ends[words - 1 :]
    digest, n, ones = xxhash.xxh64_intdigest, len(first), np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in spans), np.uint64, min(CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(x.as_py() or b"", words) for x in bodies), np.uint64, len(bodies))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, how: Near = Near(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fp`` of all documents; ``fp`` as the signed number of the same bits."""
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    return rows.mapInArrow(_prints(how.words), f"id {docs.schema[key].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def cut(mask: int, blocks: int) -> list[int]:
    """``mask`` with one block more fixed, for each of the blocks into which its free bits are cut."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    ends = [len(free) * k // blocks for k in range(blocks + 1)]
    return [mask | sum(1 << k for k in free[x:y]) for x, y in zip(ends, ends[1:], strict=False)]


def _forest(fp: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs within the distance, for the fingerprints of one key."""
    left, right, rest = [], [], fp
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= most_bits
            if near.any():
                reached, rest = rest[near], rest[~near]
                left.append(np.full(len(reached), x, fp.dtype))
                right.append(reached)
                todo.extend(reached)
    return np.concatenate([fp[:0], *left]), np.concatenate([fp[:0], *right])


def run_edges(starts: np.ndarray, fp: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the runs of ``fp`` that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(fp)))
    run = np.repeat(np.arange(len(starts)), sizes)
    left_rows, pairs = np.flatnonzero(sizes[run] <= 64), []
    for k in range(1, 64):
        left_rows = left_rows[left_rows + k < len(fp)]
        left_rows = left_rows[run[left_rows] == run[left_rows + k]]
        if not len(left_rows):
            break
        hit = left_rows[np.bitwise_count(fp[left_rows] ^ fp[left_rows + k]) <= most_bits]
        pairs.append((hit, hit + k))
    a, b = (np.concatenate([p[i] for p in pairs] or [np.empty(0, np.int64)]) for i in (0, 1))
    # Runs that are long, or have so many pairs that some are idle, give a forest.
    many = (sizes > 64) | (np.bincount(run[a], minlength=len(starts)) >= sizes)
    few = ~many[run[a]]
    left, right = [fp[a[few]]], [fp[b[few]]]
    for at in np.flatnonzero(many):
        x, y = _forest(fp[starts[at] : starts[at] + sizes[at]], most_bits)
        left.append(x)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _edges(most_bits: int):
    """From ``mask, key, fp``, sorted, to edges; a key that goes on in the next batch is kept for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for batch in (*batches, None):
            new = kept if batch is None else [np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns, strict=True)]
            mask, key, fp = new
            starts = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))) if len(fp) else np.empty(0, np.int64)
            whole = len(fp) if batch is None or not len(starts) else starts[-1]
            kept = [c[whole:] for c in new]
            starts = starts[starts < whole]
            if len(starts):
                # Unsigned, since numpy counts the bits of a signed number's absolute value.
                left, right = run_edges(starts, fp[:whole].view(np.uint64), most_bits)
                yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["x", "y"])

    return run


def close_pairs(prints: DataFrame, how: Near = Near()) -> DataFrame:
    """Edges ``x, y`` that connect what pairs of distinct ``fp`` within ``how.most_bits`` connect."""
    spark, blocks = prints.sparkSession, how.most_bits + 1
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in cut(0, blocks)])).alias("mask"))
    found = []
    while True:
        keyed = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        free = F.lit(BITS) - F.bit_count("mask")
        large = durable(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter((F.col("n") > how.most_rows) & (free > how.free_bits)).select("mask", "key"))
        # Bounded by the depth: at most blocks ** depth masks.
        again = [r[0] for r in large.select("mask").distinct().collect()]
        few = small_or_shuffled(large)
        small = keyed.join(few, ["mask", "key"], "left_anti") if again else keyed
        found.append(small.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp").mapInArrow(_edges(how.most_bits), "x long, y long"))
        if not again:
            break
        deeper = spark.createDataFrame([(m, [_signed(s) for s in cut(m & FULL, blocks)]) for m in again], "mask long, masks array<bigint>")
        rows = durable(keyed.join(few, ["mask", "key"], "left_semi").join(F.broadcast(deeper), "mask").select("fp", F.explode("masks").alias("mask")).distinct())
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(docs: DataFrame, how: Near = Near(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the key, its ``fingerprint`` in hexadecimal digits and its ``component_id``."""
    all_prints = written(fingerprints(docs, how, key=key, text=text))
    classes = written(all_prints.groupBy("fp").agg(F.min("id").alias("least")))
    label = components(close_pairs(classes.select("fp"), how), "x", "y")
    # Few fingerprints link; the rest are their own components.
    linked = small_or_shuffled(durable(label.select(F.col("node").alias("fp"), "component")))
    known = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = small_or_shuffled(durable(known.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n")))
    of = durable(known.join(least, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = all_prints.join(small_or_shuffled(of), "fp", "left")
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
