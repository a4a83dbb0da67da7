"""What five filters do to each other, in each order in which they may be applied, by a fingerprint-routed RDD.

Each text fails some of five filters, which makes a mask of five bits. For any order of the filters, all that one asks about
a part of the corpus (what a step removes, what it only repeats, what nobody else would have removed) follows from how many
documents have which mask, so a part needs one vector of counts and the 120 orders cost nothing more.

1. *Route.* Four filters look at one text alone. The fifth, for copies, needs all equal texts: a task chains the texts that it reads
   by xxhash. A chain holds the whole text of each entry, so two texts with one fingerprint stay two, and its smallest id. Ids that
   aren't the smallest are done with where they are met; each text goes on once, to the partition of its fingerprint, with
   its smallest id. So of a group of copies, however large, a task sends one row.
2. *Chain.* The receiving partition chains the same way and settles the smallest ids against each other. There are as many partitions as the
   bytes of all texts, summed up before, ask for, so the texts that a task holds don't grow with the corpus.
3. *Merge.* Documents with labels get them by a join on ids, without texts. ``combineByKey`` adds each to its part's vector, on the map
   side first, so a part that holds a third of all rows sends one vector a task.

Filters: ``A`` under 100 words; ``B`` under 80 of 100 words distinct; ``C`` over 10 of 100 characters in A-Z; ``D`` one of ``#$%&*|``; ``E`` a
smaller id has the same text, anywhere in the table, removed or not.

Defined results: a null text is an empty one, and both are copies of each other; a null language is the part of the empty string, and
one with it; a document with a null id fails E never and makes no other fail it, and has no labels; repeated rows count each, and
don't make each other fail E, as their ids are equal; of several labels of an id any 1 counts; texts are read whole; an empty table gives an
empty result; other columns are ignored. The input has to be read the same way twice (a file, a table, a checkpoint).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes of texts that a task chains before it sends them on, and that a receiving partition gets.
HELD_BYTES = 32_000_000
#: Partitions of the parts' vectors.
PARTS = 4

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(body: bytes, length: int) -> int:
    """The bits of the filters that look at one text alone."""
    words = body.split()
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * (len(body) - len(body.translate(None, CAPITALS))) > MOST_CAPITALS * length,
        len(body.translate(None, MARKS)) < len(body),
    )
    return sum(1 << k for k, x in enumerate(failed) if x)


class Chains:
    """Texts by fingerprint; under each the whole texts that have it, with their mask, smallest id and that id's rows by part."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def entry(self, mark: int, body: bytes, length: int | None = None, mask: int | None = None) -> list:
        chain = self.chains.setdefault(mark, [])
        for known in chain:
            if known[0] == body:
                return known
        chain.append([body, own_mask(body, length) if mask is None else mask, None, {}])
        self.held += len(body)
        return chain[-1]

    @staticmethod
    def add(entry: list, key, parts: Iterable[tuple[str, int]]) -> Iterator[tuple]:
        """Takes rows of an id into an entry; gives those that are settled as ``(id, part, mask, rows)``."""
        if key is None or entry[2] is not None and key > entry[2]:
            mask = entry[1] | (0 if key is None else COPY)
            yield from ((key, part, mask, n) for part, n in parts)
            return
        if key != entry[2]:
            if entry[2] is not None:
                yield from ((entry[2], part, entry[1] | COPY, n) for part, n in entry[3].items())
            entry[2], entry[3] = key, {}
        for part, n in parts:
            entry[3][part] = entry[3].get(part, 0) + n

    def drain(self) -> Iterator[tuple[int, list]]:
        """All entries with an id, and nothing is held any more."""
        for mark, chain in self.chains.items():
            yield from ((mark, x) for x in chain if x[2] is not None)
        self.chains, self.held = {}, 0


def _sent(held_bytes: int):
    """From ``id, text, part`` to what is routed: settled rows by the hash of their id, texts by theirs."""

    def run(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        own = Chains()
        for key, text, part in rows:
            text = text or ""
            body = text.encode("utf-8", "surrogatepass")
            entry = own.entry(xxhash.xxh64_intdigest(body), body, len(text))
            for done in own.add(entry, key, ((part, 1),)):
                yield xxhash.xxh64_intdigest(str(key)), done
            if own.held > held_bytes:
                yield from ((mark, (x[2], tuple(x[3].items()), x[1], 0, x[0])) for mark, x in own.drain())
        yield from ((mark, (x[2], tuple(x[3].items()), x[1], 0, x[0])) for mark, x in own.drain())

    return run


def _settled(routed: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """Of one receiving partition: each row's id, part and mask, with how many rows are alike."""
    own = Chains()
    for mark, (key, part, mask, n, *body) in routed:
        if not body:
            yield key, part, mask, n
        else:
            yield from own.add(own.entry(mark, body[0], mask=mask), key, part)
    for _, (_, mask, key, parts) in own.drain():
        yield from ((key, part, mask, n) for part, n in parts.items())


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", held_bytes: int = HELD_BYTES) -> RDD:
    """``(id, part, mask, rows)`` for all documents."""
    total = docs.agg(F.sum(F.octet_length(docs[text]))).head()[0] or 0
    rows = docs.select(docs[key], docs[text], F.coalesce(docs[part], F.lit(""))).rdd
    partitions = max(rows.getNumPartitions(), -(-total // HELD_BYTES))
    return rows.mapPartitions(_sent(held_bytes)).partitionBy(partitions, int).mapPartitions(_settled)


def _vector() -> np.ndarray:
    """Of a part: documents, good ones and toxic ones, by mask."""
    return np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)


def _counted(vector: np.ndarray, row: tuple[int, int, bool, bool]) -> np.ndarray:
    mask, n, good, toxic = row
    vector[:, mask] += (n, n * bool(good), n * bool(toxic))
    return vector


def lattice(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """All orders and steps of one part's vector."""
    mask = np.arange(vector.shape[1])
    docs, good, toxic = vector
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = mask & bit[f] > 0, mask & before > 0
            here = fails & ~gone
            before |= bit[f]
            removed = int(docs[here].sum())
            total[f] += removed
            rows.append((f, "".join(order), step, int(docs[mask & before == 0].sum()), removed, int(docs[fails & gone].sum()), int(docs[bit[f]]), int(good[here].sum()), int(toxic[here].sum())))
    for f, *row in rows:
        yield (part, *row, total[f])


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step; see the contract of the query for the counts."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    found = spark.createDataFrame(masks(docs, key, text, part), f"id {kind}, part string, mask int, n long", verifySchema=False)
    marked = labels.groupBy(labels[key].alias("id")).agg(F.max(labels["quality"] == 1).alias("good"), F.max(labels["toxic"] == 1).alias("toxic")).filter("good or toxic")
    rows = found.join(marked, "id", "left").select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], r[1:]))
    merged = rows.combineByKey(lambda r: _counted(_vector(), r), _counted, np.add, numPartitions=PARTS)
    return spark.createDataFrame(merged.flatMap(lambda x: lattice(*x)), RESULT, verifySchema=False)
