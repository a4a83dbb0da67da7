"""Filter audit, SimHash and source divergence against brute force, on small tables with every odd case and on the given documents."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import pytest
import xxhash

from heddle.llm import divergence, filter_audit, simhash
from heddle.llm.common import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, part string, id int, mask int, fp string, term string, n string, zero int"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("ab cd efg hi jkl mno pq rst uvw xyz lorem ipsum dolor sit amet été".split()) + r.choice(["", "x", "yy", ",", "é"]) for _ in range(n))


def odd_rows():
    long = prose(30_000, 5)
    return [
        (1, prose(120, 1), "en", "a"), (2, prose(120, 1), "en", "b"), (2, prose(120, 1), "en", "b"), (2, prose(120, 1), "de", "b"), (3, "A" * 40 + " # b", None, None),
        (4, None, "en", None), (5, "", "de", "a"), (None, None, None, "a"), (None, prose(120, 1), "en", "a"), (6, long, "en", "a"), (7, long.upper(), "en", "a"),
        (8, "one two", "en", "a"), (9, "ONE\ttwo", "", ""), (10, " \n ", "en", "c"), (11, "x" * 50_000, "de", "b"), (0, prose(120, 1), "fr", "b"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", "n", 0) for r in odd_rows()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, odd, empty, sf_dir):
    """Each table with its rows as tuples of id, text, language and source."""
    return [(t, [(r.doc_id, r.text, r.lang, r.source) for r in t.collect()]) for t in (odd, empty, load(spark, sf_dir, "documents"))]


def audited(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, total, made = [d for d in docs if d[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [d for d in mine if f in d[1] and not d[1] & before]
                total[f] += len(here)
                made.append((f, "".join(order), k + 1, sum(not d[1] & (before | {f}) for d in mine), len(here), sum(f in d[1] and bool(d[1] & before) for d in mine), sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)))
        out += [(part, *m[1:], total[m[0]]) for m in made]
    return sorted(out)


def test_audit_is_that_of_brute_force(spark, tables, sf_dir):
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    more = labels.union(spark.createDataFrame([(2, 1, 0), (2, 0, 1), (4, 1, 1), (None, 1, 1), (3, None, 1)], labels.schema))
    for docs, rows in tables:
        got = filter_audit.audit(docs, more)
        assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
        assert sorted(map(tuple, got.collect())) == audited(rows, [tuple(r) for r in more.collect()])


def test_masks_are_the_same_when_little_is_held(tables):
    """Texts that go on early meet again where they are routed to, and two texts with one fingerprint stay two."""
    for docs, _ in tables:
        whole, small = (Counter({k: 0}) for k in (0, 0))
        for counts, held in ((whole, filter_audit.HELD_BYTES), (small, 1)):
            for *what, n in filter_audit.masks(docs.repartition(3), held_bytes=held).collect():
                counts[tuple(what)] += n
        assert whole == small
    own = filter_audit.Chains()
    assert list(own.add(own.entry(7, b"a", 1), 1, (("", 1),))) == list(own.add(own.entry(7, b"b", 1), 2, (("", 1),))) == []
    assert len(own.chains[7]) == 2


def test_a_group_of_copies_is_sent_once_a_task(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "repeat('same text ', 30) as text", "'en' as lang").repartition(4)
    sent = rows.rdd.mapPartitions(lambda x: filter_audit._sent(filter_audit.HELD_BYTES)((r.doc_id, r.text, r.lang) for r in x))
    assert sent.filter(lambda x: len(x[1]) == 5).count() == 4
    assert filter_audit.masks(rows).map(lambda x: (x[2] & filter_audit.COPY > 0, x[3])).reduceByKey(int.__add__).collectAsMap() == {True: 19_999, False: 1}


def print_of(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_of(prints):
    """For each distinct fingerprint the least fingerprint that it reaches."""
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(sorted(parent), 2):
        if (x ^ y).bit_count() <= 3:
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return {p: root(p) for p in parent}


def test_simhash_is_that_of_brute_force(tables):
    for docs, rows in tables:
        prints = [print_of(t) for _, t, *_ in rows]
        part, least = component_of(set(prints)), {}
        for (i, *_), p in zip(rows, prints, strict=True):
            if i is not None:
                least[part[p]] = min(i, least.get(part[p], i))
        got = simhash.near_duplicates(docs)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, f"{p:016x}", least.get(part[p])) for (i, *_), p in zip(rows, prints, strict=True)), key=str)


def test_spark_has_the_same_hash(spark):
    from pyspark.sql import functions as F

    for t in ("a b c", "été x y", "q" * 40):
        assert spark.range(1).select(F.xxhash64(F.lit(t))).head()[0] % 2**64 == xxhash.xxh64_intdigest(t.encode(), 42)


@pytest.mark.parametrize("most_rows", [4096, 300, 20])
def test_no_link_is_lost_however_often_keys_are_cut(spark, most_rows):
    """Clusters around a few centres, chains, and fingerprints that share 52 bits, so that keys are cut to the last."""
    r = random.Random(most_rows)
    made = {r.getrandbits(64) for _ in range(200)}
    for c in (r.getrandbits(64), 0, 2**64 - 1):
        made |= {c ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 4]))) for _ in range(250)}
    x = r.getrandbits(64)
    for _ in range(100):
        x ^= sum(1 << b for b in r.sample(range(64), 3))
        made.add(x)
    top = r.getrandbits(52) << 12
    made |= {top | k for k in r.sample(range(4096), 400)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in made], "fp long")
    how = simhash.Near(most_rows=most_rows)
    edges = simhash.close_pairs(df, how).collect()
    assert all((e.x ^ e.y).bit_count() <= 3 if (e.x < 0) == (e.y < 0) else ((e.x ^ e.y) % 2**64).bit_count() <= 3 for e in edges)
    from heddle.llm.graph import components

    got = {r.node % 2**64: r.component % 2**64 for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for p, c in component_of(made).items():
        want[c].add(p)
        groups[got.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_cut_fixes_each_free_bit_once():
    for mask in (0, 0xFFFF, 0xF0F0F0F0F0F0F0F0, simhash.FULL ^ 0b11111):
        new = [m ^ mask for m in simhash.cut(mask, 4)]
        assert sum(new) == simhash.FULL ^ mask and all(a & b == 0 for a, b in combinations(new, 2))


def diverging(rows, least):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(t or "")]) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, w in mine:
            counts[source].update(x for x in w if df[x] >= least)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q = share(sum(counts.values(), Counter()))
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = sorted(((sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][w] - q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:50]
            out += [(lang, s, part, item, value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 30])
def test_divergence_is_that_of_brute_force(tables, least):
    for docs, rows in tables:
        got = divergence.audit(docs, divergence.Audit(least_documents=least))
        assert got.columns == "lang source part item value rank".split()
        assert sorted(map(tuple, got.collect())) == diverging(rows, least)


def test_counts_sent_early_add_up(tables, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    docs, rows = tables[0]
    assert sorted(map(tuple, divergence.audit(docs, divergence.Audit(least_documents=2)).collect())) == diverging(rows, 2)


def test_shares_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, big + 10)], "n long, of long").select(divergence._share("n", "of", divergence.Audit())).head()
    assert row[0] == 1 + 10**9 * (big + 5) // (big + 10)


@pytest.mark.parametrize("name", ["op3_adaptive_quality", "op11_filter_audit", "op13_source_divergence"])
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    from heddle.llm import registry

    got = registry.queries()[name](spark, sf_dir)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)
