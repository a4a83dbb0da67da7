"""Quality rules, line dedup, n-gram join against brute force on small tables with nulls, ties and clashing names."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from heddle.llm import line_dedup, mixing, ngram_join, quality, sharding
from heddle.llm.common import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, _row int, _all string, position string"


def words(n, seed):
    import random

    r = random.Random(seed)
    return [r.choice("ab cd efg hi jkl mno pq rst uvw xyz lorem ipsum dolor sit amet".split()) + str(r.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, names that the operators use themselves."""
    base = " ".join(words(60, 1))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", None, "b"), (4, None, "en", None), (5, "", "de", "a"), (None, "a b c", None, None),
        (6, "\n".join([" ".join(words(12, k)) for k in range(9)] + ["short one", ""]), "en", "a"), (7, "### *** $$$ " * 30, "en", "a"), (8, " ".join(words(30_000, 5)), "en", "a"), (9, "x" * 50_000, "de", "b"), (10, "one two three", "en", "a"), (11, "one two three", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, 1, "x", "p") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def measures(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, sf_dir):
    for docs in (odd.limit(100), load(spark, sf_dir, "documents")):
        texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()), key=str)
        got = sorted(((r.doc_id is None, r.doc_id or 0, r) for r in quality.judge(docs).collect()), key=lambda x: x[:2])
        want = sorted(((a, b, measures(t)) for a, b, t in texts), key=lambda x: x[:2])
        assert [(a, b, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for a, b, r in got] == want
        for _, _, r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_quality_keeps_good_and_rejects_bad(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in load(spark, sf_dir, "labels").filter("toxic = 0").collect()}
    kept = {r.doc_id: r.kept or r.base_failed for r in quality.judge(load(spark, sf_dir, "documents")).collect()}
    good = [kept[i] for i, q in labels.items() if q == 1]
    assert sum(good) >= 0.95 * len(good)


def test_sketches_merge(spark, sf_dir):
    rules = quality.Rules()
    m = quality.measured(load(spark, sf_dir, "documents"))
    whole = quality.sketches(m, rules, "lang", "source")
    parts = quality.merge(quality.sketches(m.filter("doc_id % 2 = 0"), rules, "lang", "source"), quality.sketches(m.filter("doc_id % 2 = 1"), rules, "lang", "source"))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_quality_odd_tables(odd, empty):
    assert quality.judge(empty).count() == 0 and quality.keep(empty).columns == empty.columns
    kept = quality.keep(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(odd).filter("kept").collect()}


def shingles(line, k=8):
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def test_near_lines_go_and_others_stay(spark):
    lines = [" ".join(words(40, i)) for i in range(60)]
    near = [x.replace(x.split()[20], "changed", 1) for x in lines[:20]]
    docs = spark.createDataFrame([(i, x + "\nown text of document number " + str(i) + " " + " ".join(words(9, 500 + i))) for i, x in enumerate(lines + near)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    for i, (a, b) in enumerate(zip(lines, near, strict=False)):
        alike = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert got[i].n_removed == 0
        if alike >= 0.8:
            assert got[60 + i].n_removed == 1 and got[60 + i].text.startswith("own text"), alike
    assert all(got[i].n_removed == 0 for i in range(60))


def test_variants_of_one_line_go(spark):
    """Each variant is alike to the original alone, whichever line a bucket compares with the others."""
    import random

    for n in (10, 100, 1000):
        r = random.Random(n)
        word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
        original = [word() for _ in range(30)]
        lines = [" ".join(original)]
        for i in range(n):
            lines.append(" ".join(word() if k == i % 28 + 1 else w for k, w in enumerate(original)))
        assert all(len(shingles(lines[0]) & shingles(x)) / len(shingles(lines[0]) | shingles(x)) >= 0.8 for x in lines[1:])
        assert len(shingles(lines[1]) & shingles(lines[4])) / len(shingles(lines[1]) | shingles(lines[4])) < 0.8
        docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(docs, counts=True).collect()}
        assert got == {i: int(i > 0) for i in range(n + 1)}


def test_long_lines_without_spaces_meet(spark):
    """Near copies of over 120 bytes: rows divided by tabs that differ in front, and five long words that differ where each begins."""
    import random

    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = []
    for i in range(30):
        tail = "\t".join(word(7) for _ in range(25))
        pairs.append((f"{i:08d}\t{tail}", f"{i + 50:08d}\t{tail}"))
        long = [word(60) for _ in range(5)]
        pairs.append((" ".join(long), " ".join(word(1) + x[1:] for x in long)))
    pairs = [(a, b) for a, b in pairs if a != b]
    assert all(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8 for a, b in pairs)
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert got == {i: i % 2 for i in range(2 * len(pairs))}


def test_equal_lines_keep_their_first(spark, odd, empty):
    rows = [(3, "this very line is here many times\nb"), (1, "this very line is here many times\n\nshort"), (2, "  this very line is here many times "), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=str) == [(1, "this very line is here many times\n\nshort"), (2, None), (3, "b")]
    assert line_dedup.dedup_lines(empty).columns == empty.columns and line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(odd, counts=True)
    assert out.count() == odd.count()
    assert sum(r.n_removed for r in out.filter("doc_id = 2").collect()) == 2


def test_lines_meet_without_python_workers(spark, monkeypatch):
    """Against all pairs, by DataFrame operations alone, with large buckets dealt by salts and with bands that go round."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz\u00e9\U0001f600") for _ in range(6))
    lines = []
    for n in (5, 6, 12, 30, 60):
        original = [word() for _ in range(n)]
        for _ in range(24):
            lines.append(" ".join(word() if r.random() < 1.5 / n else w for w in original))
    lines += ["a b c d e", "a b c d f", "a a a a a a a a a a a a a a a a", "a a a a a a a a a a a a a a a a a a", "\t".join("ab" * 20)]
    lines.append(lines[30] + " " + lines[30])
    group = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            a, b = shingles(x), shingles(lines[j])
            if 100 * len(a & b) >= 80 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    want = {i: int(g in group[:i]) for i, g in enumerate(group)}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")

    def refused(*_):
        raise AssertionError("runs in Python workers")

    for owner, names in ((type(docs), ("mapInArrow", "mapInPandas")), (type(docs.groupBy()), ("applyInPandas", "applyInArrow"))):
        for name in names:
            monkeypatch.setattr(owner, name, refused)
    for run, near in ((1_000, 9), (3, 4)):
        monkeypatch.setattr(line_dedup, "BUCKET_RUN", run)
        monkeypatch.setattr(line_dedup, "NEAR", near)
        assert {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(docs, counts=True).collect()} == want


def brute(rows):
    sets, inverse, parent, links = [], defaultdict(list), {}, 0
    for _, text in rows:
        w = [x.lower() if x.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in inverse[g])
        for j, o in both.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                links += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            inverse[g].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))], links


def test_join_is_brute_force(spark, odd, sf_dir, tmp_path):
    chain = words(100, 77)
    made = [(1000 + i, " ".join(chain[: 100 - i] + words(i, i))) for i in range(0, 60, 2)] + [(2000 + i, " ".join(words(50, 9) + words(i % 7, i))) for i in range(80)]
    spark.createDataFrame(made, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "made"))
    for docs in (odd, spark.read.parquet(str(tmp_path / "made")), load(spark, sf_dir, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want, _ = brute(rows)
        got = [tuple(r) for r in ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_join_does_not_depend_on_blocks(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    a = ngram_join.join(docs).collect()
    b = ngram_join.join(docs, ngram_join.Join(block_entries=2_000)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_keep_first(odd, empty):
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) == 0 and 1 in ids and 4 in ids and 5 in ids and (10 in ids) != (11 in ids)
    assert ngram_join.keep_first(empty).count() == 0


def test_schedule_stays_within_a_block():
    blocks = {"a": 500, "b": 120, "c": 37, "d": 1}
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    rows = mixing.schedule(blocks, weights, 200)
    at = {}
    for k, first, last, parts, turn, offset, slot in rows:
        for b in range(first + turn, last, parts):
            at[k, b] = slot + offset + 200 * ((b - first) // parts)
    assert len(at) == sum(blocks.values()) and sorted(at.values()) == list(range(len(at)))
    order = [k for (k, _), _ in sorted(at.items(), key=lambda x: x[1])]
    done, live, base, start = Counter(), set(blocks), Counter(), 0
    share = mixing.parts(weights, 200)
    for now, k in enumerate(order, 1):
        done[k] += 1
        for s in live:
            assert abs(done[s] - base[s] - share[s] / 200 * (now - start)) < 1
        if done[k] == blocks[k]:
            live.discard(k)
            base, start = Counter(done), now
            share = mixing.parts({s: weights[s] for s in live}, 200) if live else {}


def test_schedule_keeps_to_the_target_weights():
    """Within less than a block of the weights given, over many times 1000 slots and for many sources."""
    many = {f"s{i:03d}": 1 + i % 7 for i in range(150)}
    for weights, n in (({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.0495, "e": 0.0005}, 60_000), (many, 20_000), ({f"q{i}": (i + 1) ** 0.5 for i in range(9)}, 30_000)):
        total = sum(weights.values())
        rows = mixing.schedule(dict.fromkeys(weights, n), weights, 1000)
        at = {slot + offset + 1000 * ((b - first) // parts): k for k, first, last, parts, turn, offset, slot in rows for b in range(first + turn, last, parts) if b < n}
        assert sorted(at) == list(range(n * len(weights)))
        done = Counter()
        for now in range(1, n + 1):  # no source can have run out
            done[at[now - 1]] += 1
            k = at[now - 1]
            assert abs(done[k] - weights[k] / total * now) < 1
            if now % 997 == 0:
                assert all(abs(done[k] - w / total * now) < 1 for k, w in weights.items())


def test_mix_keeps_many_sources_apart(spark):
    """Over 100 sources: each has its own blocks and its own weight."""
    docs = spark.createDataFrame([(120 * j + i, f"s{i:03d}") for i in range(120) for j in range(20)], "doc_id long, source string")
    weights = {f"s{i:03d}": 5.0 if i == 119 else 1.0 for i in range(120)}
    got = mixing.mixed(docs, mixing.Mix(weights=weights, block_rows=2)).collect()
    assert sorted(r.position for r in got) == list(range(2400))
    block = defaultdict(set)
    for r in got:
        block[r.slot].add(r.source)
    assert all(len(s) == 1 for s in block.values())
    assert sum("s119" in block[i] for i in range(124)) == 5


def test_mix_places_every_row_once(spark, odd, empty):
    got = mixing.mixed(odd, mixing.Mix(block_rows=2, period=20)).collect()
    assert len(got) == odd.count() and len({r.position_ for r in got}) == len(got) and {r.position for r in got} == {"p"}
    assert mixing.mixed(empty).count() == 0
    few = mixing.mixed(odd, mixing.Mix(block_rows=1, period=10, most_sources=2))
    assert len({r.position_ for r in few.collect()}) == odd.count()
    assert mixing.mixed(odd).columns == [*odd.columns, "block", "slot", "position_"]
    assert mixing.new_names(odd.withColumn("Block", odd["lang"]).withColumn("block_", odd["lang"])) == {"block": "block__", "slot": "slot", "position": "position_"}


def test_blocks_grow_so_that_slots_have_a_bound(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "cast(id % 3 as string) as source")
    got = mixing.mixed(docs, mixing.Mix(block_rows=2, most_slots=40)).collect()
    assert len({r.slot for r in got}) <= 40 + 3 and len({r.position for r in got}) == 1000


def test_shards(spark, odd, empty, sf_dir):
    docs = load(spark, sf_dir, "documents")
    got = sharding.sharded(docs).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(size.values()) - min(size.values()) <= 0.02 * max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in got:
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    import zlib

    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) and r.size == len(r.text.encode()) + 1 for r in got)
    assert sharding.sharded(empty).count() == 0 and sharding.sharded(odd).count() == odd.count()
    clash = odd.withColumn("size", odd["lang"]).withColumn("shard", odd["lang"])
    named = sharding.sharded(clash)
    assert named.columns == [*clash.columns, "size_", "text_crc32", "shard_", "slot", "law", "grown_shard"]
    assert sorted((str(r["size"]), str(r["shard"])) for r in named.collect()) == sorted((str(r["lang"]),) * 2 for r in odd.collect())


def test_a_group_larger_than_a_shard_is_dealt(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 600 else f"text {i}") for i in range(1000)], "doc_id long, text string")
    n = Counter(r.shard for r in sharding.sharded(docs).collect())
    assert len(n) == 8 and max(n.values()) < 200


def test_small_graphs_take_few_tasks(spark):
    """A round of components is not dealt over all of the session's partitions when it has a handful of edges."""
    from heddle.llm.graph import components

    tracker, names = spark.sparkContext.statusTracker(), ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("211", "false"), strict=True):
            spark.conf.set(n, v)
        pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 40)], "a long, b long").coalesce(1)
        spark.sparkContext.setJobGroup("few-tasks", "components")
        got = {r.node: r.component for r in components(pairs, "a", "b").collect()}
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few-tasks")]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(40)}
    stages = [tracker.getStageInfo(k) for k in {k for j in jobs for k in j.stageIds}]
    rounds = sum(x.name.startswith("checkpoint") for x in stages if x)
    assert rounds > 2 and sum(x.numCompletedTasks for x in stages if x) < 211 * 3 * rounds


def test_bands_are_the_smallest_hashes_above_their_bounds(spark):
    """Also of lines with fewer different shingles than a band has rows, and of ones that repeat themselves."""
    from pyspark.sql import functions as F

    how = line_dedup.Likeness()
    lines = ["a b c d e", "ha " * 40 + "x y", "a b c d ef", " ".join(words(40, 1)), "z" * 300 + " b c d e f", "\U0001f600 b c d e f g"]
    rows = line_dedup._with_bands(spark.createDataFrame([(x,) for x in lines], "_line string"), how).withColumn("h", line_dedup.shingles(F.col("_line"), how))
    bounds = [-(2**63) + (2**64 // how.bands) * j for j in range(how.bands)]
    for r in rows.collect():
        h = sorted(set(r.h))
        want = [sorted(h, key=lambda x: (x - b) % 2**64)[: how.rows] for b in bounds]
        picked = spark.createDataFrame([(j, w) for j, w in enumerate(want)], "j int, w array<bigint>").select("j", F.xxhash64("j", "w").alias("x")).collect()
        assert [x.x for x in sorted(picked)] == r._bands, r._line
