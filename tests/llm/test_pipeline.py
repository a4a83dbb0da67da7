"""The pipeline, stage by stage, against plain versions of its stages on a small table."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from heddle.llm import encoding, quality
from heddle.llm.common import load
from tests.llm.test_text_operators import SCHEMA, brute, odd  # noqa: F401


def plain_lines(rows):
    """Line dedup without candidates: every pair of long lines by the shingles of eight characters."""
    from heddle.llm.line_dedup import WORD

    import re

    seen, parent = [], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for at, (_, text) in enumerate(rows):
        for pos, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if len(re.findall(WORD + "+", line)) >= 5:
                where[line].append((at, pos))
    inverse = defaultdict(list)
    for line in where:
        s = {line[i : i + 8] for i in range(len(line) - 7)} or {line}
        both = Counter(j for g in s for j in inverse[g])
        for j, o in both.items():
            if 100 * o >= 80 * (len(s) + len(seen[j][1]) - o):
                a, b = find(line), find(seen[j][0])
                parent[a] = b
        for g in s:
            inverse[g].append(len(seen))
        seen.append((line, s))
    groups = defaultdict(list)
    for line, places in where.items():
        groups[find(line)] += places
    return [sorted(p) for p in groups.values() if len(p) > 1]


def test_stages(spark, sf_dir, tmp_path):
    docs = load(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mix_sources", "sentencepiece"]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept.append((before, docs))
        if i < 4:
            assert docs.columns == before.columns
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]

    good = {r.doc_id for r in quality.judge(kept[0][0]).filter("kept").collect()}
    assert {i for i, _ in rows(kept[0][1])} == good

    before, after = sorted(rows(kept[1][0])), dict(rows(kept[1][1]))
    gone = sum(len(g) - 1 for g in plain_lines(before))
    removed = sum(len(t.split("\n")) - len(after[i].split("\n")) if i in after else sum(len(x.split()) >= 5 for x in t.split("\n")) for i, t in before)
    assert abs(removed - gone) <= 0.02 * gone + 1

    want, _ = brute(rows(kept[2][0]))
    assert {i for i, _ in rows(kept[2][1])} == {i for i, n, c in want if i == c or not n}

    assert sorted(rows(kept[3][0])) == sorted(rows(kept[3][1]))

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=encoding.MODEL)
    text = dict(rows(kept[4][0]))
    got = kept[4][1].collect()
    assert len(got) == len(text) and all(r.round_trip and r.token_ids == lib.encode(text[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in got)


def test_order_of_the_mix_survives_files(spark, sf_dir, tmp_path):
    """Over several part files of different sizes, which Spark reads largest first."""
    from heddle.llm import mixing

    docs = load(spark, sf_dir, "documents")
    rows = [(r.doc_id, "x y z " * (1 + 7 * r.doc_id % 400), r.lang, r.source) for r in docs.collect()] + [(10_000 + i, f"short {i}", "en", f"s{i % 3}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("position").collect()]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus_pipeline.mix_sources(spark, docs, sf_dir).write.parquet(str(tmp_path / "mix"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(list((tmp_path / "mix").glob("part-*"))) > 1
    again = spark.read.parquet(str(tmp_path / "mix"))
    assert [r.doc_id for r in corpus_pipeline.encode_pieces(spark, again, sf_dir).collect()] == want
    corpus_pipeline.encode_pieces(spark, again, sf_dir).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r.doc_id for r in corpus_pipeline.as_written(out).collect()] == want


def test_pipeline_takes_odd_rows(spark, odd, tmp_path):  # noqa: F811
    for name, table in (("odd", odd), ("none", spark.createDataFrame([], SCHEMA))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip"]
        assert out.filter("not round_trip").count() == 0
