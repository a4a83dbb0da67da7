"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, mixing, encoding.

Each stage takes the documents that the one before kept. Between stages they lie as Parquet in the shared
folder of ``spark.checkpoint.dir``, so a lost executor costs no more than its own tasks.

The mixing stage decides about order alone, which Spark does not keep when it reads files: it packs them by size.
So the last stage sorts by where the mixing stage has written a row, its part file and its place in that, and
returns rows in the order of the mix.

Defined results: documents with a null or empty text, or fewer words than the base rule asks for, go in the first stage;
repeated rows are separate documents until the third, which keeps one of each group of near copies; null languages and
sources are groups of their own; texts of any length are read whole; an empty table gives an empty one with the same
columns; all stages but the last return the columns they got, others than those of ``documents`` too, and the last one the
ids, language and source with the tokens. The tables between stages stay in the shared folder until it is emptied,
since the last stage reads the one before when its rows are asked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import encoding, line_dedup, mixing, ngram_join, quality
from heddle.llm.common import load, shared_folder

#: No SQL for signatures, components and token ids: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the thresholds of their language and source."""
    return quality.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has."""
    return line_dedup.dedup_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which blocks of their sources are to be read."""
    return mixing.mixed(docs).orderBy(mixing.new_names(docs)["position"]).select(*docs.columns)


def as_written(docs: DataFrame) -> DataFrame:
    """The rows of files that Spark has written, in the order in which they were written.

    Part files are numbered in the order of the written partitions. Fails on rows that come from no file, which have no such order.
    """
    place = F.struct(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("part"), "_metadata.file_name", "_metadata.row_index")
    placed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"), place.alias("_place"))
    return placed.orderBy("_place").select("_all.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the result of decoding them again, in the order of the mix."""
    return encoding.encoded(as_written(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shared = shared_folder(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
