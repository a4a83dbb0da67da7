"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import divergence, encoding, filter_audit, language, line_dedup, matroska, mixing, ngram_join, quality, sharding, simhash, site_style, toxicity
from heddle.llm.common import load
from heddle.llm.oracles import ORACLES


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(load(spark, sf_dir, "pages"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.store(load(spark, sf_dir, "documents")))


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(load(spark, sf_dir, "documents"), keep=("doc_id",))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(load(spark, sf_dir, "documents"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(load(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.sharded(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
