"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.exponion import CLUSTER_SQL
from quillspan.llm.infill import INFILL_SQL
from quillspan.llm.oracles import LEAKS_SQL, NEAR_SQL
from quillspan.llm.rules import RULES_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocab_path() -> str:
    """The public byte-level vocabulary installed beside the tokenizers library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.langid import language_report

    return language_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.chunking import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.sharding import shard_report

    return shard_report(_table(spark, sf_dir, "documents"), shards=16)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.fmindex import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.media import media_report

    return media_report(_table(spark, sf_dir, "documents"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.chat import chat_report

    return chat_report(_table(spark, sf_dir, "conversations"), budget=512, history=128)


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.extraction import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), vocab_path())


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.rules import rules_report

    return rules_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.exponion import cluster_report

    return cluster_report(_table(spark, sf_dir, "embeddings"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.infill import infill_report

    return infill_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_media": op7_media,
    "op8_chat_windows": op8_chat_windows,
    "op9_extraction": op9_extraction,
    "op10_bpe": op10_bpe,
    "op11_quality_rules": op11_quality_rules,
    "op12_exponion": op12_exponion,
    "op13_infill": op13_infill,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": NEAR_SQL,
    "op5_decontamination": LEAKS_SQL,
    "op11_quality_rules": RULES_SQL,
    "op12_exponion": CLUSTER_SQL,
    "op13_infill": INFILL_SQL,
}
