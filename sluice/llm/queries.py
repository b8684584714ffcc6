"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.common import ship
from sluice.llm.byte_repeats import byte_repeat_digests
from sluice.llm.decontaminate import leaks
from sluice.llm.html_text import main_texts
from sluice.llm.lm_score import lm_scores
from sluice.llm.packing import pack_documents
from sluice.llm.quality import quality, quality_sql
from sluice.llm.simhash import near_duplicates
from sluice.llm.token_files import token_file_digests
from sluice.llm.tokens import default_path
from sluice.llm.toxicity import toxicity
from sluice.llm.word_repeats import word_repeat_digests


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).drop("posterior")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_repeat_digests(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeat_digests(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(_table(spark, sf_dir, "documents"), default_path(), end_id=2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), default_path(), end_id=1, length=2048, keep=800_000)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_lm_score, op3_simhash, op4_substrings, op5_html_text, op6_decontamination, op7_suffixes, op8_token_files, op9_packing, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality_sql()}
