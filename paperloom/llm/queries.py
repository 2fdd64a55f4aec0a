"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .jpeg import media_digests
from . import linerules, pfair
from .katz import language_model_scores
from .minhash import near_duplicates
from .nbsvm import quality_scores
from .pfair import mixed
from .pii import personal_data
from .pieces import sample_pieces
from .store import documents
from .tokencount import token_counts
from .warc import archive_digests

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2, percent=80)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(spark.read.parquet(f"{sf_dir}/pages.parquet"), at_least=0)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.line_quality(documents(spark, sf_dir))


def op5_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), arrays=False)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), limit=2048)


def op8_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_minhash, op2_katz, op3_warc, op4_lines, op5_nbsvm, op6_pieces, op7_tokens, op8_pfair, op9_pii, op10_jpeg)}
ORACLE_SQL: dict[str, str] = {"op4_lines": linerules.ORACLE, "op8_pfair": pfair.ORACLE}
