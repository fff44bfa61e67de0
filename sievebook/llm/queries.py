"""Registered queries of the corpus operators, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_decode
from .common import read
from .fingerprint import fingerprints
from .licenses import license_scan
from .minhash import near_duplicates
from .neighbours import nearest
from .packing import pack
from .quality import judge as judge_quality
from .suffixes import remove_repeats
from .urls import judge as judge_urls
from .warc import archive_pages


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op4_quality_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"), least=0)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op10_suffix_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), threshold=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe_transducer": op2_bpe_transducer,
    "op3_weighted_fingerprints": op3_weighted_fingerprints,
    "op4_quality_weak_labels": op4_quality_weak_labels,
    "op5_projection_forest": op5_projection_forest,
    "op6_nnls_packing": op6_nnls_packing,
    "op7_license_automaton": op7_license_automaton,
    "op8_warc_chunks": op8_warc_chunks,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_suffix_radix_dedup": op10_suffix_radix_dedup,
}
ORACLES: dict[str, str] = {}
