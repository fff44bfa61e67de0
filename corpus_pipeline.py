"""A corpus pipeline: junk out, near-duplicates out, repeated passages out, then packed into windows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebook.llm.common import read
from sievebook.llm.minhash import judged
from sievebook.llm.packing import pack
from sievebook.llm.quality import keep_good
from sievebook.llm.suffixes import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id. Rows without id or words stay, and of rows that repeat an id those whose text is no duplicate."""
    found = judged(docs, k=5, percent=80).where("kept and doc_id is not null")
    held = docs.where("doc_id is not null")
    if held.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = held.join(found.select("doc_id"), "doc_id", "left_semi")
    else:
        # Of a group's rows with the smallest id one stays; wordless texts are in no group.
        one = found.where("label is not null").groupBy("doc_id", "label").agg(F.min("mark").alias("mark")).select("doc_id", "mark")
        none = found.where("label is null").select("doc_id", "mark").distinct()
        marked = held.withColumn("mark", F.xxhash64("text"))
        out = marked.join(one, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]).unionByName(marked.join(none, ["doc_id", "mark"], "left_semi")).drop("mark")
    return out.unionByName(docs.where("doc_id is null").select(*out.columns)).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of fifty or more words that a document with a smaller id has too."""
    return without_repeats(docs, threshold=50)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("packing", packing)]
#: The stages cannot be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
