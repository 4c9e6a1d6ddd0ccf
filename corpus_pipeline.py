"""A corpus pipeline of the training-data operators: quality rules, line dedup, near-duplicate removal, source mixing,
packing. Every stage reads what its predecessor wrote, and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from evalspark.llm.queries import tokenizer_file
from evalspark.llm.shared import work_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of windows that came before."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in training sequences, ids included."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Token ids are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
