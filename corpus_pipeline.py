"""A training corpus from raw documents: rules, near-dedup, long repeats, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curio.llm import mixing, packing, rules, runindex, simhash
from curio.llm.common import cut_table, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the adaptive quality rules keep."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings of 200 bytes that occur elsewhere."""
    return runindex.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of the sources takes them."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("long_repeats", long_repeats),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Signatures, index and tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
