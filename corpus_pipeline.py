"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage works on all that the stage before kept and returns the columns of documents; the last returns what op6 returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import bpe_chunks, decontaminate, line_quality, simhash, suffix_dedup
from docquarry.llm.queries import tokenizer_path
from docquarry.session import Scratch, table

#: Bytes of a repeated passage: what 51 words of 3.7 letters and a blank take.
PASSAGE_BYTES = 240


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that are common on their host go from the rest."""
    return line_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_BYTES and more that stand earlier too are cut out; the first of each stays."""
    return suffix_dedup.cut_repeats(docs, PASSAGE_BYTES, keep_first=True)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as digests."""
    return bpe_chunks.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: The stages hash, merge and tokenize in ways that SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(name, docs)
    return docs
