"""A training corpus from documents: five stages, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, line_chunks, minhash, pieces, simhash, toxicity
from ledgerline.llm.common import cut, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. The model learns from the documents at hand that have labels.

    Null and empty texts stay; repeated rows stay or go together; without labels the prior weights decide.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that an earlier document, or an earlier place, has.

    Null texts and null ids stay as they are; a text may become empty, its document stays; rows that
    repeat an id and text lose the same lines.
    """
    return line_chunks.dedup(docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest by doc_id and text, of each group of fingerprints within two bits.

    Null and empty texts are one group, of which one stays; null ids stay; other texts under an id stay.
    """
    return simhash.keep_one(docs)


def similar_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, then of each group with a five-word Jaccard of 0.8 or more.

    Null and wordless texts take no part in the second; null ids stay in both.
    """
    return minhash.keep_one(cut(near_duplicates_out(spark, docs, sf_dir), "near-duplicates-out"))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts stay; without items all stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, n_tokens, n_byte_tokens and round_trip of each document; null and empty texts have no tokens."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", repeated_lines_out),
    ("simhash_near_dedup", similar_out),
    ("benchmark_decontamination", benchmark_out),
    ("sentencepiece", encoded),
]

#: Stage 1's model is fitted iteratively, which SQL can't express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
