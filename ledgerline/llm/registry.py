"""The queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, dialogues, language, licenses, line_chunks, packing, pieces, quality, rules, simhash, token_counts, toxicity, vector_codes
from ledgerline.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": lambda s, d: decontaminate.hits(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_sentencepiece": lambda s, d: pieces.query(table(s, d, "documents")),
        "op3_language_id": lambda s, d: language.query(table(s, d, "documents")),
        "op4_license_scan": lambda s, d: licenses.query(table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
        "op6_quality": lambda s, d: quality.query(table(s, d, "documents"), table(s, d, "labels")),
        "op7_token_counts": lambda s, d: token_counts.count_tokens(table(s, d, "documents")),
        "op8_line_dedup": lambda s, d: line_chunks.query(table(s, d, "documents")),
        "op9_quality_rules": lambda s, d: rules.cascade(table(s, d, "documents")),
        "op10_simhash": lambda s, d: simhash.query(table(s, d, "documents")),
        "op11_packing": lambda s, d: packing.query(table(s, d, "documents")),
        "op12_dialogue_repair": lambda s, d: dialogues.query(table(s, d, "conversations")),
        "op13_vector_codes": lambda s, d: vector_codes.query(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scan": licenses.oracle(),
        "op8_line_dedup": line_chunks.ORACLE,
        "op9_quality_rules": rules.ORACLE,
        "op12_dialogue_repair": dialogues.ORACLE,
        "op13_vector_codes": vector_codes.oracle(),
    }
