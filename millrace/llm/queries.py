"""Queries and oracle SQL of the corpus operators, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op7_byte_bpe
from .decontaminate import OP9_SQL, op9_decontamination
from .exact_topk import OP6_SQL, op6_exact_topk
from .html_extract import op4_html_extraction
from .jaccard_join import OP10_SQL, op10_ngram_jaccard_join
from .language_id import op1_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .pii import op2_pii
from .secret_scan import op5_secret_scan
from .toxicity import op8_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_pii": op2_pii,
        "op3_line_dedup": op3_line_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_secret_scan": op5_secret_scan,
        "op6_exact_topk": op6_exact_topk,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_toxicity": op8_toxicity,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": OP3_SQL,
        "op6_exact_topk": OP6_SQL,
        "op9_decontamination": OP9_SQL,
        "op10_ngram_jaccard_join": OP10_SQL,
    }
