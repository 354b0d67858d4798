"""Queries of this folder, by name, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Each module is named as its query.
OPERATORS = (
    "op1_reshard",
    "op2_ngram_jaccard",
    "op3_token_counts",
    "op4_warc_bundles",
    "op5_bpe_codec",
    "op6_html_extract",
    "op7_quality_rules",
    "op8_decontaminate",
    "op9_license_scan",
    "op10_language_id",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{name}"), name) for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from . import op2_ngram_jaccard, op4_warc_bundles, op7_quality_rules

    return {
        "op2_ngram_jaccard": op2_ngram_jaccard.sql_components(),
        "op4_warc_bundles": op4_warc_bundles.sql_records(),
        "op7_quality_rules": op7_quality_rules.sql_kept(),
    }
