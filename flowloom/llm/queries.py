"""Queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.html_text import op8_html_extraction
from flowloom.llm.licenses import op7_license_scan
from flowloom.llm.mixing import op10_mixing
from flowloom.llm.multi_index import OP9_SQL, op9_embedding_dedup
from flowloom.llm.pieces import op5_sentencepiece
from flowloom.llm.quality import op1_quality_classifier
from flowloom.llm.simhash import op3_simhash_dedup
from flowloom.llm.suffix_dedup import op6_suffix_dedup
from flowloom.llm.toxicity import op2_toxicity
from flowloom.llm.vantage import op4_nearest_neighbours


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_toxicity": op2_toxicity,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_license_scan": op7_license_scan,
        "op8_html_extraction": op8_html_extraction,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators hash, train or search; tests/llm compares them with brute force."""
    return {"op9_embedding_dedup": OP9_SQL}
