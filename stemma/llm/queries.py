"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from stemma.llm import chat, decontaminate, divergence, hard_negatives, jaccard_join, line_templates, mixing, paragraphs, parsing, quality, token_store, url_filter, warc

QUERIES = {
    "op1_paragraphs": paragraphs.op1_paragraphs,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op6_warc": warc.op6_warc,
    "op9_tokens": token_store.op9_tokens,
    "op5_chat": chat.op5_chat,
    "op10_line_templates": line_templates.op10_line_templates,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_parsing": parsing.op8_parsing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_urls": url_filter.op12_urls,
    "op13_divergence": divergence.op13_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op5_chat": chat.ORACLE,
    "op10_line_templates": line_templates.ORACLE,
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op3_quality": quality.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_urls": url_filter.ORACLE,
    "op13_divergence": divergence.ORACLE,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
