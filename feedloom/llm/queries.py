"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from feedloom.llm import (
    bpe,
    embed_dedup,
    exact_dedup,
    html_text,
    lang_id,
    lexical,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality,
    shards,
    source_audit,
)

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_pii": pii.op4_pii,
    "op5_sharding": shards.op5_sharding,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_embedding_near_dedup": embed_dedup.op7_embedding_near_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_language_id": lang_id.op11_language_id,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_source_audit": source_audit.op13_source_audit,
}

SQL = {
    "op8_line_dedup": line_dedup.SQL_OP8,
    "op10_exact_dedup": exact_dedup.SQL_OP10,
    "op12_lexical_search": lexical.SQL_OP12,
    "op13_source_audit": source_audit.SQL_OP13,
}
