"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from paraloom.llm import bpe, embedding_dedup, filter_audit, html_text, language_id, line_dedup, mixing, packing, quality, simhash, token_files, url_filter, vector_codes

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_url_filter": url_filter.query,
    "op3_mixing": mixing.query,
    "op4_line_dedup": line_dedup.query,
    "op5_language_id": language_id.query,
    "op6_quality": quality.query,
    "op7_simhash": simhash.query,
    "op8_html_text": html_text.query,
    "op9_packing": packing.query,
    "op10_token_files": token_files.query,
    "op11_vector_codes": vector_codes.query,
    "op12_bpe": bpe.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLES = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
