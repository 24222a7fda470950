"""Queries of this subpackage by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from stopwise.llm import (
    chat_format,
    collocations,
    exact_dedup,
    id_planes,
    language_id,
    line_dedup,
    media_store,
    packing,
    simhash_dedup,
    source_mix,
    substring_dedup,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_source_mix": source_mix.query,
    "op3_media_columns": media_store.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_chat_format": chat_format.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_best_fit_packing": packing.query,
    "op9_language_id": language_id.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op11_id_planes": id_planes.query,
    "op12_collocations": collocations.query,
    "op13_embedding_whitening": whitening.query,
}
ORACLES = {
    "op2_source_mix": source_mix.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
