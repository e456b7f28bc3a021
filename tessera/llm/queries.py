"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import (
    chat_windows, decontamination, hard_negatives, line_dedup, line_quality, main_text, mixing, order_minhash, packed_tokens,
    pitman_yor, revisits, secret_forest, stratified_index,
)

QUERIES = {
    "op1_line_quality": line_quality.op1_line_quality,
    "op2_chat_windows": chat_windows.op2_chat_windows,
    "op3_pitman_yor": pitman_yor.op3_pitman_yor,
    "op4_packed_tokens": packed_tokens.op4_packed_tokens,
    "op5_warc_revisits": revisits.op5_warc_revisits,
    "op6_secret_forest": secret_forest.op6_secret_forest,
    "op7_decontaminate": decontamination.op7_decontaminate,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_order_minhash": order_minhash.op10_order_minhash,
    "op11_main_text": main_text.op11_main_text,
    "op12_stratified_search": stratified_index.op12_stratified_search,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE = {
    "op1_line_quality": line_quality.ORACLE_SQL,
    "op2_chat_windows": chat_windows.ORACLE_SQL,
    "op5_warc_revisits": revisits.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op11_main_text": main_text.ORACLE_SQL,
    "op12_stratified_search": stratified_index.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
