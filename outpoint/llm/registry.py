"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import (
    byte_bpe,
    fill_middle,
    jaccard_join,
    language,
    line_dedup,
    merkle_manifest,
    mixing,
    near_vectors,
    quality,
    token_counts,
    topk,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_top_k": topk.op2_top_k,
    "op3_near_vectors": near_vectors.op3_near_vectors,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_language_id": language.op7_language_id,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}

SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_top_k": topk.OP2_SQL,
    "op3_near_vectors": near_vectors.OP3_SQL,
    "op8_jaccard_join": jaccard_join.OP8_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "op13_merkle_manifest": merkle_manifest.OP13_SQL,
}
