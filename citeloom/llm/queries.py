"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, chat, langid, media, mixing, neardup, quality, secret_scan, token_counts, topk

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_media_chunks": media.op4_media_chunks,
    "op5_secrets": secret_scan.op5_secrets,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_language": langid.op8_language,
    "op9_perspective_chat": chat.op9_perspective_chat,
    "op10_topk_products": topk.op10_topk_products,
}

ORACLE_SQL: dict[str, str] = {"op9_perspective_chat": chat.OP9_SQL, "op10_topk_products": topk.OP10_SQL}
