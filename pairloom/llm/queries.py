"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, language_id, media, mixing, near_dedup, packing, quality, sharding, substring_dedup, topk

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_packing": packing.op3_packing,
    "op4_media_columns": media.op4_media_columns,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_topk_search": topk.op8_topk_search,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": language_id.op10_language_id,
}
SQL = {**substring_dedup.SQL, **sharding.SQL, **chat.SQL, **near_dedup.SQL, **topk.SQL}
