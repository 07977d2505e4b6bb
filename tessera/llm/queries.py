"""The registered queries of this subpackage, with their oracle SQL."""

from __future__ import annotations

from tessera.llm import bpe, chat, exact, fingerprints, html, jaccard, mixing, quality, sharding, urls


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_url_filter": urls.op2_url_filter,
        "op3_chat_format": chat.op3_chat_format,
        "op4_exact_dedup": exact.op4_exact_dedup,
        "op5_label_sharding": sharding.op5_label_sharding,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_bpe": bpe.op7_bpe,
        "op8_quality": quality.op8_quality,
        "op9_html_extract": html.op9_html_extract,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": urls.OP2_SQL,
        "op3_chat_format": chat.OP3_SQL,
        "op4_exact_dedup": exact.OP4_SQL,
    }
