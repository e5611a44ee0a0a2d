"""The registered queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from quillon.llm import chat, exact, media, mixing, near, pieces, repeats, toxicity, urls, wordpiece

_QUERIES = {
    "op1_minhash_near_dedup": (near.op1_minhash_near_dedup, near.ORACLE),
    "op2_token_counts": (wordpiece.op2_token_counts, None),
    "op3_chat": (chat.op3_chat, chat.ORACLE),
    "op4_exact_dedup": (exact.op4_exact_dedup, exact.ORACLE),
    "op5_mixing": (mixing.op5_mixing, mixing.ORACLE),
    "op6_media": (media.op6_media, None),
    "op7_suffix_dedup": (repeats.op7_suffix_dedup, repeats.ORACLE),
    "op8_toxicity": (toxicity.op8_toxicity, None),
    "op9_sentencepiece": (pieces.op9_sentencepiece, None),
    "op10_url_filter": (urls.op10_url_filter, None),
}


def queries() -> dict:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
