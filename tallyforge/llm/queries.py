"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyforge.llm import chat, exact, jaccard, nearest, packing, pieces, quality, repeats, token_files, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_token_files": token_files.op3_token_files,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_top_k": nearest.op5_top_k,
    "op6_pieces": pieces.op6_pieces,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat": chat.op8_chat,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLE_SQL = {"op5_top_k": nearest.OP5_SQL, "op8_chat": chat.OP8_SQL, "op9_exact_dedup": exact.OP9_SQL}
