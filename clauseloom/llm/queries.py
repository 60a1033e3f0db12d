"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, conversation_repair, embedding_dedup, exact_dedup, lm_score, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup, token_alignment, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_quality": quality.op10_quality,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
SQL = {"op2_chat_format": chat_format.OP2_SQL, "op4_mixing": mixing.OP4_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op12_substring_dedup": substring_dedup.OP12_SQL}
