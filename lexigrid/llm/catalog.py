"""Queries of the corpus operators over the test tables, and their SQL where SQL can say it."""

from lexigrid.llm import chat, exact_dedup, fingerprint, langid, mixing, near_dedup, pii, quality, spm, substring_dedup

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_mixing": mixing.op3_mixing,
    "op4_sentencepiece": spm.op4_sentencepiece,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_chat": chat.op9_chat,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op3_mixing": mixing.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
