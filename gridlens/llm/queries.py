"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gridlens.llm import chroma, grammar, linededup, mixing, neardup, quality, secrets, substring, viterbi, wordbpe

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_audio_match": chroma.op3_audio_match,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_token_files": grammar.op6_token_files,
    "op7_token_counts": viterbi.op7_token_counts,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_bpe_round_trip": wordbpe.op10_bpe_round_trip,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op2_near_duplicates": neardup.OP2_SQL,
    "op4_line_dedup": linededup.OP4_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}
