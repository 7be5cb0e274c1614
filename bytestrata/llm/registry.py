"""Queries of the training-data operators and their SQL."""

from bytestrata.llm import bpe, exact_dedup, lm_score, media, near_dup, packing, pii, quality, substring_dedup, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe_codec": bpe.op3_bpe_codec,
    "op4_lm_scoring": lm_score.op4_lm_scoring,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_pii": pii.op6_pii,
    "op7_media_columns": media.op7_media_columns,
    "op8_minhash_near_dedup": near_dup.op8_minhash_near_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_quality": quality.op10_quality,
}
#: Those that SQL expresses; the others are tested against brute force.
SQL = {"op5_exact_dedup": exact_dedup.OP5_SQL}
