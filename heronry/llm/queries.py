"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    byte_pairs, jaccard_join, line_dedup, line_rules, merkle, mixing, neighbours, packing, quality, secrets, spelling, sql, toxicity, training_order,
)

QUERIES = {
    "op1_quality_rff": quality.op1_quality_rff,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_training_order": training_order.op4_training_order,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op6_nn_descent": neighbours.op6_nn_descent,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op9_line_rules": line_rules.op9_line_rules,
    "op10_source_mix": mixing.op10_source_mix,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_byte_pairs": byte_pairs.op12_byte_pairs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op8_jaccard_join": sql.JACCARD_JOIN, "op9_line_rules": sql.LINE_RULES, "op11_merkle_manifest": sql.MERKLE_MANIFEST,
    "op13_spelling_variants": sql.SPELLING_VARIANTS,
}
