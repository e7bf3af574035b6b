"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from textquarry.llm import decontamination, hard_negatives, importance, line_dedup, mixing, ngram_join, ogg, pii, quality, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_media": ogg.op8_media,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
    "op11_pii": pii.op11_pii,
    "op12_importance": importance.op12_importance,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {"op3_ngram_join": ngram_join.OP3_SQL, "op4_decontamination": decontamination.OP4_SQL, "op10_warc": warc.OP10_SQL, "op12_importance": importance.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
