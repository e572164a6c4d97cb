"""The queries opN_<name> and the SQL of those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, jaccard_join, lm_scoring, nearest, negatives, packing, pieces, quality_classifier, quality_rules, repair, substring_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_url_filters": url_filter.op3_url_filters,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_packing": packing.op8_packing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op11_nearest": nearest.op11_nearest,
        "op12_negatives": negatives.op12_negatives,
        "op13_conversations": repair.op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": url_filter.OP3_SQL, "op12_negatives": negatives.OP12_SQL}
