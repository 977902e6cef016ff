"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, decontaminate, language, ngram_join, packing, ppm, sharding, substring_dedup, token_files, toxicity, url_reputation, vector_codes


def queries() -> dict:
    return {
        "op1_one_bit_neighbours": ann.op1_one_bit_neighbours,
        "op2_hyperdimensional_language": language.op2_hyperdimensional_language,
        "op3_suffix_tree_dedup": substring_dedup.op3_suffix_tree_dedup,
        "op4_boosted_toxicity": toxicity.op4_boosted_toxicity,
        "op5_host_reputation": url_reputation.op5_host_reputation,
        "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
        "op7_wu_manber_decontamination": decontaminate.op7_wu_manber_decontamination,
        "op8_bounded_ring": sharding.op8_bounded_ring,
        "op9_genetic_packing": packing.op9_genetic_packing,
        "op10_ppm_scoring": ppm.op10_ppm_scoring,
        "op11_repair_token_files": token_files.op11_repair_token_files,
        "op12_partial_distance_codes": vector_codes.op12_partial_distance_codes,
    }


def oracle_sql() -> dict:
    return {
        "op3_suffix_tree_dedup": substring_dedup.OP3_SQL,
        "op5_host_reputation": url_reputation.OP5_SQL,
        "op6_ngram_jaccard_join": ngram_join.OP6_SQL,
        "op7_wu_manber_decontamination": decontaminate.OP7_SQL,
        "op12_partial_distance_codes": vector_codes.OP12_SQL,
    }
