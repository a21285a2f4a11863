"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from . import decontamination, fuzzy_lines, html_text, importance, language_id, language_model, mixing, prefix_trie, quality_rules, ranked_search, sharding, simhash, substrings


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_consensus_extraction": html_text.op2_consensus_extraction,
        "op3_importance_resampling": importance.op3_importance_resampling,
        "op4_kneser_ney_scores": language_model.op4_kneser_ney_scores,
        "op5_simhash_components": simhash.op5_simhash_components,
        "op6_hash_tree_shards": sharding.op6_hash_tree_shards,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_template_decontamination": decontamination.op8_template_decontamination,
        "op10_fuzzy_line_dedup": fuzzy_lines.op10_fuzzy_line_dedup,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_language_codes": language_id.op12_language_codes,
        "op13_conversation_trie": prefix_trie.op13_conversation_trie,
    }


def oracle_sql():
    return {"op1_mix_sources": mixing.OP1_SQL, "op6_hash_tree_shards": sharding.OP6_SQL, "op9_substring_dedup": substrings.OP9_SQL, "op11_ranked_search": ranked_search.OP11_SQL, "op13_conversation_trie": prefix_trie.OP13_SQL}
